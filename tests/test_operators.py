"""Small cases, conservation and properties."""

import datetime as dt
import gzip
import hashlib
import json
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from backscope.functions import scalars as x
from backscope.operators import blobs, capacity, chains, chunks, dumps, logs, proofs, reports, retention, schedule
from backscope.operators import catalog as cat
from backscope.sources import archives
from backscope.streaming import events

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2024, 6, 30)


def backups(spark, days, **more):
    rows = [{"id": i, "database": "db", "created_at": NOW - d * DAY, "status": "completed", "size_bytes": 100 + i, "backup_path": f"/b/{i}", **more} for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "id long, database string, created_at timestamp_ntz, status string, size_bytes long, backup_path string")


def test_gaps_of_a_week(spark):
    rows = schedule.gaps(backups(spark, [7, 6, 5, 3, 2]), schedule.Schedule(86400, 7200, 172800), str(NOW + dt.timedelta(seconds=1))).orderBy("gap_start").collect()
    assert [(r.gap_seconds, r.severity, r.is_tail) for r in rows] == [(172800, "info", False), (172801, "critical", True)]


def test_gaps_need_two_rows(spark):
    assert not schedule.gaps(backups(spark, [9]), schedule.Schedule(86400, 7200, 172800), str(NOW)).collect()


def test_gfs_keeps_and_deletes_everything_once(spark):
    out = retention.gfs_catalog(backups(spark, range(30)), retention.Tiers(7, 4, 2, 1))
    kept = {r.tier: r["count"] for r in out.groupBy("tier").count().collect()}
    assert sum(kept.values()) == 30 and kept["daily"] == 7


def test_gfs_with_fewer_rows_than_places(spark):
    out = retention.gfs_catalog(backups(spark, range(3)), retention.Tiers(7, 4, 2, 1)).collect()
    assert {r.tier for r in out} == {"daily"}


def test_gfs_files(spark):
    out = retention.gfs_files(backups(spark, range(10)), retention.Tiers(5, 2, 1, 1)).collect()
    assert sum(r.tier == "daily" for r in out) == 5 and len(out) == 10


def test_age_policy_keeps_the_minimum(spark):
    out = retention.age_policy(backups(spark, [100, 200, 300]), 30, 2, str(NOW)).orderBy("id").collect()
    assert [r.decision for r in out] == ["keep", "keep", "delete"]


def test_gaps_cross_spans_and_ties(spark):
    """Rows months apart, and equal times, against a plain loop."""
    r = random.Random(7)
    rows = [(i, r.choice("xyz"), NOW - dt.timedelta(hours=r.choice([1, 5, 40, 900, 901]) * r.randint(0, 30)), "completed") for i in range(120)]
    got = {(g.database, g.id): (g.gap_seconds, g.is_tail) for g in schedule.gaps(spark.createDataFrame(rows, "id long, database string, created_at timestamp_ntz, status string"), schedule.Schedule(86400, 0, 172800), str(NOW + DAY)).collect()}
    want = {}
    for name in "xyz":
        own = sorted((t, i) for i, d, t, _ in rows if d == name)
        for (t, i), after in zip(own, [t for t, _ in own[1:]] + [None], strict=True):
            length = int(((after or NOW + DAY) - t).total_seconds())
            if length > 86400:
                want[(name, i)] = (length, after is None)
    assert got == want


def test_search_of_wildcards_and_states(spark):
    b = backups(spark, range(4)).withColumn("verified_at", F.when(F.col("id") < 2, F.col("created_at"))).withColumn("verify_valid", F.when(F.col("id") < 2, F.col("id") == 0))
    assert [r.id for r in cat.search(b, cat.Search("d*", verified=True)).collect()] == [0]
    assert sorted(r.id for r in cat.search(b, cat.Search(verified=False)).collect()) == [2, 3]


def test_insert_keeps_paths_unique(spark):
    b = backups(spark, range(3))
    assert cat.insert(b, b).count() == 3


@pytest.mark.parametrize(("numbers", "missing"), [([1, 2, 3], 0), ([1, 3, 4], 1), ([1, 5, 10], 7), ([], 0)])
def test_log_chain(spark, numbers, missing):
    f = spark.createDataFrame([(f"bin.{n:06d}", n, 1) for n in numbers], "name string, number long, server_id long")
    r = logs.chain_summary(f).first()
    assert (r.missing or 0) == missing and r.valid == (missing == 0)


def test_log_filter(spark):
    lines = ["# c", "USE a;", "INSERT INTO t VALUES (1);", "USE b;", "INSERT INTO t VALUES (1);", "INSERT INTO a.t VALUES (1);", "CREATE TABLE x (i int);", ""]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(lines)], "stream long, line_no long, line string")
    keep = [r.keep for r in logs.filter_lines(df, include=["a.t"], skip_ddl=True).orderBy("line_no").collect()]
    assert keep == [True, True, True, True, False, True, False, True]
    with pytest.raises(ValueError):
        logs.check_filter(["a.b"], ["c.d"])


def test_reconcile(spark):
    a = spark.createDataFrame([("t", 1), ("u", 2)], "name string, row_count long")
    b = spark.createDataFrame([("t", 1), ("v", 3)], "name string, row_count long")
    got = {r.name: (r.source_rows, r.restored_rows, r.match) for r in proofs.reconcile(a, b).collect()}
    assert got == {"t": (1, 1, True), "u": (2, -1, False), "v": (-1, 3, False)}


def test_chunks_restore_and_keep_bounds(spark):
    r = random.Random(1)
    data = [b"", r.randbytes(100), r.randbytes(100_000), bytes(200_000)]
    df = spark.createDataFrame(list(enumerate(data)), "blob_id long, data binary")
    c = chunks.chunk(df)
    back = {x.source_id: (bytes(x.data), x.ok) for x in chunks.restore(c).collect()}
    assert back == {i: (d, True) for i, d in enumerate(data) if d}
    for d in data[2:]:
        ends = chunks.cuts(d)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert all(chunks.SHORTEST < s <= chunks.LONGEST for s in sizes[:-1]) and sum(sizes) == len(d)


def test_chunks_survive_a_shift():
    d = random.Random(2).randbytes(400_000)
    def parts(x):
        e = chunks.cuts(x)
        return {x[a:b] for a, b in zip([0, *e], e, strict=False)}

    assert len(parts(d) & parts(b"x" * 1000 + d)) >= len(parts(d)) // 2
    assert chunks.cuts(d) == chunks.cuts(d)


def test_chunk_ends_match_a_rolling_sum():
    d = random.Random(3).randbytes(120_000)
    ends, start, h = [], 0, 0
    gear = chunks._GEAR.tolist()
    for i, byte in enumerate(d):
        h = ((h << 1) + gear[byte]) % (1 << 64)
        n = i + 1 - start
        if (n >= chunks.SHORTEST and h % chunks.USUAL == 0 and n > 0) or n == chunks.LONGEST:
            ends.append(i + 1)
            start, h = i + 1, 0
    if start < len(d):
        ends.append(len(d))
    assert chunks.cuts(d) == ends


def test_bloom_forgets_nothing():
    b = blobs.Bloom(500, 0.01)
    known = [str(i).encode() for i in range(500)]
    for k in known:
        b.add(k)
    assert all(k in b for k in known)
    assert sum(f"x{i}".encode() in b for i in range(2000)) < 100


def test_types_by_signature(spark):
    data = [b"\x89PNG\r\n\x1a\n" + bytes(20), b"{" + b"a" * 30, b"short", bytes(64), random.Random(1).randbytes(4096), b"RIFF1234WEBP" + bytes(9)]
    df = spark.createDataFrame(list(enumerate(data)), "i long, data binary")
    got = [r.t for r in df.select("i", blobs.type_of(F.col("data"), blobs.entropy_of(F.col("data"))).alias("t")).orderBy("i").collect()]
    assert got == ["compressed", "text", "unknown", "text", "compressed", "compressed"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 400))
def test_cuts_cover_everything(part, times):
    data = part * times
    ends = chunks.cuts(data)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    assert all(b - a <= chunks.LONGEST for a, b in zip([0, *ends], ends, strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab;'$ \n", max_size=20), st.integers(0, 3)), max_size=5))
def test_archives_give_back_what_they_got(entries):
    packed = archives.pack([({"tag": t, "section": k}, t.encode() * k) for t, k in entries])
    assert [(e["tag"], archives.block(packed, e)) for e in archives.contents(packed)] == [(t, t.encode() * k) for t, k in entries]


def test_scalars(spark):
    df = spark.createDataFrame([("100GB", "2w", "10MB/s"), ("x", "6m", "1.5MB/s"), ("1.5 kb", "1h30m", "7")], "s string, d string, r string")
    got = [tuple(r) for r in df.select(x.parsed_size(F.col("s")), x.parsed_duration(F.col("d")), x.parsed_rate(F.col("r"))).collect()]
    assert got[0] == (100 * 2**30, 14 * 86400, 10 * 2**20)
    assert got[1] == (None, 180 * 86400, None)
    assert got[2] == (1536, 30 * 86400, 7)
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (2**40,)], "n long")
    assert [r[0] for r in sizes.select(x.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 TB"]


def test_forecast_of_steady_growth(spark):
    b = backups(spark, [3, 2, 1, 0])
    g = capacity.growth(b).first()
    assert g.daily_growth == 1.0 and g.confidence == "low"
    assert [r.predicted_size for r in capacity.forecast(capacity.growth(b), [7, 30]).orderBy("horizon").collect()] == [110, 133]


def test_dump_is_split(spark):
    text = "-- head\nSET x = 1;\nCREATE TABLE a (\n  t text\n);\nCREATE FUNCTION f() AS $$ begin; end; $$ LANGUAGE sql;\nCOPY a (t) FROM stdin;\n1;\n2\n\\.\nINSERT INTO a VALUES (';');\nCREATE INDEX i ON a (t);\nALTER TABLE ONLY a ADD CONSTRAINT c PRIMARY KEY (t);\nSELECT 1"
    rows = dumps.split_dumps(spark, spark.createDataFrame([(1, text), (2, None)], "dump_id long, text string")).orderBy("seq").collect()
    assert [r.phase for r in rows] == ["pre-data"] * 3 + ["data", "data", "post-data", "post-data", "unknown"]
    assert rows[3].copy_rows == 2 and rows[3].table_name == "a" and rows[-1].kind == "incomplete"


def test_archive_round_trip(spark, tmp_path):
    r = random.Random(5)
    entries = [({"dump_id": i, "tag": f"t{i}", "section": i % 3}, r.randbytes(1000 * i)) for i in range(4)]
    (tmp_path / "a.bsar").write_bytes(archives.pack(entries))
    spark.dataSource.register(archives.ArchiveSource)
    for df in (archives.read_archives(spark, str(tmp_path / "a.bsar")), spark.read.format("bsar").load(str(tmp_path / "a.bsar"))):
        assert {x.dump_id: bytes(x.data) for x in df.collect()} == {a["dump_id"]: d for a, d in entries}
    with pytest.raises(ValueError):
        archives.contents(archives.pack(entries)[:-3])


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.meta.json").write_text(json.dumps({"database": "a", "backup_file": "/b/a", "size_bytes": 5}))
    (tmp_path / "b.meta.json").write_text("{broken")
    (tmp_path / "c.meta.json").write_text(json.dumps({"cluster_name": "c", "databases": [{"database": "x"}, {"database": "y"}]}))
    assert [r.database for r in archives.sidecars(spark, str(tmp_path)).collect()] == ["a"]
    assert sorted(r.database for r in archives.cluster_sidecars(spark, str(tmp_path)).collect()) == ["x", "y"]


def test_packs_hold_everything(spark):
    data = {i: random.Random(i).randbytes(i * 10) for i in range(50)}
    out = archives.pack_objects(spark.createDataFrame(list(data.items()), "blob_id long, data binary"), 2000).collect()
    assert {e.id: bytes(p.data[e.offset : e.offset + e.length]) for p in out for e in p.toc} == data


def oplog(spark, rows):
    return spark.createDataFrame([(i, NOW + dt.timedelta(seconds=s), "db", t, v, "h", 1.0) for i, (s, t, v) in enumerate(rows)], "id long, ts timestamp_ntz, database string, type string, severity string, host string, duration_s double")


def test_escalation(spark):
    e = oplog(spark, [(0, "backup_failed", "error"), (1000, "backup_failed", "error"), (2000, "x", "info"), (4000, "backup_completed", "info"), (5000, "backup_failed", "error")])
    got = sorted(tuple(r)[2:] for r in events.escalate(e).collect())
    assert got == [("level_0", 0, 1, 1), ("resolved", 2, 4, 2)]


def test_batches_open_with_the_first_event(spark):
    e = oplog(spark, [(0, "a", "info"), (299, "a", "error"), (300, "a", "info"), (301, "a", "warning")])
    assert [(r.n, r.worst) for r in events.batches(e).orderBy("first_ts").collect()] == [(2, 3), (2, 2)]


def test_streams_agree_with_tables(spark, tmp_path):
    e = oplog(spark, [(60 * i, "backup_failed" if i % 3 else "backup_completed", "error" if i % 3 else "info") for i in range(60)])
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.digest(events.wanted(events.stream(spark, str(tmp_path / "in"), e.schema).withColumn("ts", F.col("ts").cast("timestamp")), hosts=["h"]), late="1 minute").writeStream.format("memory").queryName("digests").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("digests").agg(F.sum("n")).first()[0] == 60
    q = events.escalate_stream(events.stream(spark, str(tmp_path / "in"), e.schema)).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("alerts").collect())) == sorted(map(tuple, events.escalate(e).collect()))
    q = events.write_rotated(events.stream(spark, str(tmp_path / "in"), e.schema), str(tmp_path / "out"), str(tmp_path / "c3"), 25)
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 60 and len([f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".gz")]) == 3


def test_rates():
    assert events.adapted_rate(100, [True] * 5, 1, 1000) == 120
    assert round(events.adapted_rate(100, [True] * 4 + [False], 1, 1000), 6) == 70


def test_ema(spark):
    rows = [(1, NOW + dt.timedelta(seconds=i), i, 1000) for i in range(8)] + [(2, NOW, 0, 5)]
    got = {r.key: r for r in events.ema_speed(spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, delta long")).collect()}
    assert got[1].bytes_per_s == 1000 and got[1].warm and got[2].samples == 0



def test_depths_of_long_chains_cycles_and_strangers(spark):
    """A chain of over a million links, a cycle with a tail, and an entry that depends on nothing known."""
    n = 1_200_000
    rows = spark.range(1, n + 1).select(F.col("id").alias("dump_id"), (F.col("id") - 1).alias("depends_on"))
    rows = rows.unionByName(spark.createDataFrame([(n + 10, n + 12), (n + 11, n + 10), (n + 12, n + 11), (n + 13, n + 10), (n + 20, n + 99)], "dump_id long, depends_on long"))
    out = dumps.dependency_order(rows)
    assert out.where("depth = dump_id - 1 and not leftover").count() == n
    assert sorted(r.dump_id - n for r in out.where("leftover").collect()) == [10, 11, 12, 13, 20]


def test_ancestors_against_walking(spark):
    r = random.Random(5)
    parent = {i: r.choice([0, i - 1, i - 1, i - 1, r.randrange(1, i + 1), 900]) for i in range(1, 300)}
    got = {(x.id, x.link, x.depth) for x in logs.base_chain(spark.createDataFrame(list(parent.items()), "id long, base_id long"), F.col("id") % 2 == 0, hops=20).collect()}
    want = set()
    for i in range(2, 300, 2):
        at, depth = i, 0
        while at in parent and depth <= 20:
            want.add((i, at, depth))
            at, depth = parent[at], depth + 1
    assert got == want


def test_timelines_beyond_the_hops(spark):
    """A chain of 140 and a cycle: only those too far from a root fail."""
    links = [(1, 0)] + [(i, i - 1) for i in range(2, 141)] + [(500, 501), (501, 500)]
    t = spark.createDataFrame(links, "timeline long, parent long")
    assert {r.timeline for r in logs.endless_timelines(t).collect()} == {*range(102, 141), 500, 501}
    paths = logs.timeline_paths(t)
    assert paths.count() == sum(range(1, 102)) and paths.where("depth = 100").count() == 1


def test_recovery_windows_over_spans(spark):
    r = random.Random(7)
    numbers = sorted(r.sample(range(8000), 3000) + list(range(20_000, 20_050)))
    ends = {n: f"2024-01-01 00:{r.randrange(60):02d}:{r.randrange(60):02d}" for n in numbers}
    files = spark.createDataFrame([(n, f"f{n}", ends[n]) for n in numbers], "number long, name string, e string").withColumn("end_time", F.col("e").cast("timestamp_ntz"))
    starts = [0, 1, 1023, 1024, 1025, 7999, 8000, 15_000, 20_000, 20_010, 20_049, 20_050, 99_999] + r.sample(range(8000), 40)
    bases = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "base_id long, start_number long").withColumn("base_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {x.base_id: (x.log_files, x.last_file, x.has_gaps) for x in logs.recovery_windows(bases, files, "2024-02-01").collect()}
    for i, s in enumerate(starts):
        own = [n for n in numbers if n >= s]
        last = max(((ends[n], n) for n in own), default=(None, None))[1]
        assert got[i] == (len(own), last and f"f{last}", any(b != a + 1 for a, b in zip(own, own[1:]))), s


def test_previous_and_running_over_spans(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 5, 9])) for i in r.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {x.i: (x.before, x.total) for x in chains.running(chains.previous(df, ["k"], F.floor(F.col("i") / 32), ["i"], {"v": "before"}), ["k"], F.floor(F.col("i") / 50), ["i"], F.col("v"), "total").collect()}
    for k in ("a", "b", None):
        before, total = None, 0
        for _, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            assert got[i] == (before, total)
            before, total = v, total + (v or 0)


def test_known_and_newest_over_spans(spark):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(300), r.choice([None, None, None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, at long, v long")
    spans, order = F.floor(F.col("at") / 16), ["at", "i"]
    got = {x.i: (x.seen, x.rank) for x in chains.newest(chains.known(df, ["k"], spans, order, F.col("v"), "seen"), ["k"], spans, order, "rank").collect()}
    for k in ("a", "b", None):
        own, seen = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])), None
        for n, (_, i, _, v) in enumerate(own):
            assert got[i] == (seen, len(own) - n)
            seen = v or seen


def test_policies_against_plain_ranks(spark):
    """Ties in time, and rows without a time, which come last."""
    r = random.Random(10)
    at = [None if i % 20 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=12 * r.randrange(80)) for i in range(200)]
    rows = [(i, r.choice(["a", "b"]), 10, t) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, database string, size_bytes long, created_at timestamp_ntz")
    by_age = {x.id: (x.rank, x.reason) for x in retention.age_policy(df, 10, 4, "2024-02-01").collect()}
    kept = {x.id for x in retention.manifest_rules(df, 3, 4, 2).where("keep").collect()}
    for k in ("a", "b"):
        own = sorted((x for x in rows if x[1] == k), key=lambda x: (x[3] is not None, x[3] or 0, x[0]), reverse=True)
        want = {x[0] for x in own[:3]}
        for key, most in ((lambda t: t and t.date(), 4), (lambda t: t and t.isocalendar()[:2], 2)):
            first: dict = {}
            for x in own:
                first.setdefault(key(x[3]), x[0])
            want |= set(list(first.values())[:most])
        assert {x[0] for x in own} & kept == want
        for n, (i, _, _, t) in enumerate(own, 1):
            old = t is not None and dt.datetime(2024, 2, 1) - t > dt.timedelta(days=10)
            assert by_age[i] == (n, "minimum" if n <= 4 else "older than 10 days" if old else "within 10 days")


def test_servers_change_across_spans(spark):
    r = random.Random(11)
    rows = [(f"{p}.{n:06d}", n, r.choice([0, 0, 0, 1, 2])) for p in ("x", "y") for n in sorted(r.sample(range(6000), 60))]
    got = {x.name: (x.missing, bool(x.server_changed)) for x in logs.chain(spark.createDataFrame(rows, "name string, number long, server_id long")).collect()}
    for p in ("x", "y"):
        before = server = None
        for name, n, s in (x for x in rows if x[0][0] == p):
            assert got[name] == (0 if before is None else n - before - 1, bool(s and server and s != server))
            before, server = n, s or server


def test_use_and_definitions_in_log_filters(spark):
    lines = ["USE `shop` ;", "INSERT INTO t VALUES (1)", "USE INDEX (i1)", "INSERT INTO t VALUES (2)", "CREATE TABLE other (i int)", "DELETE FROM other", "use b", "UPDATE `t` SET i = 1", "drop table t"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "stream long, line_no long, line string")
    kept = {r.line_no for r in logs.filter_lines(df, include=["shop.t"]).collect() if r.keep}
    assert kept == {0, 1, 2, 3, 4, 6, 8}
    assert {r.line_no for r in logs.filter_lines(df, include=["shop.t"], skip_ddl=True).collect() if r.keep} == {0, 1, 2, 3, 6}


def test_too_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(logs, "RANGES", 3)
    files = spark.createDataFrame([("f", None, None)], "name string, start_time timestamp_ntz, end_time timestamp_ntz")
    ranges = spark.range(4).select(F.col("id").alias("range_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("range_start"), F.lit("2024-01-02").cast("timestamp_ntz").alias("range_end"))
    with pytest.raises(ValueError):
        logs.overlapping(files, ranges, "2024-01-01")
    assert logs.overlapping(files, ranges.limit(3), "2024-01-01").count() == 3


def test_reports_without_findings_and_odd_styles(spark):
    facts = spark.createDataFrame([(10, 10, 3, 10)], "backups long, encrypted long, drills long, hashed long")
    controls = proofs.judged(facts)
    text = {r.framework: r.report for r in reports.render(controls, "html", "A < B & \"C\"", "2024-01-01").collect()}
    assert len(text) == 5 and all("A &lt; B &amp; &quot;C&quot;" in t and 'class="compliant"' in t for t in text.values())
    assert all(json.loads(r.report)["findings"] == [] for r in reports.render(controls, "json", "t", "now").collect())
    with pytest.raises(ValueError):
        reports.render(controls, "pdf", "t", "now")


def test_exports_and_watched_files(spark, tmp_path):
    order = archives.export_tables(spark, {"small": spark.range(3), "large": spark.range(50), "other": spark.range(1)}, f"file://{tmp_path}/x", {"large": 50, "small": 3})
    assert order == ["large", "small", "other"] and [spark.read.parquet(f"file://{tmp_path}/x/{n}").count() for n in order] == [50, 3, 1]
    (tmp_path / "w").mkdir()
    seen = []
    for name in ("a.log", "b.log", "c.txt"):
        (tmp_path / "w" / name).write_text(name)
        stream = events.watch(spark, f"file://{tmp_path}/w", "*.log").writeStream.foreachBatch(lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()))
        stream.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == ["a.log", "b.log"]


def test_streams_rotate_by_bytes_and_drop_definitions(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "ddl").otherwise("row").alias("type"), F.lit("d").alias("database"), F.lit("h").alias("host"))
    assert events.wanted(rows, ddl=False).count() == 900 and events.wanted(rows).count() == 1000
    rows.repartition(1).write.parquet(f"file://{tmp_path}/in")
    events.write_rotated(events.stream(spark, f"file://{tmp_path}/in", rows.schema), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", bytes_per_file=10_000).awaitTermination()
    files = [p for p in (tmp_path / "out").rglob("part-*")]
    assert len(files) >= 4 and spark.read.json(f"file://{tmp_path}/out").count() == 1000


def test_filters_of_columns(spark):
    """Made in parts, equal to one made value by value; nothing known fails."""
    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(300)]
    df = spark.createDataFrame([(d,) for d in [*digests, None]], "digest binary").repartition(5)
    known = blobs.Bloom(300, 0.02)
    for d in digests:
        known.add(d)
    made = blobs.bloom_of(df, 0.02)
    assert (made.m, made.k, made.bits) == (known.m, known.k, known.bits)
    assert blobs.bloom_of(df, 0.02, most_bits=64) is None
    others = [hashlib.sha256(b"x%d" % i).digest() for i in range(300)]
    got = spark.createDataFrame([(d,) for d in [*digests, *others, None]], "digest binary").select("digest", blobs.may_be_known(F.col("digest"), made).alias("maybe")).collect()
    assert all(r.maybe == (r.digest is not None and bytes(r.digest) in known) for r in got) and sum(r.maybe for r in got) < 330


def test_repeated_contents(spark):
    rows = [(1, b"a"), (2, b"b"), (3, b"a"), (4, None), (5, None), (6, b""), (7, b"")]
    got = blobs.repeated(spark.createDataFrame(rows, "blob_id long, data binary")).collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, True), (7, True)]
    assert blobs.repeated(spark.createDataFrame([], "blob_id long, data binary")).collect() == []


def test_limits_of_hosts(spark):
    """Against one attempt after the other."""
    r = random.Random(4)
    rows = [(k, r.choice((0, 1, 2, 3, 30, 400, 2000)), r.random() < 0.4) for k in "abc" for _ in range(60)]
    at, listed, want = Counter(), [], {}
    for i, (k, gap, ok) in enumerate(rows):
        at[k] += gap
        listed.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at[k]), i, ok))
    for k in "abc":
        last, count, refused, delayed, waited = None, 0, 0, 0, 0.0
        for when in [(x[1] - dt.datetime(2024, 1, 1)).total_seconds() for x in listed if x[0] == k]:
            ok = next(x[3] for x in listed if x[0] == k and x[2] not in want.setdefault(k, set()) and not want[k].add(x[2]))
            if last is None or when - last > 300:
                count, end = 1, when
            elif count >= 4:
                refused += 1
                continue
            else:
                end = max(when, last + (min(2 ** (count - 1), 60) if count else 0))
                count += 1
            delayed, waited, last, count = delayed + (end > when), waited + end - when, end, 0 if ok else count + 1
        want[k] = (60, refused, delayed, waited)
    got = {x.key: (x.attempts, x.refused, x.delayed, x.waited_s) for x in events.limited(spark.createDataFrame(listed, "key string, ts timestamp, seq long, ok boolean"), most=4).collect()}
    assert got == want and any(x[1] for x in want.values()) and any(x[2] for x in want.values())
    assert events.limited(spark.createDataFrame([], "key string, ts timestamp, seq long, ok boolean")).collect() == []


def test_no_backoff_after_a_success_that_waited(spark):
    """By hand: the second attempt waits until 2.0 and succeeds, so that those at 1.5 and 1.6 go at once; the last waits for 1.6 + 2."""
    rows = [("a", NOW + dt.timedelta(seconds=t), i, ok) for i, (t, ok) in enumerate([(0, False), (1, True), (1.5, True), (1.6, False), (2, True)])]
    got = events.limited(spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq long, ok boolean")).collect()
    assert list(map(tuple, got)) == [("a", 5, 0, 2, 2.6)]


def test_folds_go_on_across_batches_and_keys(spark):
    """Against plain loops, with keys longer than an Arrow batch, keys without a name, times without a value and ties."""
    r = random.Random(12)
    rows = [(i, r.choice(["a", None]), NOW + dt.timedelta(seconds=r.randrange(9000)) if r.random() < 0.98 else None, r.choice(["info", "warning", "error"])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, host string, ts timestamp_ntz, severity string")
    sizes = [(k, i, r.randrange(90)) for k in ("x", "y", None) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = Counter(map(tuple, events.batches(df, 120, 9).collect()))
        cut = {(x.k, x.i): x.batch for x in dumps.greedy_batches(spark.createDataFrame(sizes, "k string, i long, bytes long"), ["k"], "i", 7, 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: list = []
    for host in ("a", None):
        for timeless in (True, False):
            own: list = []
            for _, _, at, severity in sorted((x for x in rows if x[1] == host and (x[2] is None) == timeless), key=lambda x: (x[2] or NOW, x[0])):
                rank = {"info": 0, "warning": 2, "error": 3}[severity]
                if not own or own[-1][3] == 9 or (at and (at - own[-1][1]).total_seconds() >= 120):
                    own.append((host, at, at, 1, rank))
                else:
                    own[-1] = (host, own[-1][1], at, own[-1][3] + 1, max(own[-1][4], rank))
            want += own
    assert got == Counter(want)
    for key in ("x", "y", None):
        batch, n, held = 0, 0, 0
        for k, i, size in sizes:
            if k == key:
                if n == 7 or (n and held + size > 300):
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + size
                assert cut[k, i] == batch
    assert events.batches(df.limit(0)).collect() == [] and events.escalate(oplog(spark, [])).collect() == []


def test_lines_and_batches_over_spans(spark, monkeypatch):
    """Context, COPY blocks and counted batches against plain loops, with spans and blocks of a few lines."""
    monkeypatch.setattr(dumps, "SPAN", 16)
    r = random.Random(13)
    kinds = ["COPY public.t (id) FROM stdin;", "\\.", "x", "x", "x"]
    rows = [(s, n, r.choice(kinds), r.random() < 0.03) for s in (1, None) for n in sorted(r.sample(range(2000), 300))]
    df = spark.createDataFrame(rows, "stream int, line_no long, line string, bad boolean")
    for around in (0, 3, 40):
        got = {(x.stream, x.line_no) for x in dumps.context_lines(df, F.col("bad"), around).collect()}
        want = set()
        for s in (1, None):
            own = [x for x in rows if x[0] == s]
            want |= {(s, own[k][1]) for i, x in enumerate(own) if x[3] for k in range(max(0, i - around), min(len(own), i + around + 1))}
        assert got == want
    blocks = {(x.stream, x.line_no): x.truncated for x in dumps.copy_blocks(df).collect()}
    batch = {(x.stream, x.line_no): x.batch for x in dumps.count_batches(df, ["stream"], "line_no", 7).collect()}
    for s in (1, None):
        own = [x for x in rows if x[0] == s]
        marks = [x for x in own if x[2] != "x"]
        for a, b in zip(marks, [*marks[1:], None], strict=True):
            assert a[2] != kinds[0] or blocks.pop((s, a[1])) == (b is None or b[2] == kinds[0])
        assert all(batch[s, x[1]] == i // 7 for i, x in enumerate(own))
    assert not blocks


def test_checksums_of_groups(spark):
    rows = [("a", 2, "y"), ("a", 1, "x\u00e9"), ("a", None, "z"), ("a", 3, None), (None, 1, "q")]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = {x.k: x.checksum for x in proofs.table_checksum(df, ["k"], F.col("t"), ["i"]).collect()}
    assert got == {"a": hashlib.md5("x\u00e9yz".encode()).hexdigest(), None: hashlib.md5(b"q").hexdigest()}
    assert proofs.table_checksum(df.limit(0), [], F.col("t"), ["i"]).first().checksum == "empty"
    assert proofs.table_checksum(df.where("k = 'a'"), [], F.col("t"), ["i"]).first().checksum == got["a"]


def test_waits_at_a_rate(spark):
    """Against one request after the other, at a rate that makes many wait."""
    r, rows, want = random.Random(8), [], {}
    for key in range(4):
        at, left, last, waited, delayed = 0.0, 50.0, None, 0.0, 0
        for i in range(80):
            at, size = at + r.choice((0, 1, 5, 60)), r.randint(0, 90)
            rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), i, size))
            left = min(left + (at - (at if last is None else last)) * 2.0, 50.0) - size
            last = at
            waited, delayed = waited + max(-left, 0.0) / 2.0, delayed + (left < 0)
        want[key] = (round(waited, 3), delayed)
    got = {x.key: (x.waited_s, x.delayed) for x in events.token_bucket(spark.createDataFrame(rows, "key long, ts timestamp, seq long, delta long"), 2.0, 50.0).collect()}
    assert got == want and all(x[1] for x in want.values())


def test_column_analysis(spark):
    r = random.Random(2)
    packed = gzip.compress(bytes(r.randrange(256) for _ in range(3000)), mtime=0)
    held = {"text": [b"the same words again " * 50, b"", None], "packed": [packed, packed], "mixed": [packed, b"abc " * 500]}
    got = {x.grp: x for x in blobs.column_analysis(spark.createDataFrame([(k, d) for k, v in held.items() for d in v], "grp string, data binary"), ["grp"]).collect()}
    assert set(got) == set(held)
    for k, values in held.items():
        total, small = sum(len(d or b"") for d in values), sum(len(gzip.compress(d or b"", 6, mtime=0)) for d in values)
        hard = sum(len(d) for d in values if d == packed)
        share, ratio = 100 * hard / total, total / small
        assert (got[k].total_size, got[k].packed_size, got[k].incompressible) == (total, small, hard) and got[k].ratio == pytest.approx(ratio)
        assert got[k].advice == ("skip" if share > 80 or ratio < 1.1 else "low_level" if share > 50 else "partial" if share > 20 else "compress")
    assert {x.advice for x in got.values()} >= {"skip", "compress"}
