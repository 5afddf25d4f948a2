"""Queries on transaction logs, timelines and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs as g
from ..sources.views import EVENTS_AS_OF
from .registry import query

NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
CHAIN = "ch AS (SELECT name, number, lag(number) OVER w AS before, server_id, last_value(nullif(server_id, 0) IGNORE NULLS) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb FROM log_files WINDOW w AS (ORDER BY number)), cc AS (SELECT name, number, CASE WHEN number <> before + 1 THEN number - before - 1 ELSE 0 END AS missing, server_id <> 0 AND sb <> server_id AS server_changed FROM ch)"


@query("w6_log_chain", "log_files", sql=f"{CHAIN} SELECT * FROM cc")
def chain(f: DataFrame) -> DataFrame:
    return g.chain(f)


@query("w6_chain_summary", "log_files", sql=f"{CHAIN} SELECT count(*) AS files, count(*) FILTER (missing > 0) AS gaps, sum(missing)::BIGINT AS missing, count(*) FILTER (server_changed) AS warnings, count(*) FILTER (missing > 0) = 0 AS valid FROM cc")
def chain_summary(f: DataFrame) -> DataFrame:
    return g.chain_summary(f)


@query("w7_sequence_gaps", "log_files", sql=f"{CHAIN} SELECT count(*) FILTER (missing > 0) AS gaps FROM cc")
def sequence_gaps(f: DataFrame) -> DataFrame:
    return g.chain(f).agg(F.count_if(F.col("missing") > 0).alias("gaps"))


@query("j6_overlapping_logs", "log_files", sql=f"r AS (SELECT i::INT AS range_id, TIMESTAMP '2024-01-02' + INTERVAL 5 DAY * i AS a, TIMESTAMP '2024-01-04' + INTERVAL 5 DAY * i AS z FROM range(5) t(i)) SELECT range_id, name FROM log_files JOIN r ON (start_time IS NULL AND end_time IS NULL) OR (coalesce(start_time, a) <= z AND coalesce(end_time, {NOW}) >= a)")
def overlapping(f: DataFrame) -> DataFrame:
    r = f.sparkSession.range(5).select(F.col("id").cast("int").alias("range_id"), F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_interval(0, 0, 0, int(5 * id))").alias("range_start"), F.expr("timestamp_ntz'2024-01-04 00:00:00' + make_interval(0, 0, 0, int(5 * id))").alias("range_end"))
    return g.overlapping(f, r, EVENTS_AS_OF)


@query("j7_recovery_windows", "log_files", sql=f"""
bs AS (SELECT i AS base_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * i AS base_time, i * 4 AS start_number FROM range(30) t(i)), fl AS (SELECT *, CASE WHEN lead(number) OVER (ORDER BY number) <> number + 1 THEN 1 ELSE 0 END AS gap FROM log_files)
SELECT base_id, any_value(base_time) AS base_time, count(number) AS log_files, coalesce(max(end_time), {NOW}) AS end_time, max(struct_pack(e := end_time, n := number, f := name)).f AS last_file, coalesce(sum(gap) > 0, false) AS has_gaps FROM bs LEFT JOIN fl ON number >= start_number GROUP BY base_id""")
def windows(f: DataFrame) -> DataFrame:
    b = f.sparkSession.range(30).select(F.col("id").alias("base_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id))").alias("base_time"), (F.col("id") * 4).alias("start_number"))
    return g.recovery_windows(b, f, EVENTS_AS_OF)


@query("f7_replay_files", "log_files", sql="SELECT name FROM log_files WHERE number BETWEEN 10 AND 40")
def replay(f: DataFrame) -> DataFrame:
    return g.replay_files(f, 10, 40).select("name")


@query("x11_positions", "log_files", sql="SELECT name, number, (number, start_pos) < (50, 50004) AS before_target FROM log_files")
def positions(f: DataFrame) -> DataFrame:
    at = g.position_of(F.concat_ws(":", "name", F.col("start_pos").cast("string")))
    return f.select("name", g.number_of(F.col("name")).alias("number"), (at < g.position_of(F.lit("mysql-bin.000050:50004"))).alias("before_target"))


def _archive(f: DataFrame) -> DataFrame:
    return f.select("name", "size", F.col("end_time").alias("time"), (F.col("number") % 2 == 0).alias("compressed"), (F.col("number") % 3 == 0).alias("encrypted"))


@query("a24_archive_stats", "log_files", sql="SELECT count(*) AS files, sum(size)::BIGINT AS size, count(*) FILTER (number % 2 = 0) AS compressed, count(*) FILTER (number % 3 = 0) AS encrypted, min(struct_pack(t := end_time, n := name)).n AS oldest, max(struct_pack(t := end_time, n := name)).n AS newest, round(100.0 * (1 - sum(size)::DOUBLE / (count(*) * 16777216)), 6) AS compression_rate FROM log_files")
def archive_stats(f: DataFrame) -> DataFrame:
    return g.archive_stats(_archive(f))


@query("a10_archive_metrics", "log_files", sql=f"{CHAIN} SELECT count(*) AS files, sum(size)::BIGINT AS size, min(start_time) AS oldest, max(end_time) AS newest, count(*) FILTER (missing > 0) AS gaps, epoch({NOW})::BIGINT - epoch(date_trunc('second', max(end_time)))::BIGINT AS lag_seconds, ((epoch(date_trunc('second', max(end_time)))::BIGINT - epoch(date_trunc('second', min(start_time)))::BIGINT) // 60) AS window_minutes FROM log_files JOIN cc USING (name)")
def archive_metrics(f: DataFrame) -> DataFrame:
    return g.archive_metrics(f, EVENTS_AS_OF)


@query("r7_log_retention", "log_files", sql=f"SELECT name, CASE WHEN epoch({NOW})::BIGINT - epoch(date_trunc('second', end_time))::BIGINT > 14 * 86400 AND NOT name >= 'mysql-bin.000030' THEN 'delete' ELSE 'keep' END AS decision FROM log_files")
def retention(f: DataFrame) -> DataFrame:
    from ..operators.retention import wal_retention

    return wal_retention(f.withColumnRenamed("end_time", "mod_time"), 14, EVENTS_AS_OF, "mysql-bin.000030").select("name", "decision")


def _wal(f: DataFrame) -> DataFrame:
    n = F.col("number")
    return f.select(F.concat(F.lpad(F.hex(n % 5 + 1), 8, "0"), F.lpad(F.hex(n * 4294967296 + n), 16, "0"), F.when(n % 3 == 0, ".gz.enc").when(n % 3 == 1, ".partial").otherwise("")).alias("name"), F.col("end_time").alias("mod_time"), "number")


_WAL = "wal AS (SELECT lpad(hex(number % 5 + 1), 8, '0') || lpad(hex(number * 4294967296 + number), 16, '0') || CASE number % 3 WHEN 0 THEN '.gz.enc' WHEN 1 THEN '.partial' ELSE '' END AS name, end_time AS mod_time, number FROM log_files)"


@query("x12_wal_names", "log_files", sql=f"{_WAL} SELECT name, true AS is_segment, (number % 5 + 1)::VARCHAR AS timeline, (number * 4294967296 + number)::VARCHAR AS segment FROM wal")
def wal_names(f: DataFrame) -> DataFrame:
    ok, line, segment = g.wal_name(F.col("name"))
    return _wal(f).select("name", ok.alias("is_segment"), line.cast("string").alias("timeline"), segment.cast("string").alias("segment"))


@query("g3_timeline_segments", "log_files", "timelines", sql=f"{_WAL} SELECT (number % 5 + 1) AS timeline, min(number * 4294967296 + number)::VARCHAR AS first, max(number * 4294967296 + number)::VARCHAR AS last, count(*) AS segments FROM wal WHERE number % 5 + 1 IN (SELECT timeline FROM timelines) GROUP BY 1")
def timeline_segments(f: DataFrame, t: DataFrame) -> DataFrame:
    return g.timeline_segments(_wal(f), t).select("timeline", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "segments")


@query("g7_required_files", "log_files", sql="f AS (SELECT name, end_time, max((end_time > TIMESTAMP '2024-01-15')::INT) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM log_files WHERE name >= 'mysql-bin.000012') SELECT name, end_time AS mod_time FROM f WHERE coalesce(past, 0) = 0")
def required(f: DataFrame) -> DataFrame:
    return g.required_files(f.withColumnRenamed("end_time", "mod_time"), "mysql-bin.000012", "2024-01-15")


PATHS = "RECURSIVE up AS (SELECT timeline, timeline AS ancestor, parent, 0 AS depth FROM timelines UNION ALL SELECT u.timeline, t.timeline, t.parent, u.depth + 1 FROM up u JOIN timelines t ON t.timeline = u.parent WHERE u.depth < 100)"


@query("g1_timeline_paths", "timelines", sql=f"{PATHS} SELECT timeline, ancestor, depth FROM up")
def paths(t: DataFrame) -> DataFrame:
    return g.timeline_paths(t)


@query("g1_endless_timelines", "timelines", sql="SELECT timeline, 'possible cycle' AS error FROM timelines WHERE timeline IN (5, 10, 11, 20, 21, 22, 23)")
def endless(t: DataFrame) -> DataFrame:
    """Once timeline 5 has timeline 10 for its parent."""
    return g.endless_timelines(t.withColumn("parent", F.when(F.col("timeline") == 5, 10).otherwise(F.col("parent"))))


@query("g2_broken_timelines", "timelines", sql="SELECT timeline, parent FROM (SELECT timeline, parent FROM timelines WHERE timeline <> 3) WHERE timeline > 1 AND parent NOT IN (SELECT timeline FROM timelines WHERE timeline <> 3)")
def broken(t: DataFrame) -> DataFrame:
    return g.broken_timelines(t.where("timeline <> 3"))


@query("g4_timeline_at", "timelines", sql="SELECT max(timeline) AS timeline FROM timelines WHERE timeline * 16777216 <= 167772160")
def at(t: DataFrame) -> DataFrame:
    return g.timeline_at(t, "0/A000000")


@query("g5_timeline_tree", "timelines", sql=f"{PATHS} SELECT string_agg(lpad(ancestor::VARCHAR, 10, '0'), '/' ORDER BY depth DESC) AS path, repeat('  ', max(depth)::BIGINT) || 'timeline ' || timeline AS line FROM up GROUP BY timeline")
def tree(t: DataFrame) -> DataFrame:
    return g.timeline_tree(t)


@query("g6_backup_chain", "toc", sql="RECURSIVE up AS (SELECT dump_id AS id, dump_id AS link, depends_on AS base_id, 0 AS depth FROM toc UNION ALL SELECT u.id, t.dump_id, t.depends_on, u.depth + 1 FROM up u JOIN toc t ON t.dump_id = u.base_id) SELECT id, link, depth FROM up")
def backup_chain(t: DataFrame) -> DataFrame:
    return g.base_chain(t.select(F.col("dump_id").alias("id"), F.col("depends_on").alias("base_id")), F.lit(True))


def _lines(f: DataFrame) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 10 == 0, F.concat(F.lit("USE db"), (F.floor(n / 10) % 3).cast("string"), F.lit(";"))).when(n % 10 == 1, "# comment").when(n % 10 == 2, "ALTER TABLE t1 ADD c int;").when(n % 10 == 3, "INSERT INTO db1.t2 VALUES (1);").when(n % 10 == 4, "update `t3` set a = 1;").when(n % 10 == 5, F.when(n % 20 == 5, "USE INDEX (i1)").otherwise("COMMIT;")).otherwise(F.concat(F.lit("DELETE FROM t"), (n % 4).cast("string"), F.lit(" WHERE id = 1;")))
    return f.select(F.floor(n / 1000).cast("long").alias("stream"), n.alias("line_no"), text.alias("line"))


@query("f5_log_filter", "events_raw", sql="""
l AS (SELECT event_id // 1000 AS stream, event_id AS line_no, CASE event_id % 10 WHEN 0 THEN 'u' WHEN 1 THEN 'c' WHEN 2 THEN 'd' WHEN 3 THEN 'db1.t2' WHEN 4 THEN 't3' WHEN 5 THEN 'x' ELSE 't' || event_id % 4 END AS k, CASE WHEN event_id % 10 = 0 THEN 'db' || (event_id // 10) % 3 END AS used FROM events),
d AS (SELECT *, coalesce(last_value(used IGNORE NULLS) OVER (PARTITION BY stream ORDER BY line_no), '') AS db FROM l), n AS (SELECT *, CASE WHEN k IN ('u', 'c', 'x', 'd') THEN NULL WHEN k LIKE '%.%' THEN k ELSE db || '.' || k END AS tab FROM d)
SELECT stream, line_no, tab AS "table", CASE WHEN k IN ('u', 'c', 'x') THEN true WHEN line_no % 10 = 2 THEN false ELSE tab IN ('db1.t2', 'db0.t3', 'db2.t0', 'db1.t1') END AS keep FROM n""")
def log_filter(e: DataFrame) -> DataFrame:
    return g.filter_lines(_lines(e), include=["db1.t2", "db0.t3", "db2.t0", "DB1.t1"], skip_ddl=True)


@query("x15_log_headers", "events_raw", sql="""
l AS (SELECT event_id // 100 AS stream, event_id AS line_no, date_trunc('second', ts) AS ats, event_id * 7 AS e, user_id % 3 + 1 AS s, CASE WHEN event_id % 5 = 0 THEN 'uuid:' || event_id END AS gt FROM events)
SELECT stream, min(struct_pack(a := line_no, b := ats)).b AS start_time, max(struct_pack(a := line_no, b := ats)).b AS end_time, min(struct_pack(a := line_no, b := s)).b AS server_id, min(struct_pack(a := line_no, b := e)).b AS first_pos, max(e) AS last_pos, max(CASE WHEN gt IS NOT NULL THEN struct_pack(a := line_no, b := gt) END).b AS gtid FROM l GROUP BY stream""")
def headers(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    line = F.concat(F.lit("#"), F.date_format("ts", "yyMMdd HH:mm:ss"), F.lit(" server id "), (F.col("user_id") % 3 + 1).cast("string"), F.lit("  end_log_pos "), (n * 7).cast("string"), F.when(n % 5 == 0, F.concat(F.lit(" SET @@SESSION.GTID_NEXT= 'uuid:"), n.cast("string"), F.lit("'"))).otherwise(""))
    out = g.log_headers(e.select(F.floor(n / 100).cast("long").alias("stream"), n.alias("line_no"), line.alias("line")))
    return out.withColumn("first_pos", F.col("first_pos").cast("long")).withColumn("last_pos", F.col("last_pos").cast("long"))


def _targets(t: DataFrame) -> DataFrame:
    n = F.col("table_id")
    kind = F.when(n % 6 == 0, "time").when(n % 6 == 1, "xid").when(n % 6 == 2, "lsn").when(n % 6 == 3, "name").when(n % 6 == 4, "immediate").otherwise("bogus")
    value = F.when(n % 6 == 0, F.when(n % 12 == 0, "2024-01-02 03:04:05").otherwise("yesterday")).when(n % 6 == 1, F.when(n % 4 == 1, n.cast("string")).otherwise("12x")).when(n % 6 == 2, F.when(n % 4 == 2, "0/3000000").otherwise("03000000")).when(n % 6 == 3, F.when(n % 4 == 3, "before").otherwise("")).otherwise("")
    return t.select(n.alias("id"), kind.alias("type"), value.alias("value"), F.when(n % 7 == 0, "restart").otherwise("promote").alias("action"), F.when(n % 2 == 0, "").otherwise("3").alias("timeline"), (n % 3 == 0).alias("inclusive"))


@query("x13_target_errors", "tables", sql="SELECT table_id AS id, concat_ws(',', CASE WHEN table_id % 6 = 5 THEN 'type' END, CASE WHEN table_id % 6 = 5 OR (table_id % 6 = 3 AND table_id % 4 <> 3) THEN 'empty' END, CASE WHEN table_id % 6 = 0 AND table_id % 12 <> 0 THEN 'time' END, CASE WHEN table_id % 6 = 1 AND table_id % 4 <> 1 THEN 'xid' END, CASE WHEN table_id % 6 = 2 AND table_id % 4 <> 2 THEN 'lsn' END, CASE WHEN table_id % 7 = 0 THEN 'action' END) AS errors FROM tables")
def target_errors(t: DataFrame) -> DataFrame:
    return _targets(t).select("id", F.array_join(g.target_errors(F.col("type"), F.col("value"), F.col("action")), ",").alias("errors"))


@query("x14_target_config", "tables", sql="SELECT table_id AS id, unnest(list_filter([CASE table_id % 6 WHEN 1 THEN 'recovery_target_xid' WHEN 4 THEN 'recovery_target' END, CASE WHEN true THEN 'recovery_target_action' END, 'recovery_target_timeline', CASE WHEN table_id % 6 = 1 THEN 'recovery_target_inclusive' END], lambda x: x IS NOT NULL)) AS key FROM tables WHERE table_id % 6 IN (1, 4)")
def target_config(t: DataFrame) -> DataFrame:
    return g.target_config(_targets(t).where("type in ('xid', 'immediate')")).select("id", "key")


@query("t9_choose_node", "nodes", sql="r AS (SELECT *, CASE WHEN role = 'replica' AND available AND lag <= 5000 THEN 0 WHEN role = 'primary' AND available THEN 1 END AS rank FROM nodes) SELECT cluster, node_id, host, rank = 1 AS fell_back FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY rank, lag, node_id) = 1")
def choose(n: DataFrame) -> DataFrame:
    return g.choose_node(n, 5000)


@query("t9_choose_by_priority", "nodes", sql="r AS (SELECT *, CASE WHEN role = 'replica' AND available AND lag <= 5000 THEN 0 WHEN role = 'primary' AND available THEN 1 END AS rank FROM nodes) SELECT cluster, node_id, host, rank = 1 AS fell_back FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY rank, priority, node_id) = 1")
def choose_priority(n: DataFrame) -> DataFrame:
    return g.choose_node(n, 5000, "priority")
