"""Queries on chunks and binary objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blobs as b
from ..operators import chunks as c
from .registry import query

NEW = "nc AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY manifest, seq) = 1 AS is_new FROM chunk_refs)"


@query("h3_sha256", "blobs", sql="SELECT blob_id, sha256(data) AS hash FROM blobs")
def sha256(x: DataFrame) -> DataFrame:
    return x.select("blob_id", F.sha2("data", 256).alias("hash"))


@query("h4_new_chunks", "chunk_refs", sql=f"{NEW} SELECT manifest, count(*) AS chunks, sum(length)::BIGINT AS bytes, count(*) FILTER (is_new) AS new_chunks, sum(CASE WHEN is_new THEN length ELSE 0 END)::BIGINT AS new_bytes, round(CASE WHEN sum(length) > 0 THEN 1 - sum(CASE WHEN is_new THEN length ELSE 0 END)::DOUBLE / sum(length) ELSE 0 END, 6) AS dedup_ratio FROM nc GROUP BY manifest")
def new_chunks(r: DataFrame) -> DataFrame:
    return c.manifest_totals(r)


@query("h6_reference_counts", "chunk_refs", sql="SELECT hash, count(*) AS refs, count(DISTINCT manifest) AS manifests FROM chunk_refs GROUP BY hash")
def references(r: DataFrame) -> DataFrame:
    return c.references(r)


@query("j5_orphan_chunks", "chunk_store", "chunk_refs", sql="SELECT hash, length FROM chunk_store WHERE hash NOT IN (SELECT hash FROM chunk_refs WHERE database <> 'src3')")
def orphans(s: DataFrame, r: DataFrame) -> DataFrame:
    """Once a database's manifests are gone."""
    return c.orphans(s, r.where("database <> 'src3'")).select("hash", "length")


@query("h7_garbage", "chunk_store", "chunk_refs", sql="SELECT count(*) AS chunks, coalesce(sum(stored), 0)::BIGINT AS freed FROM chunk_store WHERE hash NOT IN (SELECT hash FROM chunk_refs WHERE database <> 'src3')")
def garbage(s: DataFrame, r: DataFrame) -> DataFrame:
    """Once a database's manifests are gone."""
    return c.garbage(s, r.where("database <> 'src3'"))


@query("r8_manifest_prune", "chunk_store", "chunk_refs", sql="kept AS (SELECT * FROM chunk_refs WHERE manifest IN (SELECT manifest FROM chunk_refs GROUP BY manifest, database QUALIFY row_number() OVER (PARTITION BY database ORDER BY manifest DESC) <= 20)) SELECT (SELECT count(DISTINCT manifest) FROM kept) AS manifests_kept, count(*) AS chunks, coalesce(sum(stored), 0)::BIGINT AS freed FROM chunk_store WHERE hash NOT IN (SELECT hash FROM kept)")
def manifest_prune(s: DataFrame, r: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    each = r.select("manifest", "database").distinct()
    kept = each.withColumn("n", F.row_number().over(Window.partitionBy("database").orderBy(F.col("manifest").desc()))).where("n <= 20")
    used = r.join(kept.select("manifest", "database"), ["manifest", "database"], "left_semi")
    return c.garbage(s, used).join(F.broadcast(kept.agg(F.count("*").alias("manifests_kept"))))


@query("j4_verify_chunks", "chunk_refs", "chunk_store", sql="SELECT manifest, r.hash, CASE WHEN s.length IS NULL THEN 'missing' WHEN s.length <> r.length THEN 'size_mismatch' ELSE 'ok' END AS state FROM (SELECT DISTINCT manifest, hash, length FROM chunk_refs) r LEFT JOIN chunk_store s ON s.hash = r.hash")
def verify(r: DataFrame, s: DataFrame) -> DataFrame:
    return c.verify(r, s)


@query("a11_index_stats", "chunk_store", sql="SELECT count(*) AS chunks, sum(length)::BIGINT AS bytes, sum(stored)::BIGINT AS stored, round(1 - sum(stored)::DOUBLE / sum(length), 6) AS ratio, (sum(length) - sum(stored))::BIGINT AS saved FROM chunk_store")
def index_stats(s: DataFrame) -> DataFrame:
    return c.index_stats(s)


@query("a12_database_stats", "chunk_refs", sql="p AS (SELECT CASE WHEN database IN ('src1', 'src2') THEN '_default' ELSE database END AS database, hash, count(*) AS n, max(length) AS length, sum(length) AS bytes FROM chunk_refs GROUP BY 1, 2) SELECT database, sum(n)::BIGINT AS refs, count(*) AS chunks, sum(bytes)::BIGINT AS bytes, sum(length)::BIGINT AS unique_bytes, round(CASE WHEN sum(bytes) > 0 THEN 1 - sum(length)::DOUBLE / sum(bytes) ELSE 0 END, 6) AS dedup_ratio FROM p GROUP BY database")
def database_stats(r: DataFrame) -> DataFrame:
    return c.database_stats(r.withColumn("database", F.when(F.col("database") == "src1", " ").when(F.col("database") != "src2", F.col("database"))))


@query("w10_split_layout", "blobs", sql="SELECT blob_id, stream, size, coalesce(sum(size) OVER (PARTITION BY stream ORDER BY blob_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT blob_id, (blob_id % 4)::INT AS stream, octet_length(data)::BIGINT AS size FROM blobs)")
def split_layout(x: DataFrame) -> DataFrame:
    return c.split_layout(x, 4)


@query("h2_chunk", "blobs")
def chunk(x: DataFrame) -> DataFrame:
    return c.chunk(x).drop("data")


@query("h8_restore", "blobs")
def restore(x: DataFrame) -> DataFrame:
    return c.restore(c.chunk(x)).select("source_id", F.sha2("data", 256).alias("hash"), "ok")


@query("a13_blob_sizes", "blobs", sql="SELECT grp, count(*) AS n, count(data) AS values, coalesce(sum(s), 0)::BIGINT AS bytes, round(avg(s), 6) AS mean, max(s) AS largest, min(s) AS smallest, count(*) FILTER (s < 102400) AS small, count(*) FILTER (s >= 1048576) AS large FROM (SELECT grp, data, octet_length(data)::BIGINT AS s FROM blobs) GROUP BY grp")
def sizes(x: DataFrame) -> DataFrame:
    return b.size_stats(x, ["grp"])


@query("a33_blob_summary", "blobs", sql="SELECT count(DISTINCT grp) AS columns, count(*) AS n, sum(octet_length(data))::BIGINT AS bytes FROM blobs")
def blob_summary(x: DataFrame) -> DataFrame:
    return b.size_stats(x, ["grp"]).agg(F.count("*").alias("columns"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query("x20_blob_strategy", "blobs", sql="s AS (SELECT grp, count(data) AS v, sum(octet_length(data)) AS t, count(*) FILTER (octet_length(data) < 102400) AS sm, count(*) FILTER (octet_length(data) >= 1048576) AS lg FROM blobs GROUP BY grp) SELECT grp, CASE WHEN v = 0 THEN 'standard' WHEN grp = 'src3' THEN 'large_object' WHEN sm > 0 AND sm / v > 0.7 THEN 'bundle' WHEN lg > 0 AND (lg / v > 0.5 OR t > 524288000) THEN 'parallel_stream' WHEN t > 104857600 THEN 'parallel_stream' ELSE 'standard' END AS strategy FROM s")
def blob_strategy(x: DataFrame) -> DataFrame:
    s = b.size_stats(x, ["grp"])
    return s.select("grp", b.strategy(s, F.col("grp") == "src3").alias("strategy"))


@query("a15_registry_stats", "blobs", sql="g AS (SELECT sha256(data) AS h, count(*) AS n, max(octet_length(data)) AS s FROM blobs GROUP BY 1) SELECT sum(n)::BIGINT AS checked, count(*) AS unique, sum(n - 1)::BIGINT AS duplicates, sum((n - 1) * s)::BIGINT AS saved FROM g")
def registry(x: DataFrame) -> DataFrame:
    return b.registry_stats(x)


@query("h5_duplicates", "blobs", sql="SELECT sha256(data) AS hash, count(*) AS n, min(blob_id) AS first_id FROM blobs GROUP BY 1 HAVING count(*) > 1")
def duplicates(x: DataFrame) -> DataFrame:
    return x.groupBy(F.sha2("data", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("blob_id").alias("first_id")).where("n > 1")


@query("x16_character_entropy", "blobs", sql="c AS (SELECT blob_id, list_aggregate(string_split(decode(data), ''), 'entropy') AS e FROM blobs) SELECT blob_id, round(e, 6) AS entropy FROM c")
def entropy(x: DataFrame) -> DataFrame:
    # counts of characters in one map, without a row for each
    chars = F.split(F.decode("data", "UTF-8"), "")
    ones = x.select("blob_id", F.explode(chars).alias("ch")).groupBy("blob_id", "ch").agg(F.count("*").alias("k"))
    g = ones.groupBy("blob_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return g.select("blob_id", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


#: The entropy of at most the first 4096 bytes, by their pairs of hexadecimal digits.
_ENTROPY = "be AS (SELECT blob_id, grp, octet_length(data) AS n, coalesce(list_aggregate(list_transform(range(0, least(octet_length(data), 4096)), lambda i: x[2 * i + 1:2 * i + 2]), 'entropy'), 0) AS e, x[1:40] AS h, data FROM (SELECT *, hex(data) AS x FROM blobs))"


@query("x16_byte_entropy", "blobs", sql=f"{_ENTROPY} SELECT blob_id, round(e, 6) AS entropy FROM be")
def byte_entropy(x: DataFrame) -> DataFrame:
    return x.select("blob_id", F.round(b.entropy_of(F.col("data")), 6).alias("entropy"))


_HEAD = "hex(data)"
_CASES = " ".join(f"WHEN starts_with(h[{2 * s[1] + 1}:], '{s[0]}')" + (f" AND h[17:24] = '{s[2]}'" if s[2] else "") + f" THEN '{s[3]}'" for s in b.SIGNATURES)
_FORMATS = " ".join(f"WHEN starts_with(h[{2 * s[1] + 1}:], '{s[0]}')" + (f" AND h[17:24] = '{s[2]}'" if s[2] else "") + f" THEN '{s[3]}'" for s in b.NAMED)


@query("x17_signature_type", "blobs", sql=f"h AS (SELECT blob_id, octet_length(data) AS n, hex(data)[1:40] AS h FROM blobs) SELECT blob_id, CASE WHEN n < 16 THEN 'unknown' {_CASES} ELSE 'none' END AS type, CASE WHEN n < 4 THEN 'unknown' {_FORMATS} ELSE 'unknown' END AS format FROM h")
def signature(x: DataFrame) -> DataFrame:
    # an entropy of null leaves what no signature tells as binary
    kind = F.when(b.type_of(F.col("data"), F.lit(99.0)) != b.type_of(F.col("data"), F.lit(0.0)), "none").otherwise(b.type_of(F.col("data"), F.lit(0.0)))
    return x.select("blob_id", kind.alias("type"), b.format_of(F.col("data")).alias("format"))


_TYPE = f"CASE WHEN coalesce(n, 0) < 16 THEN 'unknown' {_CASES} WHEN e > 7.5 THEN 'compressed' WHEN e < 4.5 THEN 'text' ELSE 'binary' END"


@query("a14_type_histogram", "blobs", sql=f"{_ENTROPY}, t AS (SELECT {_TYPE} AS type, CASE WHEN n < 4 THEN 'unknown' {_FORMATS} ELSE 'unknown' END AS format, n FROM be) SELECT type, format, count(*) AS n, sum(n)::BIGINT AS bytes, CASE WHEN type = 'compressed' THEN sum(n)::BIGINT ELSE 0 END AS skipped_bytes FROM t GROUP BY type, format")
def histogram(x: DataFrame) -> DataFrame:
    return b.histogram(x)


@query("x19_level", "blobs", sql=f"h AS (SELECT blob_id, octet_length(data) AS n, hex(data)[1:40] AS h FROM blobs), t AS (SELECT blob_id, CASE WHEN n < 16 THEN 'unknown' {_CASES} ELSE 'text' END AS t FROM h) SELECT blob_id, CASE WHEN t = 'compressed' THEN 0 WHEN t IN ('text', 'database') THEN 9 WHEN t = 'binary' THEN 3 ELSE 6 END AS level, t <> 'compressed' AS should_compress FROM t")
def level(x: DataFrame) -> DataFrame:
    kind = b.type_of(F.col("data"), F.lit(0.0))
    return x.select("blob_id", b.level_of(kind).alias("level"), (kind != "compressed").alias("should_compress"))


@query("a16_column_analysis", "blobs")
def columns(x: DataFrame) -> DataFrame:
    return b.column_analysis(x, ["grp"]).withColumn("ratio", F.round("ratio", 6))


ADVICE = """
cc AS (SELECT schema AS name, sum(size_bytes)::BIGINT AS total_size, sum(CASE WHEN table_id % 5 < table_id % 7 THEN size_bytes ELSE 0 END)::BIGINT AS incompressible, 1 + count(*) / 60.0 AS ratio FROM tables GROUP BY schema),
ca AS (SELECT *, CASE WHEN total_size = 0 THEN 'unknown' WHEN 100.0 * incompressible::DOUBLE / total_size > 80 OR ratio < 1.1 THEN 'skip' WHEN 100.0 * incompressible::DOUBLE / total_size > 50 THEN 'low_level' WHEN 100.0 * incompressible::DOUBLE / total_size > 20 THEN 'partial' ELSE 'compress' END AS advice FROM cc)"""


def advised(t: DataFrame) -> DataFrame:
    g = t.groupBy(F.col("schema").alias("name")).agg(F.sum("size_bytes").alias("total_size"), F.sum(F.when(F.col("table_id") % 5 < F.col("table_id") % 7, F.col("size_bytes")).otherwise(0)).alias("incompressible"), (1 + F.count("*") / 60.0).alias("ratio"))
    return g.withColumn("advice", b.column_advice(F.col("total_size"), F.col("incompressible"), F.col("ratio")))


@query("x21_column_advice", "tables", sql=f"{ADVICE} SELECT name, total_size, incompressible, advice FROM ca")
def column_advice(t: DataFrame) -> DataFrame:
    return advised(t).select("name", "total_size", "incompressible", "advice")


@query("a17_database_advice", "tables", sql=f"""{ADVICE},
s AS (SELECT count(*) AS columns, sum(total_size)::BIGINT AS total_size, sum(incompressible)::BIGINT AS incompressible, sum(CASE WHEN advice = 'skip' THEN total_size ELSE 0 END)::BIGINT AS skipped, count(*) FILTER (advice = 'skip') AS skips, max(struct_pack(s := total_size, n := name)).n AS largest FROM ca),
p AS (SELECT *, CASE WHEN total_size > 0 THEN 100.0 * incompressible::DOUBLE / total_size ELSE 0 END AS sh FROM s),
a AS (SELECT *, round(sh, 6) AS incompressible_pct, CASE WHEN total_size > 0 AND skipped / total_size > 0.6 THEN 'skip' WHEN skips > columns // 2 THEN 'low_level' WHEN sh > 70 THEN 'skip' WHEN sh > 40 THEN 'low_level' WHEN sh > 20 THEN 'partial' ELSE 'compress' END AS advice FROM p)
SELECT columns, total_size, incompressible, skipped, skips, largest, incompressible_pct, advice, CASE advice WHEN 'skip' THEN 0 WHEN 'low_level' THEN 1 WHEN 'partial' THEN 4 ELSE 6 END AS level, CASE WHEN advice = 'skip' THEN incompressible ELSE 0 END AS potential_savings FROM a""")
def database_advice(t: DataFrame) -> DataFrame:
    return b.database_advice(advised(t))


_SPEEDS = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in b.SPEED.items())


@query("x22_time_estimate", "tables", sql=f"m AS (SELECT table_id, size_bytes / 1048576.0::DOUBLE AS mb, table_id % 10 AS level, (table_id % 100) / 100.0::DOUBLE AS sh, CASE table_id % 10 {_SPEEDS} END AS base FROM tables) SELECT table_id, round(base * (1 - sh) + base * 3 * sh, 6) AS mb_per_s, round(mb / 200.0 + CASE WHEN level > 0 THEN mb / (base * (1 - sh) + base * 3 * sh) ELSE 0 END, 6) AS seconds FROM m")
def times(t: DataFrame) -> DataFrame:
    level, share = F.col("table_id") % 10, (F.col("table_id") % 100) / 100.0
    return t.select("table_id", F.round(b.throughput(level, share), 6).alias("mb_per_s"), F.round(b.time_estimate(F.col("size_bytes"), level, share), 6).alias("seconds"))


@query("x23_blob_decisions", "blobs", sql=f"{_ENTROPY}, t AS (SELECT blob_id, {_TYPE} AS type, min(blob_id) OVER (PARTITION BY data) AS first_id FROM be) SELECT blob_id, type, CASE WHEN type = 'compressed' THEN 0 WHEN type IN ('text', 'database') THEN 9 WHEN type = 'binary' THEN 3 ELSE 6 END AS level, CASE WHEN blob_id <> first_id THEN first_id END AS duplicate_of, CASE WHEN blob_id = first_id THEN (blob_id % 4)::INT END AS stream FROM t")
def decisions(x: DataFrame) -> DataFrame:
    return b.decisions(x, 4)


_P4 = "md5('7/' || blob_id)"


@query("p4_blob_sample", "blobs", sql=f"f AS (SELECT blob_id, octet_length(data)::BIGINT AS size, {_P4} AS r FROM blobs ORDER BY r, blob_id LIMIT 200) SELECT blob_id, size FROM (SELECT *, sum(size) OVER (ORDER BY r, blob_id) AS total FROM f) WHERE total <= 1048576")
def sample(x: DataFrame) -> DataFrame:
    """A random sample of at most 200 values and 1 MB, by a digest of the id, so that it doesn't change with partitions: a sampling operator."""
    from pyspark.sql import Window

    few = x.select("blob_id", F.octet_length("data").cast("long").alias("size"), F.md5(F.concat(F.lit("7/"), F.col("blob_id").cast("string")).cast("binary")).alias("r")).orderBy("r", "blob_id").limit(200)
    return few.withColumn("total", F.sum("size").over(Window.orderBy("r", "blob_id"))).where("total <= 1048576").select("blob_id", "size")


_NAMES = " ".join(f"WHEN starts_with(h, '{s[2]}') THEN '{s[0]}'" for s in b.NAMES)
_GOOD = ", ".join(f"'{s[0]}'" for s in (*b.NAMES, *[(n, (), "", g) for n, g in b.LOOKS.values()]) if s[3])


# all values are text, so that bytes above 127 are
@query("x18_byte_profile", "blobs", sql=f"""
x AS (SELECT blob_id, hex(data) AS h, octet_length(data) AS n FROM blobs), y AS (SELECT blob_id, b, count(*) AS k FROM (SELECT blob_id, unnest(list_transform(range(0, n), lambda i: h[2 * i + 1:2 * i + 2])) AS b FROM x) GROUP BY blob_id, b),
c AS (SELECT blob_id, sum(k) AS m, sum(k * k) AS q, sum(CASE WHEN (b >= '20' AND b <> '7F') OR b IN ('09', '0A', '0D') THEN k ELSE 0 END) AS t FROM y GROUP BY blob_id),
p AS (SELECT blob_id, h, coalesce(t::DOUBLE / m, 0) AS ts, coalesce(256.0::DOUBLE * q / m - m, 0) AS cs FROM x LEFT JOIN c USING (blob_id)),
l AS (SELECT *, CASE WHEN ts > 0.85 THEN 'text' WHEN cs < 300 THEN 'random' ELSE 'binary' END AS looks FROM p),
m AS (SELECT *, CASE {_NAMES} WHEN looks = 'text' THEN 'TEXT' WHEN looks = 'random' THEN 'RANDOM/ENCRYPTED' ELSE 'UNKNOWN_BINARY' END AS name FROM l)
SELECT blob_id, round(ts, 6) AS text_share, round(cs, 3) AS chi_square, looks, name, name IN ({_GOOD}) AS compressible FROM m""")
def byte_profile(x: DataFrame) -> DataFrame:
    p = x.select("blob_id", "data", b.byte_profile(F.col("data")).alias("p")).withColumn("looks", b.looks(F.col("p")))
    return p.withColumn("f", b.named_format(F.col("data"), F.col("looks"))).select("blob_id", F.round("p.text_share", 6).alias("text_share"), F.round("p.chi_square", 3).alias("chi_square"), "looks", "f.name", "f.compressible")


@query("s15_object_packs", "blobs", sql="SELECT count(*) AS objects, sum(octet_length(data))::BIGINT AS bytes, sum(blob_id)::BIGINT AS ids FROM blobs")
def packs(x: DataFrame) -> DataFrame:
    """What all packs hold together; the packs' own cuts follow ranges."""
    from ..sources.archives import pack_objects

    p = pack_objects(x)
    e = p.select(F.explode("toc").alias("e"))
    return e.agg(F.count("*").alias("objects"), F.sum("e.length").alias("bytes"), F.sum("e.id").alias("ids"))


@query("s11_archive_round_trip", "blobs", sql="SELECT grp, count(*) AS entries, sum(octet_length(data))::BIGINT AS bytes, min(sha256(data)) AS least_hash FROM blobs GROUP BY grp")
def archives(x: DataFrame) -> DataFrame:
    """Archives of 200 values at most, written to bytes and read again."""
    from ..sources.archives import round_trip

    return round_trip(x).groupBy("grp").agg(F.count("*").alias("entries"), F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.min(F.sha2("data", 256)).alias("least_hash"))


@query("d6_latest_manifest", "chunk_refs", sql="SELECT database, max(manifest) AS manifest, count(*) FILTER (manifest = m) AS refs FROM (SELECT *, max(manifest) OVER (PARTITION BY database) AS m FROM chunk_refs) GROUP BY database")
def latest_manifest(r: DataFrame) -> DataFrame:
    per = r.groupBy("database", "manifest").agg(F.count("*").alias("refs"))
    return per.groupBy("database").agg(F.max(F.struct("manifest", "refs")).alias("m")).select("database", "m.manifest", "m.refs")
