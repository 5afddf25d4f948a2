"""The estate's tables as the operators expect them, made from the supplied star-schema tables; and the same in DuckDB SQL.

Every mapping is synthetic. AS_OF is the reference time of order-based views, EVENTS_AS_OF that of event-based ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def backups(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    key = F.col("o_orderkey")
    open_ = F.when(key % 10 == 0, "deleted").when(key % 10 < 8, "completed").otherwise("failed")
    checked = F.col("o_orderstatus") == "O"
    return o.join(c, "o_custkey").select(
        key.alias("id"),
        F.col("c_mktsegment").alias("database"),
        F.when(F.col("o_custkey") % 3 == 0, "postgresql").when(F.col("o_custkey") % 3 == 1, "mysql").otherwise("mariadb").alias("database_type"),
        F.concat(F.lit("host"), F.col("c_nationkey").cast("string")).alias("host"),
        F.when(key % 4 == 0, "full").otherwise("incremental").alias("backup_type"),
        (F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long") * 1024).alias("size_bytes"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        (F.col("o_totalprice") / 1000).alias("duration"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(checked, "verified").otherwise(open_).alias("status"),
        F.when(checked, F.expr("o_orderdate + interval 1 day")).cast("timestamp_ntz").alias("verified_at"),
        F.when(checked, key % 20 != 0).alias("verify_valid"),
        F.when(key % 50 == 0, F.expr("o_orderdate + interval 7 days")).cast("timestamp_ntz").alias("drill_tested_at"),
        F.when(key % 50 == 0, key % 100 == 0).alias("drill_success"),
        (key % 2 == 1).alias("encrypted"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "none").when(F.substring("o_orderpriority", 1, 1).isin("3", "4"), "gzip").otherwise("zstd").alias("compression"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("s3://bucket/"), key.cast("string"))).alias("cloud_location"),
        F.when(key % 3 != 0, F.sha2(key.cast("string"), 256)).alias("sha256"),
        F.concat(F.lit("/b/"), "c_mktsegment", F.lit("/"), key.cast("string")).alias("backup_path"),
    )


SQL: dict[str, str] = {}
SQL["backups"] = """
SELECT o_orderkey AS id, c_mktsegment AS database, CASE o_custkey % 3 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' ELSE 'mariadb' END AS database_type, 'host' || c_nationkey AS host,
  CASE WHEN o_orderkey % 4 = 0 THEN 'full' ELSE 'incremental' END AS backup_type, floor(o_totalprice * 100 + 0.5)::BIGINT * 1024 AS size_bytes, o_orderdate AS created_at, o_totalprice / 1000 AS duration,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'verified' ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' WHEN o_orderkey % 10 < 8 THEN 'completed' ELSE 'failed' END END AS status,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END AS verified_at, CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 20 <> 0 END AS verify_valid,
  CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate + INTERVAL 7 DAY END AS drill_tested_at, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 100 = 0 END AS drill_success, o_orderkey % 2 = 1 AS encrypted,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'none' WHEN left(o_orderpriority, 1) IN ('3', '4') THEN 'gzip' ELSE 'zstd' END AS compression,
  CASE WHEN o_custkey % 2 = 0 THEN 's3://bucket/' || o_orderkey END AS cloud_location, CASE WHEN o_orderkey % 3 <> 0 THEN sha256(o_orderkey::VARCHAR) END AS sha256, '/b/' || c_mktsegment || '/' || o_orderkey AS backup_path
FROM orders JOIN customer ON c_custkey = o_custkey"""


def oplog(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("db"), (F.col("user_id") % 20).cast("string")).alias("database"),
        F.when(kind == "purchase", "backup_completed").when(kind == "error", "backup_failed").when(kind == "signup", "backup_started").when(kind == "click", "restore_completed").otherwise("verify_completed").alias("type"),
        F.when(kind == "error", "error").when(kind == "signup", "warning").otherwise("info").alias("severity"), F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"), F.col("value").alias("duration_s"),
    )


SQL["oplog"] = """
SELECT event_id AS id, ts, 'db' || user_id % 20 AS database, CASE event_type WHEN 'purchase' THEN 'backup_completed' WHEN 'error' THEN 'backup_failed' WHEN 'signup' THEN 'backup_started' WHEN 'click' THEN 'restore_completed' ELSE 'verify_completed' END AS type,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity, 'host' || user_id % 5 AS host, value AS duration_s FROM events"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("long").alias("delta"))


SQL["samples"] = "SELECT user_id AS key, ts, event_id AS seq, floor(value * 1000)::BIGINT AS delta FROM events"


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").withColumn("number", F.floor(F.col("event_id") / 100).cast("long"))
    g = e.where("number % 7 <> 3").groupBy("number").agg(F.min("ts").cast("timestamp_ntz").alias("start_time"), F.max("ts").cast("timestamp_ntz").alias("end_time"), F.sum(F.octet_length("props")).cast("long").alias("size"))
    return g.select(F.format_string("mysql-bin.%06d", "number").alias("name"), "number", "size", "start_time", "end_time", (F.col("number") * 1000 + 4).alias("start_pos"), (F.col("number") * 1000 + 4 + F.col("size")).alias("end_pos"), F.when(F.col("number") < 60, 1).otherwise(2).cast("long").alias("server_id"))


SQL["log_files"] = """
SELECT format('mysql-bin.{:06d}', number) AS name, number, size, start_time, end_time, number * 1000 + 4 AS start_pos, number * 1000 + 4 + size AS end_pos, CASE WHEN number < 60 THEN 1 ELSE 2 END::BIGINT AS server_id FROM
  (SELECT event_id // 100 AS number, min(ts) AS start_time, max(ts) AS end_time, sum(octet_length(encode(props)))::BIGINT AS size FROM events GROUP BY 1) WHERE number % 7 <> 3"""


def iterations(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("duration_sec"), (F.col("event_id") % 10 != 0).alias("success"), F.col("event_id").alias("iteration"), F.col("ts").cast("timestamp_ntz").alias("ts"))


SQL["iterations"] = "SELECT event_type AS phase, value AS duration_sec, event_id % 10 <> 0 AS success, event_id AS iteration, ts FROM events"


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("data"), F.col("source").alias("grp"))
    return d.unionByName(read(spark, folder, "pages").select((F.col("page_id") + 1_000_000_000).alias("blob_id"), F.encode("html", "UTF-8").alias("data"), F.lit("pages").alias("grp")))


SQL["blobs"] = "SELECT doc_id AS blob_id, encode(text) AS data, source AS grp FROM documents UNION ALL SELECT page_id + 1000000000, encode(html), 'pages' FROM pages"


def chunk_refs(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return d.select(F.col("doc_id").alias("manifest"), F.col("source").alias("database"), F.col("seq").cast("long").alias("seq"), F.sha2(F.col("line").cast("binary"), 256).alias("hash"), F.octet_length("line").cast("long").alias("length"))


SQL["chunk_refs"] = """
SELECT doc_id AS manifest, source AS database, (i - 1)::BIGINT AS seq, sha256(l[i]) AS hash, strlen(l[i])::BIGINT AS length FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""


def chunk_store(spark: SparkSession, folder: str) -> DataFrame:
    c = chunk_refs(spark, folder).groupBy("hash").agg(F.max("length").alias("length"))
    return c.where(~F.col("hash").startswith("0")).select("hash", (F.col("length") + F.col("hash").startswith("1").cast("long")).alias("length"), F.floor(F.col("length") * 6 / 10).cast("long").alias("stored"))


SQL["chunk_store"] = """
SELECT hash, length + CASE WHEN hash LIKE '1%' THEN 1 ELSE 0 END AS length, floor(length * 6 / 10)::BIGINT AS stored FROM (SELECT hash, max(length) AS length FROM (SELECT sha256(l) AS hash, strlen(l)::BIGINT AS length FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY hash) WHERE hash NOT LIKE '0%'"""


def tables_src(spark: SparkSession, folder: str) -> DataFrame:
    li = read(spark, folder, "lineitem")
    return li.groupBy(F.concat_ws(".", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("name")).agg(F.count("*").alias("row_count"), F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("checksum"))


SQL["tables_src"] = "SELECT concat_ws('.', l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS name, count(*) AS row_count, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS checksum FROM lineitem GROUP BY 1"


def tables_dst(spark: SparkSession, folder: str) -> DataFrame:
    s = tables_src(spark, folder).where("name <> 'A.F.1'").withColumn("row_count", F.when(F.col("name") == "N.O.2", F.col("row_count") - 1).otherwise(F.col("row_count")))
    extra = spark.range(1).select(F.lit("Z.Z.9").alias("name"), F.lit(7).cast("long").alias("row_count"), F.lit(0).cast("long").alias("checksum"))
    return s.unionByName(extra)


SQL["tables_dst"] = "SELECT name, CASE WHEN name = 'N.O.2' THEN row_count - 1 ELSE row_count END AS row_count, checksum FROM tables_src WHERE name <> 'A.F.1' UNION ALL SELECT 'Z.Z.9', 7, 0"


def timelines(spark: SparkSession, folder: str) -> DataFrame:
    n = read(spark, folder, "nation").where("n_nationkey >= 1").select(F.col("n_nationkey").cast("long").alias("timeline"))
    return n.select("timeline", F.when(F.col("timeline") > 1, F.floor(F.col("timeline") / 2)).otherwise(0).cast("long").alias("parent"), F.concat(F.lit("0/"), F.hex(F.col("timeline") * 16777216)).alias("switch_lsn"))


SQL["timelines"] = "SELECT n_nationkey::BIGINT AS timeline, CASE WHEN n_nationkey > 1 THEN n_nationkey // 2 ELSE 0 END::BIGINT AS parent, '0/' || hex(n_nationkey::BIGINT * 16777216) AS switch_lsn FROM nation WHERE n_nationkey >= 1"


def toc(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part").where("p_partkey >= 1")
    return p.select(F.col("p_partkey").alias("dump_id"), F.col("p_name").alias("tag"), F.col("p_brand").alias("namespace"), (F.col("p_size") % 3).alias("section"), F.floor(F.col("p_partkey") / 3).cast("long").alias("depends_on"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("data_length"))


SQL["toc"] = "SELECT p_partkey AS dump_id, p_name AS tag, p_brand AS namespace, p_size % 3 AS section, p_partkey // 3 AS depends_on, floor(p_retailprice * 100 + 0.5)::BIGINT AS data_length FROM part WHERE p_partkey >= 1"


def dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    p, k = read(spark, folder, "part"), F.col("p_partkey")
    table = F.concat(F.lit("t"), (k % 97).cast("string"))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("CREATE TABLE public."), table, F.lit(" (id int, name text);")))
        .when(k % 6 == 1, F.concat(F.lit("COPY public."), table, F.lit(" (id, name) FROM stdin;")))
        .when(k % 6 == 2, F.concat(F.lit("CREATE UNIQUE INDEX i"), k.cast("string"), F.lit(" ON public."), table, F.lit(" USING "), F.when(k % 4 == 0, "btree").when(k % 4 == 2, "gin").otherwise("hash"), F.lit(" (id);")))
        .when(k % 6 == 3, F.concat(F.lit("ALTER TABLE ONLY public."), table, F.lit(" ADD CONSTRAINT c"), k.cast("string"), F.when(k % 4 == 1, " PRIMARY KEY (id);").otherwise(" FOREIGN KEY (id) REFERENCES public.t1(id);")))
        .when(k % 6 == 4, F.lit("SET statement_timeout = 0;"))
        .otherwise(F.concat(F.lit("INSERT INTO "), table, F.lit(" VALUES ("), k.cast("string"), F.lit(", '"), "p_type", F.lit("');")))
    )
    return p.select(k.alias("line_no"), text.alias("line"))


SQL["dump_lines"] = """
SELECT p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN 'CREATE TABLE public.t' || p_partkey % 97 || ' (id int, name text);' WHEN 1 THEN 'COPY public.t' || p_partkey % 97 || ' (id, name) FROM stdin;'
  WHEN 2 THEN 'CREATE UNIQUE INDEX i' || p_partkey || ' ON public.t' || p_partkey % 97 || ' USING ' || CASE p_partkey % 4 WHEN 0 THEN 'btree' WHEN 2 THEN 'gin' ELSE 'hash' END || ' (id);'
  WHEN 3 THEN 'ALTER TABLE ONLY public.t' || p_partkey % 97 || ' ADD CONSTRAINT c' || p_partkey || CASE WHEN p_partkey % 4 = 1 THEN ' PRIMARY KEY (id);' ELSE ' FOREIGN KEY (id) REFERENCES public.t1(id);' END
  WHEN 4 THEN 'SET statement_timeout = 0;' ELSE 'INSERT INTO t' || p_partkey % 97 || ' VALUES (' || p_partkey || ', ''' || p_type || ''');' END AS line FROM part"""


def tables(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("schema"), F.col("p_type").alias("name"), (F.col("p_size").cast("long") * 1000).alias("row_count"), (F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long") * F.col("p_size") * 4096).alias("size_bytes"))


SQL["tables"] = "SELECT p_partkey AS table_id, p_brand AS schema, p_type AS name, p_size::BIGINT * 1000 AS row_count, floor(p_retailprice * 100 + 0.5)::BIGINT * p_size * 4096 AS size_bytes FROM part"


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    s = read(spark, folder, "supplier")
    return s.select(F.col("s_suppkey").alias("node_id"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("host"), F.col("s_nationkey").cast("long").alias("cluster"), F.when(F.col("s_suppkey") % 5 == 0, "primary").otherwise("replica").alias("role"), F.abs("s_acctbal").alias("lag"), (F.col("s_suppkey") % 7).alias("priority"), (F.col("s_suppkey") % 4 != 0).alias("available"))


SQL["nodes"] = "SELECT s_suppkey AS node_id, 'n' || s_suppkey AS host, s_nationkey::BIGINT AS cluster, CASE WHEN s_suppkey % 5 = 0 THEN 'primary' ELSE 'replica' END AS role, abs(s_acctbal) AS lag, s_suppkey % 7 AS priority, s_suppkey % 4 <> 0 AS available FROM supplier"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """What stands on disk: paths of backups, some gone, some of another size, and some strangers."""
    b = backups(spark, folder).where("id % 11 <> 0").select(F.col("backup_path").alias("path"), (F.col("size_bytes") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("size"), F.col("created_at").alias("modified_at"))
    strangers = read(spark, folder, "part").where("p_partkey % 9 = 0").select(F.concat(F.lit("/b/stray/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("size"), F.lit(AS_OF).cast("timestamp_ntz").alias("modified_at"))
    return b.unionByName(strangers)


SQL["files"] = f"SELECT backup_path AS path, size_bytes + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS size, created_at AS modified_at FROM backups WHERE id % 11 <> 0 UNION ALL SELECT '/b/stray/' || p_partkey, p_partkey, TIMESTAMP '{AS_OF}' FROM part WHERE p_partkey % 9 = 0"

def events_raw(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (backups, oplog, samples, log_files, iterations, blobs, chunk_refs, chunk_store, tables_src, tables_dst, timelines, toc, dump_lines, tables, nodes, files, events_raw)}
#: Views whose SQL reads other views.
NEEDS = {"tables_dst": ("tables_src",), "files": ("backups",)}
