"""Queries that pass through streams, exports and filters, and limits that follow attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blobs as b
from ..operators.chains import scratch
from ..sources import archives
from ..streaming import events
from .registry import query

WHOLE_LOG = "SELECT id, ts, database, type, severity, host, duration_s FROM oplog"


def _arrived(o: DataFrame) -> str:
    """The operational log as files of a new folder."""
    path = scratch(o.sparkSession, "arrived")
    o.write.parquet(path)
    return path


@query("m1_event_stream", "oplog", sql=WHOLE_LOG)
def streamed(o: DataFrame) -> DataFrame:
    spark, out = o.sparkSession, scratch(o.sparkSession, "streamed")
    rows = events.stream(spark, _arrived(o), o.schema)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(o.schema).parquet(out)


@query("m2_watched_files", "oplog", sql="SELECT 1::BIGINT AS times, true AS whole")
def watched(o: DataFrame) -> DataFrame:
    """How often each file that arrives is told, and whether all its bytes are."""
    spark, out, path = o.sparkSession, scratch(o.sparkSession, "watched"), _arrived(o)
    told = events.watch(spark, path, "*.parquet").select("path", "length", F.octet_length("content").alias("held"))
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    seen = spark.read.schema("path string, length long, held int").parquet(out).groupBy("path").agg(F.count("*").alias("n"), F.min(F.col("length") == F.col("held")).alias("whole"))
    return files.join(seen, "path", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("times"), F.coalesce("whole", F.lit(False)).alias("whole")).distinct()


@query("s21_rotated_stream", "oplog", sql=WHOLE_LOG)
def rotated(o: DataFrame) -> DataFrame:
    spark, out = o.sparkSession, scratch(o.sparkSession, "rotated")
    events.write_rotated(events.stream(spark, _arrived(o), o.schema), out, scratch(spark, "progress"), bytes_per_file=16 << 20).awaitTermination()
    return spark.read.schema(o.schema).json(out).select(*o.columns)


@query("s12_exported_tables", "tables_src", "tables_dst", sql="SELECT 'src' AS side, name, row_count, checksum FROM tables_src UNION ALL SELECT 'dst', name, row_count, checksum FROM tables_dst")
def exported(src: DataFrame, dst: DataFrame) -> DataFrame:
    spark, out, tables = src.sparkSession, scratch(src.sparkSession, "exported"), {"src": src, "dst": dst}
    archives.export_tables(spark, tables, out, workers=2)
    src, dst = (spark.read.schema(df.schema).parquet(f"{out}/{side}").select(F.lit(side).alias("side"), "name", "row_count", "checksum") for side, df in tables.items())
    return src.unionByName(dst)


@query("f8_stream_filter", "oplog", sql="SELECT id, ts, database, type, severity, host, duration_s FROM oplog WHERE database IN ('db1', 'db2', 'db7') AND type IN ('backup_completed', 'backup_failed')")
def wanted(o: DataFrame) -> DataFrame:
    return events.wanted(o, databases=("db1", "db2", "db7"), types=("backup_completed", "backup_failed"), ddl=False)


@query("h5_bloom_filter", "blobs", sql="SELECT blob_id, count(*) OVER (PARTITION BY sha256(data)) > 1 AND data IS NOT NULL AS repeated FROM blobs")
def repeated(x: DataFrame) -> DataFrame:
    return b.repeated(x)


@query("m8_host_limits", "oplog", sql="""RECURSIVE a AS (SELECT host, epoch_us(ts) AS t, type <> 'backup_failed' AS ok, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS k FROM oplog),
f AS (
  SELECT host, k, t AS last, CASE WHEN ok THEN 0 ELSE 2 END AS c, 0 AS refused, 0::BIGINT AS waited FROM a WHERE k = 1
  UNION ALL
  SELECT host, k, CASE WHEN s = 2 THEN last ELSE t + wait END, CASE WHEN s = 2 THEN c WHEN ok THEN 0 WHEN s = 1 THEN 2 ELSE c + 2 END, (s = 2)::INT, wait
  FROM (SELECT *, CASE WHEN s > 0 OR c = 0 THEN 0 ELSE greatest(last + least(1000000 * (1 << (c - 1)), 60000000) - t, 0) END::BIGINT AS wait
        FROM (SELECT a.host, a.k, a.t, a.ok, f.last, f.c, CASE WHEN a.t - f.last > 3600000000 THEN 1 WHEN f.c >= 5 THEN 2 ELSE 0 END AS s FROM f JOIN a ON a.host = f.host AND a.k = f.k + 1)))
SELECT host AS key, count(*) AS attempts, sum(refused)::BIGINT AS refused, count(*) FILTER (WHERE waited > 0) AS delayed, round(sum(waited) / 1e6, 3) AS waited_s FROM f GROUP BY host""")
def limits(o: DataFrame) -> DataFrame:
    return events.limited(o.select(F.col("host").alias("key"), "ts", F.col("id").alias("seq"), (F.col("type") != "backup_failed").alias("ok")), reset=3600.0)
