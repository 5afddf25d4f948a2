"""Queries on capacity, cost and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import capacity as c
from .registry import query

GROWTH = """
st AS (SELECT database, created_at, id, size_bytes, (size_bytes - lag(size_bytes) OVER w)::DOUBLE / nullif((epoch(created_at)::BIGINT - epoch(lag(created_at) OVER w)::BIGINT) / 86400.0, 0) AS rate FROM backups WINDOW w AS (PARTITION BY database ORDER BY created_at, id)),
ga AS (SELECT database, count(*) AS n, min(struct_pack(a := created_at, b := id, c := size_bytes)) AS f, max(struct_pack(a := created_at, b := id, c := size_bytes)) AS l, sum(rate) AS r1, sum(rate * rate) AS r2, count(rate) AS rn FROM st GROUP BY database),
gb AS (SELECT *, (epoch(l.a)::BIGINT - epoch(f.a)::BIGINT) / 86400.0 AS dd FROM ga WHERE n >= 2), gc AS (SELECT *, (l.c - f.c) / dd AS daily FROM gb WHERE dd > 0),
growth AS (SELECT database, n, l.c AS current_size, l.a AS newest, round(dd, 6) AS days, round(daily, 6) AS daily_growth, round(CASE WHEN f.c > 0 THEN 100 * daily / f.c ELSE 0 END, 6) AS daily_pct, CASE WHEN n < 5 THEN 'low' WHEN n < 15 THEN 'medium' WHEN sqrt(greatest((r2 - 2 * daily * r1 + rn * daily * daily) / (n - 1), 0)) > abs(daily) * 0.5 THEN 'medium' ELSE 'high' END AS confidence FROM gc)"""


@query("x26_growth", "backups", sql=f"{GROWTH} SELECT * FROM growth")
def growth(b: DataFrame) -> DataFrame:
    return c.growth(b)


@query("x26_forecast", "backups", sql=f"{GROWTH} SELECT database, horizon::INT AS horizon, greatest(current_size + trunc(daily_growth * horizon)::BIGINT, 0) AS predicted_size, greatest(round(CASE confidence WHEN 'high' THEN 95.0 WHEN 'medium' THEN 75.0 ELSE 50.0 END - horizon / 30.0 * 10.0, 6), 30.0)::DOUBLE AS confidence_pct FROM growth, (SELECT unnest([7, 30, 90]) AS horizon)")
def forecast(b: DataFrame) -> DataFrame:
    return c.forecast(c.growth(b), [7, 30, 90])


@query("x27_limit_status", "backups", sql=f"{GROWTH}, k AS (SELECT *, (30000000000 - current_size) / daily_growth AS lft FROM growth) SELECT database, round(100.0 * current_size::DOUBLE / 30000000000, 6) AS used_pct, CASE WHEN current_size >= 30000000000 THEN 'exceeded' WHEN 100.0 * current_size / 30000000000 >= 80 THEN 'approaching' ELSE 'within' END AS status, round(CASE WHEN daily_growth > 0 AND lft > 0 AND lft < 1000 THEN lft END, 6) AS days_to_limit, CASE WHEN daily_growth > 0 AND lft > 0 AND lft < 30 THEN 'critical' WHEN daily_growth > 0 AND lft > 0 AND lft < 90 THEN 'warning' END AS alert FROM k")
def limits(b: DataFrame) -> DataFrame:
    return c.limit_status(c.growth(b), 30_000_000_000)


@query("w5_growth_variance", "backups", sql=f"{GROWTH}, v AS (SELECT database, sqrt(greatest((r2 - 2 * daily * r1 + rn * daily * daily) / (n - 1), 0)) AS s FROM gc) SELECT database, confidence, s > abs(daily_growth) * 0.5 AS unsteady FROM growth JOIN v USING (database)")
def variance(b: DataFrame) -> DataFrame:
    g = c.growth(b)
    return g.select("database", "confidence", (F.col("confidence") == "medium").alias("unsteady"))


_TIERS = ", ".join(f"({k}, '{p}', '{t}', {s}::DOUBLE, {r}::DOUBLE, {d})" for k, (p, t, s, r, d) in enumerate(c.TIERS))
COSTS = f"""
tt AS (SELECT database, sum(size_bytes)::DOUBLE / 1073741824.0 AS gb FROM backups WHERE status <> 'deleted' GROUP BY database), tl(rank, provider, tier, store, got, days) AS (VALUES {_TIERS}),
cost AS (SELECT database, rank::INT AS rank, provider, tier, gb * store AS ms, gb * got AS rt, gb * store + gb * got AS mt, gb * 0.023::DOUBLE AS base, days FROM tt, tl),
costs AS (SELECT database, rank, provider, tier, round(ms, 6) AS monthly_storage, round(rt, 6) AS retrieval, round(mt, 6) AS total_monthly, round(mt * 12, 6) AS total_annual, round(base - mt, 6) AS savings, round(CASE WHEN base > 0 THEN 100 * (base - mt) / base ELSE 0 END, 6) AS savings_pct, CASE WHEN days >= 180 THEN 'long-term archive' WHEN days >= 90 THEN 'compliance archive' WHEN days >= 30 THEN 'recent backups' ELSE 'active backups' END AS best_for FROM cost)"""


def totals(b: DataFrame) -> DataFrame:
    return b.where("status <> 'deleted'").groupBy("database").agg(F.sum("size_bytes").alias("size_bytes"))


@query("j10_tier_costs", "backups", sql=f"{COSTS} SELECT * FROM costs")
def tier_costs(b: DataFrame) -> DataFrame:
    return c.tier_costs(totals(b), by=["database"])


@query("x28_azure_costs", "backups", sql=f"{COSTS} SELECT * FROM costs WHERE provider = 'Azure'")
def azure(b: DataFrame) -> DataFrame:
    return c.tier_costs(totals(b), "azure", ["database"])


@query("t11_cheapest_tier", "backups", sql=f"{COSTS} SELECT database, provider, tier, total_monthly FROM costs QUALIFY row_number() OVER (PARTITION BY database ORDER BY total_monthly, rank) = 1")
def cheapest(b: DataFrame) -> DataFrame:
    return c.cheapest(c.tier_costs(totals(b), by=["database"]), ["database"])


@query("x29_size_estimate", "tables", sql="""
t AS (SELECT schema, sum(size_bytes)::BIGINT AS size_bytes FROM tables GROUP BY schema)
SELECT schema, size_bytes, floor(size_bytes * 0.2::DOUBLE)::BIGINT AS compressed, round(size_bytes / 1073741824.0::DOUBLE * 1024 / CASE WHEN schema LIKE '%1' THEN 100 ELSE 50 END, 11) AS seconds, CASE WHEN size_bytes < 1073741824 THEN 'balanced' WHEN size_bytes < 10737418240 THEN 'performance' WHEN size_bytes < 107374182400 THEN 'turbo' ELSE 'conservative' END AS profile, floor(size_bytes * 0.2::DOUBLE)::BIGINT * 3 AS disk_needed FROM t""")
def estimate(t: DataFrame) -> DataFrame:
    return c.size_estimate(t.groupBy("schema").agg(F.sum("size_bytes").alias("size_bytes")), 6, F.col("schema").like("%1"))


@query("x30_buffered_estimate", "tables", sql="SELECT table_id, floor(size_bytes * 1.1::DOUBLE)::BIGINT AS estimate FROM tables")
def buffered(t: DataFrame) -> DataFrame:
    return t.select("table_id", c.buffered_estimate(F.col("size_bytes")).alias("estimate"))


@query("a25_chains", "backups", sql="""
g AS (SELECT * FROM backups WHERE status IN ('completed', 'verified')), f AS (SELECT database, created_at AS since, id AS fid FROM g WHERE backup_type = 'full' QUALIFY row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) = 1)
SELECT g.database, count(*) AS n, sum(size_bytes)::BIGINT AS size_bytes, count(*) FILTER (backup_type = 'full') AS full_n, count(*) FILTER (backup_type = 'incremental') AS incremental_n, any_value(fid) AS newest_full, count(*) FILTER (backup_type = 'incremental' AND created_at >= since) AS after_full, epoch(max(created_at))::BIGINT - epoch(min(created_at))::BIGINT AS span_seconds, any_value(fid) IS NULL AS incomplete FROM g LEFT JOIN f USING (database) GROUP BY g.database""")
def chains(b: DataFrame) -> DataFrame:
    return c.chains(b)


@query("t13_largest_table", "tables", sql="SELECT schema, max(struct_pack(s := size_bytes, i := table_id)).i AS table_id, max(size_bytes) AS size_bytes FROM tables GROUP BY schema")
def largest_of(t: DataFrame) -> DataFrame:
    m = t.groupBy("schema").agg(F.max(F.struct("size_bytes", "table_id")).alias("m"))
    return m.select("schema", "m.table_id", "m.size_bytes")


@query("t14_table_sizes", "tables", sql="SELECT table_id, schema, name, size_bytes FROM tables ORDER BY size_bytes DESC, table_id LIMIT 100")
def table_sizes(t: DataFrame) -> DataFrame:
    return c.largest(t, 100).select("table_id", "schema", "name", "size_bytes")


@query("t4_largest_first", "tables", sql="SELECT table_id, row_number() OVER (PARTITION BY schema ORDER BY size_bytes DESC, table_id)::INT AS place FROM tables")
def largest_first(t: DataFrame) -> DataFrame:
    return c.largest_first(t, "schema").select("table_id", F.col("place").cast("int").alias("place"))


@query("x34_size_class", "tables", sql="SELECT table_id, k AS size_class, least(CASE k WHEN 'tiny' THEN 1 WHEN 'small' THEN 2 WHEN 'medium' THEN 4 WHEN 'large' THEN 8 ELSE 16 END, 12) AS workers FROM (SELECT table_id, CASE WHEN size_bytes < 10485760 THEN 'tiny' WHEN size_bytes < 104857600 THEN 'small' WHEN size_bytes < 1073741824 THEN 'medium' WHEN size_bytes < 10737418240 THEN 'large' ELSE 'huge' END AS k FROM tables)")
def classes(t: DataFrame) -> DataFrame:
    return t.select("table_id", c.size_class(F.col("size_bytes")).alias("size_class"), c.workers(F.col("size_bytes"), 8, 12).alias("workers"))


@query("x47_restore_strategy", "tables", sql="SELECT schema, sum(size_bytes)::BIGINT AS total, max(size_bytes) AS most, sum(CASE WHEN table_id % 500 = 0 THEN 3 ELSE 0 END)::BIGINT AS blobs, CASE WHEN sum(CASE WHEN table_id % 500 = 0 THEN 3 ELSE 0 END) > 0 THEN 'blobs' WHEN sum(size_bytes) > 53687091200 THEN 'total_size' WHEN max(size_bytes) > 10737418240 THEN 'largest_dump' ELSE 'default' END AS reason, reason <> 'default' AS conservative FROM tables GROUP BY schema")
def strategy(t: DataFrame) -> DataFrame:
    return c.restore_strategy(t.withColumn("blobs", F.when(F.col("table_id") % 500 == 0, 3).otherwise(0)), ["schema"], 4096)


@query("x48_lock_advice", "tables", sql="SELECT table_id, CASE WHEN row_count * 2 < 2048 THEN 'critical' WHEN row_count * 2 < 8192 THEN 'low' WHEN row_count * 2 < 65536 THEN 'ok' ELSE 'ample' END AS advice FROM tables")
def locks(t: DataFrame) -> DataFrame:
    return t.select("table_id", c.lock_advice(F.col("row_count") * 2).alias("advice"))


@query("x49_worker_recommendation", "tables", sql="SELECT table_id, CASE WHEN table_id % 100 > 80 THEN greatest(w // 2, 1) ELSE w END::INT AS workers FROM (SELECT table_id, greatest(least(floor(size_bytes / 3221225472.0), table_id % 32, 16), 1)::BIGINT AS w FROM tables)")
def recommended(t: DataFrame) -> DataFrame:
    return t.select("table_id", c.worker_recommendation(F.col("size_bytes"), F.col("table_id") % 32, F.col("table_id") % 100).alias("workers"))


@query("x50_backoff", "tables", sql="SELECT table_id, least(2.0 * pow(2.0, greatest(table_id % 20 - 1, 0)), 3600.0) AS seconds FROM tables")
def backoff(t: DataFrame) -> DataFrame:
    return t.select("table_id", x.backoff(2, F.col("table_id") % 20, 3600).alias("seconds"))


@query("x38_progress", "tables", sql="SELECT table_id, round(100.0 * (row_count / 3)::DOUBLE / row_count, 6) AS pct, CASE WHEN row_count > 3 THEN floor(60 * (row_count - row_count / 3) / (row_count / 3))::BIGINT END AS seconds_left FROM tables")
def progress(t: DataFrame) -> DataFrame:
    done = F.col("row_count") / 3
    return t.select("table_id", F.round(100.0 * done / F.col("row_count"), 6).alias("pct"), F.when(F.col("row_count") > 3, F.floor(60 * (F.col("row_count") - done) / done)).alias("seconds_left"))


@query("a22_phase_statistics", "iterations", sql="SELECT phase, count(*) AS n, min(duration_sec) AS min, max(duration_sec) AS max, round(avg(duration_sec), 6) AS mean, round(quantile_cont(duration_sec, 0.5), 6) AS median, round(quantile_cont(duration_sec, 0.95), 6) AS p95, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(duration_sec) END, 6) AS deviation, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM iterations GROUP BY phase")
def phases(i: DataFrame) -> DataFrame:
    d = F.col("duration_sec")
    return i.groupBy("phase").agg(F.count("*").alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(d, F.lit(0.95)), 6).alias("p95"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_samp(d)), 6).alias("deviation"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


@query("a23_operation_averages", "iterations", sql="SELECT phase, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_pct, floor(avg(duration_sec * 1000))::BIGINT AS mean_ms, round(avg(iteration % 1000), 6) AS mean_mb, round(sum(iteration % 1000)::DOUBLE / sum(duration_sec), 6) AS mb_per_s FROM iterations GROUP BY phase")
def averages(i: DataFrame) -> DataFrame:
    mb = F.col("iteration") % 1000
    return i.groupBy("phase").agg(F.round(100.0 * F.count_if("success") / F.count("*"), 6).alias("success_pct"), F.floor(F.avg(F.col("duration_sec") * 1000)).alias("mean_ms"), F.round(F.avg(mb), 6).alias("mean_mb"), F.round(F.sum(mb) / F.sum("duration_sec"), 6).alias("mb_per_s"))


@query("a29_parallel_gain", "iterations", sql="SELECT phase, round(sum(duration_sec) / (epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT), 9) AS gain FROM iterations GROUP BY phase")
def gain(i: DataFrame) -> DataFrame:
    return i.groupBy("phase").agg(F.round(F.sum("duration_sec") / x.seconds(F.min("ts"), F.max("ts")), 9).alias("gain"))


@query("t12_recent_runs", "iterations", sql="SELECT iteration, phase, duration_sec FROM iterations ORDER BY ts DESC, iteration DESC LIMIT 20")
def recent(i: DataFrame) -> DataFrame:
    return i.orderBy(F.col("ts").desc(), F.col("iteration").desc()).limit(20).select("iteration", "phase", "duration_sec")


@query("t10_engine_choice", "tables", sql="""
s AS (SELECT table_id, unnest([struct_pack(e := 'clone', s := CASE WHEN table_id % 3 = 0 THEN 50 + CASE WHEN size_bytes >= 10737418240 THEN 30 ELSE 0 END END), struct_pack(e := 'snapshot', s := CASE WHEN table_id % 4 = 0 THEN 45 + CASE WHEN size_bytes >= 53687091200 THEN 35 ELSE 0 END END), struct_pack(e := 'dump', s := 20 + CASE WHEN size_bytes < 1073741824 THEN 30 ELSE 0 END)]) AS x FROM tables)
SELECT table_id, x.e AS engine, x.s AS score FROM s WHERE x.s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY x.s DESC, x.e) = 1""")
def engines(t: DataFrame) -> DataFrame:
    size = F.col("size_bytes")
    scores = {"clone": F.when(F.col("table_id") % 3 == 0, 50 + F.when(size >= 10 * c.GIB, 30).otherwise(0)), "snapshot": F.when(F.col("table_id") % 4 == 0, 45 + F.when(size >= 50 * c.GIB, 35).otherwise(0)), "dump": 20 + F.when(size < c.GIB, 30).otherwise(0)}
    # equal scores go to the first name
    ranked = F.array_min(F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct((-s).alias("s"), F.lit(e).alias("e"))) for e, s in scores.items()])))
    return t.select("table_id", ranked.alias("r")).select("table_id", F.col("r.e").alias("engine"), (-F.col("r.s")).alias("score"))
