"""Capacity and cost: growth forecasts, limits, storage tiers, size estimates, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from .chains import newest, previous

GIB = 1 << 30


def growth(catalog: DataFrame) -> DataFrame:
    """Daily growth of each database from its first to its last row, and how steady it is. Needs two rows at different times."""
    first, last = F.min(F.struct("created_at", "id", "size_bytes")), F.max(F.struct("created_at", "id", "size_bytes"))
    rows = previous(catalog.select("database", "created_at", "id", "size_bytes"), ["database"], F.date_trunc("month", "created_at"), ["created_at", "id"], {"created_at": "at_before", "size_bytes": "size_before"})
    days = x.seconds(F.col("at_before"), F.col("created_at")) / 86400.0
    rate = (F.col("size_bytes") - F.col("size_before")) / days
    steps = rows.select("database", "created_at", "id", "size_bytes", F.when(days > 0, rate).alias("rate"))
    # sums of the rates and their squares give the spread around any mean in the same pass
    g = steps.groupBy("database").agg(F.count("*").alias("n"), first.alias("f"), last.alias("l"), F.sum("rate").alias("r1"), F.sum(F.col("rate") * F.col("rate")).alias("r2"), F.count("rate").alias("rn"))
    span = x.seconds(F.col("f.created_at"), F.col("l.created_at")) / 86400.0
    g = g.where("n >= 2").withColumn("days", span).where("days > 0")
    daily = (F.col("l.size_bytes") - F.col("f.size_bytes")) / F.col("days")
    g = g.withColumn("daily", daily)
    variance = (F.col("r2") - 2 * F.col("daily") * F.col("r1") + F.col("rn") * F.col("daily") * F.col("daily")) / (F.col("n") - 1)
    sure = F.when(F.col("n") < 5, "low").when(F.col("n") < 15, "medium").when(F.sqrt(F.greatest(variance, F.lit(0.0))) > F.abs("daily") * 0.5, "medium").otherwise("high")
    pct = F.when(F.col("f.size_bytes") > 0, 100 * F.col("daily") / F.col("f.size_bytes")).otherwise(0.0)
    return g.select("database", "n", F.col("l.size_bytes").alias("current_size"), F.col("l.created_at").alias("newest"), F.round("days", 6).alias("days"), F.round("daily", 6).alias("daily_growth"), F.round(pct, 6).alias("daily_pct"), sure.alias("confidence"))


def largest_first(tables: DataFrame, by: str) -> DataFrame:
    """tables with their place in their group, the largest first, then by table_id. Sizes are ranked in spans of a 64th of a doubling."""
    rows = tables.withColumn("__back", -F.col("table_id"))
    return newest(rows, [by], F.floor(F.log2(F.greatest(F.col("size_bytes"), F.lit(0)) + 1) * 64), ["size_bytes", "__back"], "place").drop("__back")


def forecast(rates: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The size after each number of days, 0 at least; confidence falls 10 points in 30 days, to 30 at least."""
    base = F.when(F.col("confidence") == "high", 95.0).when(F.col("confidence") == "medium", 75.0).otherwise(50.0)
    out = rates.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    grown = F.col("current_size") + (F.col("daily_growth") * F.col("horizon")).cast("long")
    return out.select("database", "horizon", F.greatest(grown, F.lit(0)).alias("predicted_size"), F.greatest(F.round(base - F.col("horizon") / 30.0 * 10.0, 6), F.lit(30.0)).alias("confidence_pct"))


def limit_status(rates: DataFrame, limit: int) -> DataFrame:
    used = 100.0 * F.col("current_size") / limit
    left = (limit - F.col("current_size")) / F.col("daily_growth")
    days = F.when((F.col("daily_growth") > 0) & (left > 0) & (left < 1000), left)
    status = F.when(F.col("current_size") >= limit, "exceeded").when(used >= 80, "approaching").otherwise("within")
    return rates.select("database", F.round(used, 6).alias("used_pct"), status.alias("status"), F.round(days, 6).alias("days_to_limit"), F.when(days < 30, "critical").when(days < 90, "warning").alias("alert"))


#: Provider, tier, price of a stored GB and month, price of a retrieved GB, shortest storage in days.
TIERS = (
    ("AWS S3", "Standard", 0.023, 0.0, 0),
    ("AWS S3", "Intelligent-Tiering", 0.023, 0.0, 0),
    ("AWS S3", "Standard-IA", 0.0125, 0.01, 30),
    ("AWS S3", "Glacier Instant", 0.004, 0.03, 90),
    ("AWS S3", "Glacier Flexible", 0.0036, 0.02, 90),
    ("AWS S3", "Deep Archive", 0.00099, 0.02, 180),
    ("GCS", "Standard", 0.020, 0.0, 0),
    ("GCS", "Nearline", 0.010, 0.01, 30),
    ("GCS", "Coldline", 0.004, 0.02, 90),
    ("GCS", "Archive", 0.0012, 0.05, 365),
    ("Azure", "Hot", 0.0184, 0.0, 0),
    ("Azure", "Cool", 0.010, 0.01, 30),
    ("Azure", "Archive", 0.00099, 0.02, 180),
    ("Backblaze B2", "Standard", 0.005, 0.01, 0),
    ("Wasabi", "Hot Cloud", 0.0059, 0.0, 90),
)


def tier_costs(totals: DataFrame, provider: str = "all", by: Sequence[str] = ()) -> DataFrame:
    """totals: the keys `by` and size_bytes. Costs of every tier with one retrieval a month; savings against the first tier of the whole list, whatever providers are shown."""
    tiers = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(p).alias("provider"), F.lit(t).alias("tier"), F.lit(float(s)).alias("store"), F.lit(float(r)).alias("fetch"), F.lit(d).alias("days")) for k, (p, t, s, r, d) in enumerate(TIERS) if provider == "all" or provider.lower() in p.lower()])
    out = totals.select(*by, (F.col("size_bytes") / float(GIB)).alias("gb"), F.explode(tiers).alias("t"))
    month = F.col("gb") * F.col("t.store") + F.col("gb") * F.col("t.fetch")
    base = F.col("gb") * TIERS[0][2] + F.col("gb") * TIERS[0][3]
    best = F.when(F.col("t.days") >= 180, "long-term archive").when(F.col("t.days") >= 90, "compliance archive").when(F.col("t.days") >= 30, "recent backups").otherwise("active backups")
    def r(c: Column, name: str) -> Column:
        return F.round(c, 6).alias(name)

    return out.select(*by, F.col("t.rank").alias("rank"), F.col("t.provider").alias("provider"), F.col("t.tier").alias("tier"), r(F.col("gb") * F.col("t.store"), "monthly_storage"), r(F.col("gb") * F.col("t.fetch"), "retrieval"), r(month, "total_monthly"), r(month * 12, "total_annual"), r(base - month, "savings"), r(F.when(base > 0, 100 * (base - month) / base).otherwise(0.0), "savings_pct"), best.alias("best_for"))


def cheapest(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tier of the lowest monthly total, the first of equal ones."""
    return costs.groupBy(*by).agg(F.min(F.struct("total_monthly", "rank", "provider", "tier")).alias("m")).select(*by, "m.provider", "m.tier", "m.total_monthly")


def size_estimate(totals: DataFrame, level: int, mysql: Column) -> DataFrame:
    """Compressed size, seconds, profile and disk needed from raw size."""
    gb = F.col("size_bytes") / float(GIB)
    packed = F.floor(F.col("size_bytes") * (0.20 if level >= 6 else 0.25)).cast("long")
    speed = F.when(mysql, 100.0).otherwise(50.0)
    profile = F.when(gb < 1, "balanced").when(gb < 10, "performance").when(gb < 100, "turbo").otherwise("conservative")
    return totals.select("*", packed.alias("compressed"), F.round(gb * 1024 / speed, 11).alias("seconds"), profile.alias("profile"), (packed * 3).alias("disk_needed"))


def buffered_estimate(size: Column) -> Column:
    """A size with a tenth added, whole bytes."""
    return F.floor(size * 1.1).cast("long")


def chains(catalog: DataFrame) -> DataFrame:
    """Of each database: counts, size, newest full backup and what came after it, span; incomplete without a full one."""
    good = catalog.where(F.col("status").isin("completed", "verified"))
    full = F.max(F.when(F.col("backup_type") == "full", F.struct("created_at", "id")))
    g = good.groupBy("database").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"), F.count_if(F.col("backup_type") == "full").alias("full_n"), F.count_if(F.col("backup_type") == "incremental").alias("incremental_n"), full.alias("f"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    after = good.where("backup_type = 'incremental'").join(g.select("database", "f.created_at").withColumnRenamed("created_at", "since"), "database").where(F.col("created_at") >= F.col("since")).groupBy("database").agg(F.count("*").alias("after_full"))
    return g.join(after, "database", "left").select("database", "n", "size_bytes", "full_n", "incremental_n", F.col("f.id").alias("newest_full"), F.coalesce("after_full", F.lit(0)).alias("after_full"), x.seconds(F.col("oldest"), F.col("newest")).alias("span_seconds"), F.col("f").isNull().alias("incomplete"))


def largest(tables: DataFrame, n: int) -> DataFrame:
    return tables.orderBy(F.col("size_bytes").desc(), "table_id").limit(n)


def size_class(size: Column) -> Column:
    m = 1 << 20
    return F.when(size < 10 * m, "tiny").when(size < 100 * m, "small").when(size < GIB, "medium").when(size < 10 * GIB, "large").otherwise("huge")


def workers(size: Column, base: int, cpus: int) -> Column:
    c = size_class(size)
    w = F.when(c == "tiny", 1).when(c == "small", max(2, base // 4)).when(c == "medium", max(4, base // 2)).when(c == "large", max(8, base)).otherwise(max(16, base * 2))
    return F.least(w, F.lit(cpus))


def worker_recommendation(memory_bytes: Column, cores: Column, used_pct: Column) -> Column:
    """One for 3 GB and core, 1 to 16, half of it above 80 % memory use."""
    w = F.greatest(F.least(F.floor(memory_bytes / (3.0 * GIB)), cores, F.lit(16)), F.lit(1))
    return F.when(used_pct > 80, F.greatest(F.floor(w / 2), F.lit(1))).otherwise(w).cast("int")


def restore_strategy(dumps: DataFrame, by: Sequence[str], max_locks: int) -> DataFrame:
    """dumps: by, size_bytes, blobs. The first rule that holds: BLOBs, over 50 GB in all, too few locks, one over 10 GB."""
    g = dumps.groupBy(*by).agg(F.sum("size_bytes").alias("total"), F.max("size_bytes").alias("most"), F.sum("blobs").alias("blobs"))
    why = F.when(F.col("blobs") > 0, "blobs").when(F.col("total") > 50 * GIB, "total_size").when(F.lit(max_locks < 4096), "locks").when(F.col("most") > 10 * GIB, "largest_dump").otherwise("default")
    return g.select(*by, "total", "most", "blobs", why.alias("reason"), (why != "default").alias("conservative"))


def lock_advice(locks: Column) -> Column:
    return F.when(locks < 2048, "critical").when(locks < 8192, "low").when(locks < 65536, "ok").otherwise("ample")
