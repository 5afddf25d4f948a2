"""Schedules and recovery objectives: gaps, frequency, recovery point and recovery time.

Only rows whose status is in `statuses` count as backups. The reference time is always given.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x

GOOD = ("completed", "verified")


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _good(catalog: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return catalog.where(F.col("status").isin(*statuses))


@dataclass(frozen=True)
class Schedule:
    """Seconds: the expected interval, what is tolerated beyond it, and the gap that is critical."""

    interval: int
    tolerance: int
    rpo: int


def followed(rows: DataFrame, span: str = "month") -> DataFrame:
    """rows with `next`, the time of the next row of their database, and `n`, its number of rows.

    A database may hold a third of all rows, so a window takes a database's rows of one span only; what follows a span's
    last row is the first of the next span that has any, found among the spans' sums.
    """
    rows = rows.withColumn("__span", F.date_trunc(span, "created_at"))
    inside = rows.withColumn("__next", F.lead("created_at").over(Window.partitionBy("database", "__span").orderBy("created_at", "id")))
    spans = rows.groupBy("database", "__span").agg(F.min("created_at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy("database")
    spans = spans.select("database", "__span", F.lead("__first").over(whole.orderBy("__span")).alias("__after"), F.sum("__rows").over(whole).alias("n"))
    return inside.join(spans, ["database", "__span"]).withColumn("next", F.coalesce("__next", "__after")).drop("__span", "__next", "__after")


def gaps(catalog: DataFrame, plan: Schedule, as_of: str, statuses: Sequence[str] = GOOD) -> DataFrame:
    """Intervals longer than expected, up to the reference time after the last; none for a database with fewer than two rows. One plan serves all databases."""
    every = followed(_good(catalog, statuses).select("database", "id", "created_at"))
    end = F.coalesce("next", _now(as_of))
    length = x.seconds(F.col("created_at"), end)
    severity = F.when(length > plan.rpo, "critical").when(length > 2 * plan.interval, "warning").otherwise("info")
    out = every.where("n >= 2").select("database", "id", F.col("created_at").alias("gap_start"), end.alias("gap_end"), length.alias("gap_seconds"), F.col("next").isNull().alias("is_tail"), severity.alias("severity"))
    return out.where(F.col("gap_seconds") > plan.interval + plan.tolerance)


def rpo_status(catalog: DataFrame, interval: int, as_of: str, statuses: Sequence[str] = GOOD) -> DataFrame:
    age = x.seconds(F.col("created_at"), _now(as_of))
    g = _good(catalog, statuses).groupBy("database").agg(F.max("created_at").alias("last_backup"), F.min(age).alias("age_seconds"), F.count_if(age <= 86400).alias("last_24h"), F.count_if(age <= 7 * 86400).alias("last_7d"))
    return g.select("database", "last_backup", "age_seconds", (F.col("age_seconds") <= interval).alias("rpo_met"), (F.col("last_backup") + F.expr(f"interval {interval} seconds")).alias("next_due"), "last_24h", "last_7d")


def frequency(catalog: DataFrame, interval: int, as_of: str, statuses: Sequence[str] = GOOD) -> DataFrame:
    """Intervals between backups, their deviation and regularity (1 - deviation / mean, 0 at least), gaps and missed backups."""
    steps = followed(_good(catalog, statuses).select("database", "id", "created_at")).select("database", "created_at", x.seconds(F.col("created_at"), F.col("next")).alias("step"))
    a = steps.groupBy("database").agg(F.count("*").alias("total"), x.seconds(F.min("created_at"), F.max("created_at")).alias("period"), F.sum("step").alias("sum"), F.min("step").alias("min_interval"), F.max("step").alias("max_interval"), F.stddev_pop("step").alias("dev"))
    found = gaps(catalog, Schedule(interval, interval // 4, 2 * interval), as_of, statuses).groupBy("database").agg(F.count("*").alias("gaps"))
    mean = F.col("sum") / (F.col("total") - 1)
    regular = F.when(F.col("sum") > 0, 1 - F.least(F.col("dev") / mean, F.lit(1.0))).otherwise(0.0)
    return a.join(found, "database", "left").select("database", "total", "period", F.expr("`sum` div (total - 1)").alias("mean_interval"), "min_interval", "max_interval", F.round("dev", 6).alias("deviation"), F.round(regular, 6).alias("regularity"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.greatest(F.expr(f"period div {interval}") - F.col("total"), F.lit(0)).cast("long").alias("missed"))


@dataclass(frozen=True)
class Recovery:
    """Targets in seconds, speeds, and the fixed steps in minutes."""

    target_rpo: int = 86400
    target_rto: int = 3600
    download_mbps: float = 100.0
    write_mbps: float = 100.0
    detection: int = 5
    decision: int = 10
    startup: int = 5
    validation: int = 5
    switchover: int = 5

    def fixed(self) -> int:
        return 60 * (self.detection + self.decision + self.startup + self.validation + self.switchover)

    def download(self) -> Column:
        return F.when(F.col("cloud_location").isNotNull(), F.col("size_bytes") / (self.download_mbps * 125000)).otherwise(0.0)

    def restore(self) -> Column:
        return F.col("size_bytes") / (self.write_mbps * 1e6) * F.when(F.col("compression") != "none", 1.3).otherwise(1.0) * F.when(F.col("encrypted"), 1.1).otherwise(1.0)


def rto(catalog: DataFrame, plan: Recovery, as_of: str, statuses: Sequence[str] = GOOD, recent: int = 100) -> DataFrame:
    """For each database its newest backup's breakdown and the recent ones' interval, from one window."""
    w = Window.partitionBy("database").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = _good(catalog, statuses).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= recent)
    first = F.max_by(F.struct("id", "created_at", "database_type", plan.download().alias("d"), plan.restore().alias("r")), -F.col("rank"))
    g = top.groupBy("database").agg(first.alias("f"), x.seconds(F.min("created_at"), F.max("created_at")).alias("span"), F.count("*").alias("n"), F.bool_or(F.col("backup_type") == "incremental").alias("incremental"))
    total = F.col("f.d") + F.col("f.r") + plan.fixed()
    age = x.seconds(F.col("f.created_at"), _now(as_of))
    return g.select("database", "f.id", age.alias("rpo_seconds"), F.round("f.d", 6).alias("download_seconds"), F.round("f.r", 6).alias("restore_seconds"), F.round(total, 6).alias("rto_seconds"), (age <= plan.target_rpo).alias("rpo_met"), (total <= plan.target_rto).alias("rto_met"), F.expr("span div greatest(n - 1, 1)").alias("interval_seconds"), "incremental", F.col("f.database_type").alias("database_type"))


def recommendations(analysis: DataFrame) -> DataFrame:
    told = x.rules(
        (~F.col("rpo_met"), "backup_frequency:critical"), (~F.col("rto_met"), "parallel_restore:high"), (F.col("download_seconds") > 1800, "local_cache:medium"),
        (~F.col("incremental") & (F.col("interval_seconds") > 6 * 3600), "incremental_backup:medium"), (F.col("database_type") == "postgresql", "wal_archiving:medium"),
    )
    out = analysis.select("database", F.explode(told).alias("told"))
    return out.select("database", F.split_part("told", F.lit(":"), F.lit(1)).alias("recommendation"), F.split_part("told", F.lit(":"), F.lit(2)).alias("priority"))


def history(catalog: DataFrame, plan: Recovery, as_of: str, statuses: Sequence[str] = GOOD) -> DataFrame:
    """For each backup its recovery time and the time to the next one."""
    every = followed(_good(catalog, statuses).select("database", "id", "created_at", F.round(plan.download() + plan.restore() + plan.fixed(), 6).alias("rto_seconds")))
    return every.select("database", "id", "rto_seconds", x.seconds(F.col("created_at"), F.coalesce("next", _now(as_of))).alias("rpo_seconds"))


def summary(analysis: DataFrame) -> DataFrame:
    return analysis.agg(
        F.count("*").alias("databases"), F.count_if("rpo_met").alias("rpo_compliant"), F.count_if("rto_met").alias("rto_compliant"), F.count_if(F.col("rpo_met") & F.col("rto_met")).alias("both_compliant"), F.count_if(~F.col("rpo_met")).alias("critical_issues"),
        F.max("rpo_seconds").alias("worst_rpo"), F.max("rto_seconds").alias("worst_rto"), F.max(F.struct("rto_seconds", "database"))["database"].alias("worst_rto_database"), F.floor(F.sum("rpo_seconds") / F.count("*")).cast("long").alias("mean_rpo"), F.floor(F.avg("rto_seconds")).cast("long").alias("mean_rto"),
    )


def compliance_rates(totals: DataFrame) -> DataFrame:
    def rate(column: str) -> Column:
        return F.round(100.0 * F.col(column) / F.col("databases"), 6)

    return totals.select(rate("rto_compliant").alias("rto_rate"), rate("rpo_compliant").alias("rpo_rate"), rate("both_compliant").alias("full_rate"))


def mean_interval(catalog: DataFrame, statuses: Sequence[str] = GOOD) -> DataFrame:
    g = _good(catalog, statuses).groupBy("database").agg(F.count("*").alias("n"), x.seconds(F.min("created_at"), F.max("created_at")).alias("span"))
    return g.where("n >= 2").select("database", F.expr("span div (n - 1)").alias("mean_interval"))
