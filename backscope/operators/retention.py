"""Retention: two grandfather-father-son policies, age with a minimum, manifests. They decide; nothing is deleted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from .chains import newest


@dataclass(frozen=True)
class Tiers:
    daily: int
    weekly: int
    monthly: int
    yearly: int


def _keys(ts: str = "created_at") -> dict[str, Column]:
    return {"w": x.iso_week(F.col(ts)), "m": F.date_format(ts, "yyyy-MM"), "y": F.date_format(ts, "yyyy")}


def _first(df: DataFrame, n: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first n rows of each group, or of all: a limit before the shuffle, not a rank of every row."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def _named(rows: DataFrame, kept: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """rows with the first tier that keeps each (by id), '' if none does. What is kept is a few rows for each group."""
    places = None
    for rank, (tier, ids) in enumerate(kept):
        one = ids.select("id", F.struct(F.lit(rank).alias("rank"), F.lit(tier).alias("tier")).alias("t"))
        places = one if places is None else places.unionByName(one)
    best = places.groupBy("id").agg(F.min("t").alias("t"))
    return rows.join(best, "id", "left").withColumn("tier", F.coalesce("t.tier", F.lit(""))).drop("t")


def gfs_catalog(catalog: DataFrame, keep: Tiers, per_database: bool = False, statuses: Sequence[str] = ("completed", "verified")) -> DataFrame:
    """Daily: the newest backups. Weekly, monthly, yearly: the oldest backup of each of the newest weeks, months, years; a place counts as spent though its backup is kept already. The first tier names it; '' is to be deleted."""
    by = ["database"] if per_database else []
    c = catalog.where(F.col("status").isin(*statuses)).select("id", "database", "size_bytes", "created_at")
    kept = [("daily", _first(c, keep.daily, by, F.col("created_at").desc(), F.col("id").desc()))]
    for tier, key, most in (("weekly", "w", keep.weekly), ("monthly", "m", keep.monthly), ("yearly", "y", keep.yearly)):
        buckets = c.groupBy(*by, _keys()[key].alias("key")).agg(F.max("created_at").alias("newest"), F.min(F.struct("created_at", "id"))["id"].alias("id"))
        kept.append((tier, _first(buckets, most, by, F.col("newest").desc(), F.col("key"))))
    return _named(c, kept).select("id", "database", "size_bytes", "tier")


def _on_day(ts: Column, day: int) -> Column:
    return x.is_last_day(ts) if day == 0 else F.dayofmonth(ts) == day


def tiers_of(ts: Column, weekly_day: int = 0, monthly_day: int = 1) -> Column:
    """All tiers that a time qualifies for; month day 0 is the last."""
    month = _on_day(ts, monthly_day)
    return x.rules((F.lit(True), "daily"), (x.weekday(ts) == weekly_day, "weekly"), (month, "monthly"), (month & (F.month(ts) == 1), "yearly"))


def gfs_files(files: DataFrame, keep: Tiers, weekly_day: int = 0, monthly_day: int = 1) -> DataFrame:
    """Of the qualifying files the newest of each of the newest days, weeks, months, years; counted for the first tier that keeps it."""
    ts = F.col("created_at")
    month = _on_day(ts, monthly_day)
    f = files.select("id", "backup_path", "created_at")
    kept = []
    for tier, key, fits, most in (("daily", F.date_format(ts, "yyyy-MM-dd"), F.lit(True), keep.daily), ("weekly", _keys()["w"], x.weekday(ts) == weekly_day, keep.weekly), ("monthly", _keys()["m"], month, keep.monthly), ("yearly", _keys()["y"], month & (F.month(ts) == 1), keep.yearly)):
        buckets = f.where(fits).groupBy(key.alias("key")).agg(F.max(F.struct("created_at", "id"))["id"].alias("id"))
        kept.append((tier, _first(buckets, most, (), F.col("key").desc())))
    return _named(f, kept).select("id", "backup_path", "tier")


def _ranked(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """files with their rank in their group, the newest first; a group is ranked day by day, so that a large one meets in no single task."""
    return newest(files, by, F.date_trunc("day", "created_at"), ["created_at", "id"], "rank")


def age_policy(files: DataFrame, days: int, minimum: int, as_of: str, by: Sequence[str] = ("database",)) -> DataFrame:
    """Keep the newest `minimum` of each group and all not older than `days`."""
    old = x.seconds(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")) > days * 86400
    reason = F.when(F.col("rank") <= minimum, "minimum").when(old, f"older than {days} days").otherwise(f"within {days} days")
    return _ranked(files, by).withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").startswith("older"), "delete").otherwise("keep"))


def simulate(files: DataFrame, days: Sequence[int], minimum: int, as_of: str) -> DataFrame:
    """What the age policy would keep and free for each number of days. The list is short."""
    ranked = _ranked(files.select("id", "database", "size_bytes", "created_at"), ("database",))
    each = ranked.select("size_bytes", "rank", x.seconds(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")).alias("age"), F.explode(F.array(*map(F.lit, days))).alias("days"))
    gone = (F.col("rank") > minimum) & (F.col("age") > F.col("days") * 86400)
    return each.groupBy("days").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("freed"))


def manifest_rules(manifests: DataFrame, last: int, days: int, weeks: int) -> DataFrame:
    """Of each database: the last ones, the newest of the newest days, the newest of the newest ISO weeks. Ids are unique."""
    by = ["database"]
    m = manifests.select("id", "database", "created_at")
    kept = [("last", _first(m, last, by, F.col("created_at").desc(), F.col("id").desc()))]
    for tier, key, most in (("day", F.to_date("created_at"), days), ("week", x.iso_week(F.col("created_at")), weeks)):
        buckets = m.groupBy("database", key.alias("key")).agg(F.max(F.struct("created_at", "id"))["id"].alias("id"))
        kept.append((tier, _first(buckets, most, by, F.col("key").desc())))
    return _named(m, kept).select("id", (F.col("tier") != "").alias("keep"))


def wal_retention(files: DataFrame, days: int, as_of: str, oldest_needed: str | None = None) -> DataFrame:
    """Archived log files to delete: older than the limit and before the name that is still needed."""
    old = x.seconds(F.col("mod_time"), F.lit(as_of).cast("timestamp_ntz")) > days * 86400
    needed = F.col("name") >= oldest_needed if oldest_needed else F.lit(False)
    return files.withColumn("decision", F.when(old & ~needed, "delete").otherwise("keep"))
