"""The backup catalog: search, statistics, changes, export, pruning and synchronisation.

The catalog is a DataFrame and no operator changes it: changes give a new one, deletions give decisions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x


@dataclass(frozen=True)
class Search:
    """Twelve optional conditions; * in the database's name stands for any text; bounds of time and size are inclusive.

    verified=False means never verified: a failed verification is neither verified nor unverified.
    """

    database: str | None = None
    database_type: str | None = None
    host: str | None = None
    status: str | None = None
    start: str | None = None
    end: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    backup_type: str | None = None
    encrypted: bool | None = None
    verified: bool | None = None
    drill_tested: bool | None = None
    order_by: str = "created_at"
    descending: bool = True
    limit: int | None = None
    offset: int = 0

    def predicate(self) -> Column:
        parts: list[Column] = []
        if self.database:
            parts.append(F.col("database").like(self.database.replace("*", "%")) if "*" in self.database else F.col("database") == self.database)
        parts += [F.col(c) == v for c, v in (("database_type", self.database_type), ("host", self.host), ("status", self.status), ("backup_type", self.backup_type)) if v]
        if self.start:
            parts.append(F.col("created_at") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            parts.append(F.col("created_at") <= F.lit(self.end).cast("timestamp_ntz"))
        if self.min_size:
            parts.append(F.col("size_bytes") >= self.min_size)
        if self.max_size:
            parts.append(F.col("size_bytes") <= self.max_size)
        if self.encrypted is not None:
            parts.append(F.col("encrypted") == self.encrypted)
        if self.verified is not None:
            parts.append(F.col("verified_at").isNotNull() & F.col("verify_valid") if self.verified else F.col("verified_at").isNull())
        if self.drill_tested is not None:
            parts.append(F.col("drill_tested_at").isNotNull() & F.col("drill_success") if self.drill_tested else F.col("drill_tested_at").isNull())
        return reduce(Column.__and__, parts) if parts else F.lit(True)


def search(catalog: DataFrame, what: Search) -> DataFrame:
    """Matching rows in order, the id last; the offset only counts with a limit."""
    found = catalog.where(what.predicate())
    by = F.col(what.order_by)
    found = found.orderBy(by.desc() if what.descending else by.asc(), "id")
    if what.limit is None:
        return found
    return (found.offset(what.offset) if what.offset else found).limit(what.limit)


def lookup(catalog: DataFrame, column: str, value: object) -> DataFrame:
    return catalog.where(F.col(column) == value)


def stats(catalog: DataFrame) -> DataFrame:
    """One row over all rows that aren't deleted."""
    return catalog.where("status <> 'deleted'").agg(*_stats())


def _stats() -> list[Column]:
    return [
        F.count("*").alias("total_backups"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.round(F.avg("duration"), 6).alias("avg_duration"),
        F.floor(F.sum("size_bytes") / F.count("size_bytes")).cast("long").alias("avg_size"), F.count_if(F.col("verified_at").isNotNull() & F.col("verify_valid")).alias("verified"), F.count_if(F.col("drill_tested_at").isNotNull() & F.col("drill_success")).alias("drill_tested"),
    ]


def stats_by_database(catalog: DataFrame) -> DataFrame:
    return catalog.where("status <> 'deleted'").groupBy("database").agg(*_stats())


def counts(catalog: DataFrame) -> DataFrame:
    """Rows by database, by type and by status, deleted ones included, from one pass."""
    sets = catalog.groupingSets([["database"], ["database_type"], ["status"]], "database", "database_type", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "database").when(F.col("g") == 5, "database_type").otherwise("status")
    return sets.select(kind.alias("kind"), F.coalesce("database", "database_type", "status").alias("value"), "n")


def databases(catalog: DataFrame) -> DataFrame:
    return catalog.select("database").distinct().orderBy("database")


def sync_status(catalog: DataFrame) -> DataFrame:
    folder = F.regexp_extract("backup_path", r"^(.*)/", 1)
    return catalog.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "deleted").alias("active"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.countDistinct(folder).alias("folders"))


def insert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose path isn't there yet."""
    return catalog.unionByName(new.dropDuplicates(["backup_path"]).join(catalog.select("backup_path"), "backup_path", "left_anti"))


def update(catalog: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of changes replace those columns by id; creation time and path stay."""
    fixed = {"id", "created_at", "backup_path"}
    c = changes.select("id", *[F.col(n).alias(f"__{n}") for n in columns if n not in fixed], F.lit(True).alias("__hit"))
    out = catalog.join(c, "id", "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.col(n)).alias(n) if n in columns and n not in fixed else F.col(n) for n in catalog.columns])


def delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id"), "id", "left_anti")


def mark_verified(catalog: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """results: (id, valid). Sets the time and outcome, and the status to verified or corrupted."""
    out = catalog.join(results.select("id", F.col("valid").alias("__valid")), "id", "left")
    hit = F.col("__valid").isNotNull()
    new = {"verified_at": F.lit(at).cast("timestamp_ntz"), "verify_valid": F.col("__valid"), "status": F.when(F.col("__valid"), "verified").otherwise("corrupted")}
    return out.select(*[F.when(hit, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in catalog.columns])


def mark_drill_tested(catalog: DataFrame, results: DataFrame, at: str) -> DataFrame:
    out = catalog.join(results.select("id", F.col("success").alias("__success")), "id", "left")
    new = {"drill_tested_at": F.lit(at).cast("timestamp_ntz"), "drill_success": F.col("__success")}
    return out.select(*[F.when(F.col("__success").isNotNull(), new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in catalog.columns])


def prune_candidates(catalog: DataFrame, as_of: str, days: int, database: str | None = None, status: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """Rows to prune with the reason that counts first: missing file, then age, then status."""
    c = catalog.where(F.col("database") == database) if database else catalog
    if present is not None:
        c = c.join(present.select(F.col("path").alias("backup_path"), F.lit(True).alias("__there")), "backup_path", "left")
    gone = F.col("__there").isNull() & F.col("cloud_location").isNull() if present is not None else F.lit(False)
    old = x.seconds(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")) > days * 86400
    wrong = F.col("status") == status if status else F.lit(False)
    reason = F.when(gone, "missing").when(old, "age").when(wrong, "status")
    return c.withColumn("reason", reason).where("reason is not null").select("id", "database", "backup_path", "size_bytes", "reason")


def forget_deleted(catalog: DataFrame, before: str) -> DataFrame:
    return catalog.where(~((F.col("status") == "deleted") & (F.col("created_at") < F.lit(before).cast("timestamp_ntz"))))


def sync(catalog: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Catalog and directory by path: added, updated (size differs; verification and drill fields stay), unchanged, deleted."""
    s = sidecars.select(F.col("path").alias("backup_path"), F.col("size").alias("__size"), F.col("modified_at").alias("__at"))
    out = catalog.join(s, "backup_path", "full_outer")
    action = F.when(F.col("id").isNull(), "added").when(F.col("__at").isNull(), "deleted").when(F.col("__size") != F.col("size_bytes"), "updated").otherwise("unchanged")
    return out.select("backup_path", "id", action.alias("action"), F.coalesce("__size", "size_bytes").alias("size_bytes"), F.coalesce("created_at", "__at").alias("created_at"), F.when(action == "deleted", "deleted").otherwise(F.coalesce("status", F.lit("completed"))).alias("status"), "verified_at", "verify_valid", "drill_tested_at")


#: Columns of the exported catalog, in order.
EXPORT = ("id", "database", "database_type", "host", "backup_path", "backup_type", "size_bytes", "size", "compression", "encrypted", "created_at", "duration", "status", "verified", "verified_at", "drill_tested", "drill_tested_at", "cloud_location", "sha256", "age")


def export(catalog: DataFrame, as_of: str) -> DataFrame:
    """Text columns, ready for write.csv or write.json."""
    day = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    made = {
        "size": x.human_bytes(F.col("size_bytes")), "created_at": day, "duration": x.human_duration(F.col("duration")), "verified": F.when(F.col("verified_at").isNull(), "no").when(F.col("verify_valid"), "yes").otherwise("failed"),
        "verified_at": F.coalesce(F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), "drill_tested": F.when(F.col("drill_tested_at").isNull(), "no").when(F.col("drill_success"), "yes").otherwise("failed"),
        "drill_tested_at": F.coalesce(F.date_format("drill_tested_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), "age": x.age_label(x.seconds(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz"))),
    }
    return catalog.select(*[(made[c] if c in made else F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string").alias(c) for c in EXPORT])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows of one database: differences of b from a in size, duration and time."""
    p = a.select("database", F.col("id").alias("id_a"), F.col("size_bytes").alias("size_a"), F.col("duration").alias("duration_a"), F.col("created_at").alias("at_a"))
    q = b.select("database", F.col("id").alias("id_b"), F.col("size_bytes").alias("size_b"), F.col("duration").alias("duration_b"), F.col("created_at").alias("at_b"))
    delta = F.col("size_b") - F.col("size_a")
    return p.join(q, "database").select("database", "id_a", "id_b", delta.alias("size_delta"), F.round(F.when(F.col("size_a") > 0, 100.0 * delta / F.col("size_a")).otherwise(0.0), 6).alias("size_pct"), F.round(F.col("duration_b") - F.col("duration_a"), 6).alias("duration_delta"), x.seconds(F.col("at_a"), F.col("at_b")).alias("seconds_between"))


def newest(catalog: DataFrame, n: int = 1, by: Sequence[str] = ("database",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return catalog.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dashboard(catalog: DataFrame, as_of: str) -> DataFrame:
    """The newest row of each database: OK up to a day, AGING up to seven, else STALE."""
    age = x.seconds(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz"))
    state = F.when(age <= 86400, "OK").when(age <= 7 * 86400, "AGING").otherwise("STALE")
    return newest(catalog.where("status <> 'deleted'")).select("database", "id", "created_at", age.alias("age_seconds"), state.alias("state"), x.human_bytes(F.col("size_bytes")).alias("size"))
