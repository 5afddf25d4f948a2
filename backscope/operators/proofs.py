"""Verification, reconciliation, compliance, health, metrics, plans to copy files."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as x
from .chains import folded, previous


def reconcile(source: DataFrame, restored: DataFrame) -> DataFrame:
    """Row counts of all tables of either side; a missing side counts -1; a match needs both."""
    s, r = source.select("name", F.col("row_count").alias("s")), restored.select("name", F.col("row_count").alias("r"))
    both = s.join(r, "name", "full_outer")
    return both.select("name", F.coalesce("s", F.lit(-1)).alias("source_rows"), F.coalesce("r", F.lit(-1)).alias("restored_rows"), F.coalesce(F.col("s") == F.col("r"), F.lit(False)).alias("match"))


def compare_databases(source: DataFrame, target: DataFrame) -> DataFrame:
    """What differs: missing in the target, extra there, other row counts, other checksums."""
    s, t = source.select("name", F.col("row_count").alias("s"), F.col("checksum").alias("cs")), target.select("name", F.col("row_count").alias("t"), F.col("checksum").alias("ct"))
    kind = F.when(F.col("t").isNull(), "missing_in_target").when(F.col("s").isNull(), "extra_in_target").when(F.col("s") != F.col("t"), "row_mismatch").when(F.col("cs") != F.col("ct"), "checksum_mismatch")
    return s.join(t, "name", "full_outer").select("name", kind.alias("difference"), (F.coalesce("t", F.lit(0)) - F.coalesce("s", F.lit(0))).alias("row_delta")).where("difference is not null")


def check_summary(tables: DataFrame) -> DataFrame:
    return tables.agg(F.count("*").alias("tables"), F.sum(F.greatest("source_rows", F.lit(0))).alias("source_rows"), F.sum(F.greatest("restored_rows", F.lit(0))).alias("restored_rows"), F.count_if(~F.col("match")).alias("mismatches"), (F.count_if(~F.col("match")) == 0).alias("ok"))


def table_checksum(rows: DataFrame, by: Sequence[str], text: Column, order: Sequence[str]) -> DataFrame:
    """MD5 of the rows' texts in order, nulls last ('empty' without rows). A fold over one group's rows: see multiset_checksum, which shares a large table's rows out."""

    def step(digest: Any, *row: Any) -> list[tuple]:
        if row[-1] is not None:
            digest.update(row[-1].encode())
        return []

    texts = rows.select(*by, *order, text.alias("__t"), *([] if by else [F.lit(0).alias("__all")]))
    places = [F.col(c).asc_nulls_last() for c in (*order, "__t")]
    done = folded(texts, by or ["__all"], places, StructType().add("checksum", "string"), lambda: hashlib.md5(usedforsecurity=False), step, lambda digest: [(digest.hexdigest(),)])
    if by:
        return done
    one = rows.sparkSession.range(1).select(F.lit(0).alias("__all"))
    return one.join(done, "__all", "left").select(F.coalesce("checksum", F.lit("empty")).alias("checksum"))


def multiset_checksum(rows: DataFrame, by: Sequence[str], text: Column) -> DataFrame:
    """A checksum that doesn't depend on order and is summed before the shuffle: of 60-bit numbers from each row's MD5."""
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(part).cast("decimal(38,0)").alias("checksum"))


def upload_plan(local: DataFrame, remote: DataFrame, newer_only: bool = False, delete: bool = False) -> DataFrame:
    """local and remote: name, size, modified_at. The action for each file and why."""
    a = local.select("name", F.col("size").alias("ls"), F.col("modified_at").alias("lt"))
    b = remote.select("name", F.col("size").alias("rs"), F.col("modified_at").alias("rt"))
    both = a.join(b, "name", "full_outer")
    if newer_only:
        why = F.when(F.col("lt") > F.col("rt"), "local is newer").otherwise("remote is up to date")
        known = F.when(F.col("lt") > F.col("rt"), "upload").otherwise("skip")
    else:
        why = F.when(F.col("ls") != F.col("rs"), "size mismatch").otherwise("already synced")
        known = F.when(F.col("ls") != F.col("rs"), "upload").otherwise("skip")
    action = F.when(F.col("rt").isNull(), "upload").when(F.col("lt").isNull(), "delete" if delete else "ignore").otherwise(known)
    reason = F.when(F.col("rt").isNull(), "new file").when(F.col("lt").isNull(), "not in local").otherwise(why)
    return both.select("name", action.alias("action"), reason.alias("reason"), F.coalesce("ls", "rs").alias("size")).where("action <> 'ignore'")


def region_plan(source: DataFrame, target: DataFrame, as_of: str, max_age_days: int | None = None, prefix: str | None = None, delete_orphans: bool = False) -> DataFrame:
    """Files to copy (missing or different) and, if asked, orphans to delete; only files of a prefix and age count."""
    def fit(df: DataFrame) -> DataFrame:
        df = df.where(F.col("name").startswith(prefix)) if prefix else df
        return df.where(x.seconds(F.col("modified_at"), F.lit(as_of).cast("timestamp_ntz")) <= max_age_days * 86400) if max_age_days else df

    plan = upload_plan(fit(source), fit(target), delete=delete_orphans)
    return plan.where("action <> 'skip'").select("name", F.when(F.col("action") == "upload", "copy").otherwise("delete").alias("action"), F.when(F.col("reason") == "new file", "missing").when(F.col("reason") == "size mismatch", "different").otherwise("orphan").alias("reason"), "size")


def orphan_objects(objects: DataFrame, references: Sequence[DataFrame]) -> DataFrame:
    """Object ids that no referencing column holds; nulls refer to nothing."""
    used = references[0].toDF("id")
    for r in references[1:]:
        used = used.unionByName(r.toDF("id"))
    return objects.join(used.where("id is not null"), "id", "left_anti")


def backup_metrics(catalog: DataFrame, as_of: str) -> DataFrame:
    """Of each named database: counts, the newest success, and seconds since."""
    good = F.col("status").isin("completed", "verified")
    last = F.max(F.when(good, F.struct("created_at", "id", "size_bytes", "duration")))
    g = catalog.where("database is not null and database not in ('', 'unknown')").groupBy("database").agg(F.count_if(F.col("backup_type") == "full").alias("full_n"), F.count_if(F.col("backup_type") == "incremental").alias("incremental_n"), F.count_if(good).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("verified_at").isNotNull()).alias("verified"), last.alias("l"))
    return g.select("database", "full_n", "incremental_n", "succeeded", "failed", "verified", F.col("l.created_at").alias("last_success"), F.col("l.size_bytes").alias("last_size"), F.round("l.duration", 6).alias("last_duration"), x.seconds(F.col("l.created_at"), F.lit(as_of).cast("timestamp_ntz")).alias("rpo_seconds"))


def restore_metrics(events: DataFrame) -> DataFrame:
    """Of each database: restores, failures, mean duration, the last one."""
    done = F.col("type") == "restore_completed"
    g = events.where("type in ('restore_completed', 'backup_failed')").groupBy("database").agg(F.count_if(done).alias("restores"), F.count_if(~done).alias("failures"), F.round(F.avg(F.when(done, F.col("duration_s"))), 6).alias("mean_duration"), F.max(F.when(done, F.struct("ts", "id"))).alias("l"))
    return g.select("database", "restores", "failures", "mean_duration", F.col("l.id").alias("last_id"))


def exposition(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """Lines of the metrics text format: name{label="..."} value."""
    text = F.regexp_replace(F.regexp_replace(F.col(label), r"\\", r"\\\\"), '"', r'\\"')
    return rows.select(F.concat(F.lit(f'{name}{{{label}="'), text, F.lit('"} '), F.col(value).cast("string")).alias("line"))


#: Framework, category, weight, control, and the rule group that judges it.
CONTROLS = (
    ("soc2", "security", 1.0, "CC6.1", "encryption"), ("soc2", "security", 1.0, "CC6.7", "generic"), ("soc2", "security", 1.0, "CC6.2", "generic"), ("soc2", "security", 1.0, "CC6.3", "generic"),
    ("soc2", "availability", 1.0, "A1.1", "policy"), ("soc2", "availability", 1.0, "A1.2", "testing"), ("soc2", "availability", 1.0, "A1.3", "procedures"), ("soc2", "availability", 1.0, "A1.4", "procedures"),
    ("soc2", "processing-integrity", 1.0, "PI1.1", "integrity"), ("soc2", "processing-integrity", 1.0, "PI1.2", "generic"),
    ("soc2", "confidentiality", 1.0, "C1.1", "generic"), ("soc2", "confidentiality", 1.0, "C1.2", "retention"), ("soc2", "confidentiality", 1.0, "C1.3", "generic"),
    ("gdpr", "data-protection", 1.0, "GDPR-25", "generic"), ("gdpr", "data-protection", 1.0, "GDPR-32", "encryption"), ("gdpr", "data-protection", 1.0, "GDPR-33", "generic"),
    ("gdpr", "data-retention", 1.0, "GDPR-5.1e", "retention"), ("gdpr", "data-retention", 1.0, "GDPR-17", "generic"),
    ("hipaa", "administrative", 1.0, "164.308a7", "generic"), ("hipaa", "administrative", 1.0, "164.308a7iA", "policy"), ("hipaa", "administrative", 1.0, "164.308a7iB", "procedures"), ("hipaa", "administrative", 1.0, "164.308a7iD", "testing"),
    ("hipaa", "technical", 1.0, "164.312a2iv", "encryption"), ("hipaa", "technical", 1.0, "164.312c1", "integrity"), ("hipaa", "technical", 1.0, "164.312e1", "generic"),
    ("pci", "protect", 1.0, "PCI-3.1", "retention"), ("pci", "protect", 1.0, "PCI-3.4", "encryption"), ("pci", "protect", 1.0, "PCI-3.5", "generic"), ("pci", "maintain", 1.0, "PCI-12.10.1", "procedures"),
    ("iso27001", "operations", 1.0, "A.12.3.1", "policy"), ("iso27001", "continuity", 1.0, "A.17.1.1", "procedures"), ("iso27001", "continuity", 1.0, "A.17.1.2", "procedures"), ("iso27001", "continuity", 1.0, "A.17.1.3", "testing"),
    ("iso27001", "cryptography", 1.0, "A.10.1.1", "encryption"), ("iso27001", "cryptography", 1.0, "A.10.1.2", "generic"),
)
#: What to do about controls that fail; others get the last one.
ADVICE = {
    "CC6.1": "Turn on encryption for every backup job", "CC6.7": "Send backups over encrypted connections only", "A1.1": "Write down when backups run, and keep to it", "A1.2": "Restore to a spare system at fixed intervals",
    "A1.3": "Describe the steps of a restore and try them out", "A1.4": "Plan for the loss of a site and rehearse it", "PI1.1": "Store a checksum with each backup and compare it later", "C1.2": "Set how long backups are kept, and delete them then",
    "164.312a2iv": "Encrypt backups that hold health records", "164.308a7iD": "Prove every three months that backups can be restored", "PCI-3.4": "Encrypt backups that hold card numbers", "": "Compare the control with its text and close what is missing",
}


def evidence(catalog: DataFrame) -> DataFrame:
    """One row of counts that the controls are judged by."""
    return catalog.where("status <> 'deleted'").agg(F.count("*").alias("backups"), F.count_if("encrypted").alias("encrypted"), F.count_if(F.col("drill_tested_at").isNotNull()).alias("drills"), F.count_if(F.col("sha256").isNotNull()).alias("hashed"))


def judged(facts: DataFrame) -> DataFrame:
    """facts: the row of evidence(). Every control with its status: the control list is short and lies in the plan."""
    listed = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(c).alias("category"), F.lit(w).alias("weight"), F.lit(i).alias("control"), F.lit(g).alias("rule")) for f, c, w, i, g in CONTROLS])
    rows = facts.select("*", F.explode(listed).alias("c")).select("backups", "encrypted", "drills", "hashed", "c.*")
    n, rate = F.col("backups"), 100.0 * F.col("encrypted") / F.col("backups")
    encryption = F.when(F.col("encrypted") == 0, "non_compliant").when(n == 0, "not_applicable").when(rate >= 100, "compliant").when(rate >= 90, "partial").otherwise("non_compliant")
    integrity = F.when((F.col("hashed") == n) & (n > 0), "compliant").when(F.col("hashed") > 0, "partial").otherwise("non_compliant")
    rule = F.col("rule")
    status = (
        F.when(rule == "encryption", encryption).when(rule == "policy", F.when(n == 0, "non_compliant").otherwise("compliant")).when(rule == "testing", F.when(F.col("drills") == 0, "non_compliant").otherwise("compliant"))
        .when(rule == "procedures", F.when(F.col("drills") > 0, "compliant").otherwise("partial")).when(rule == "integrity", integrity).when(rule == "retention", F.when(n > 0, "compliant").otherwise("partial")).otherwise(F.when(n > 0, "compliant").otherwise("unknown"))
    )
    return rows.select("framework", "category", "weight", "control", "rule", status.alias("status"))


def scores(controls: DataFrame) -> DataFrame:
    """Of each framework: its categories' weighted score (a partial control counts half), findings and risk."""
    points = F.when(F.col("status") == "compliant", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    counted = F.col("status") != "not_applicable"
    per = controls.groupBy("framework", "category").agg(F.max("weight").alias("weight"), F.sum(F.when(counted, points)).alias("points"), F.count_if(counted).alias("n"), F.count_if(F.col("status") == "compliant").alias("ok"), F.count_if((F.col("status") == "non_compliant") & (F.col("rule") == "encryption")).alias("high"), F.count_if((F.col("status") == "non_compliant") & (F.col("rule") != "encryption")).alias("medium"))
    per = per.withColumn("score", F.when(F.col("n") > 0, 100.0 * F.col("points") / F.col("n")).otherwise(0.0))
    g = per.groupBy("framework").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("score"), F.round(100.0 * F.sum("ok") / F.sum("n"), 6).alias("rate"), F.sum("high").alias("high"), F.sum("medium").alias("medium"))
    return g.withColumn("risk", 5 * F.col("high") + 2 * F.col("medium"))


def findings(controls: DataFrame) -> DataFrame:
    """A row for each control that fails: encryption is a high violation, the others are medium gaps."""
    advice = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ADVICE.items() for v in kv]), F.col("control")), F.lit(ADVICE[""]))
    high = F.col("rule") == "encryption"
    return controls.where("status = 'non_compliant'").select("framework", "control", F.when(high, "high").otherwise("medium").alias("severity"), F.when(high, "violation").otherwise("gap").alias("kind"), advice.alias("recommendation"))


RANKS = ("healthy", "warning", "critical")


def health(catalog: DataFrame, files: DataFrame, gaps: DataFrame, as_of: str, interval: int) -> DataFrame:
    """Checks with their status: freshness, gaps, verification, integrity of the ten newest, orphans among the fifty newest."""
    live = catalog.where("status <> 'deleted'")
    age = x.seconds(F.max("created_at"), F.lit(as_of).cast("timestamp_ntz"))
    checked = F.count_if(F.col("verified_at").isNotNull() & F.col("verify_valid"))
    f = live.agg(age.alias("age"), (100.0 * checked / F.count("*")).alias("pct"), F.count("*").alias("n"))
    fresh = f.select(F.lit("freshness").alias("name"), F.when(F.col("n") == 0, "critical").when(F.col("age") > 3 * interval, "critical").when(F.col("age") > interval, "warning").otherwise("healthy").alias("status"))
    proved = f.select(F.lit("verification").alias("name"), F.when((F.col("n") > 0) & (F.col("pct") < 25), "warning").otherwise("healthy").alias("status"))
    g = gaps.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"))
    holes = g.select(F.lit("gaps").alias("name"), F.when(F.col("c") > 0, "critical").when(F.col("n") > 0, "warning").otherwise("healthy").alias("status"))
    top = live.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50).withColumn("n", F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("id").desc())))
    here = files.select(F.col("path").alias("backup_path"), F.col("size").alias("__size"))
    seen = top.where("cloud_location is null").join(here, "backup_path", "left")
    s = seen.agg(F.count_if((F.col("n") <= 10) & F.col("__size").isNull()).alias("missing"), F.count_if((F.col("n") <= 10) & (F.col("__size") != F.col("size_bytes"))).alias("wrong"), F.count_if(F.col("__size").isNull()).alias("orphans"))
    whole = s.select(F.lit("integrity").alias("name"), F.when(F.col("missing") > 0, "critical").when(F.col("wrong") > 0, "warning").otherwise("healthy").alias("status"))
    lost = s.select(F.lit("orphans").alias("name"), F.when(F.col("orphans") > 0, "warning").otherwise("healthy").alias("status"))
    return fresh.unionByName(holes).unionByName(proved).unionByName(whole).unionByName(lost)


def health_summary(checks: DataFrame) -> DataFrame:
    """The worst status wins."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("status"))
    return checks.agg(F.count("*").alias("checks"), F.element_at(F.array(*map(F.lit, RANKS)), F.max(rank).cast("int")).alias("status"))


def drill_checks(checks: DataFrame, tables: DataFrame) -> DataFrame:
    """checks: check_id, kind, name, least, most, expected. Table existence and row counts against what is wanted."""
    out = checks.join(tables.select("name", "row_count"), "name", "left")
    n = F.col("row_count")
    ok = F.when(F.col("kind") == "table_exists", n.isNotNull()).when(n.isNull(), F.lit(False)).when(F.col("kind") == "row_count", n == F.col("expected")).otherwise((n >= F.coalesce("least", n)) & (n <= F.coalesce("most", n)))
    return out.select("check_id", "kind", "name", ok.alias("passed"))


def audit_entries(rows: DataFrame, payload: Column, by: Sequence[str], order: str) -> DataFrame:
    """A chain over rows: each entry's hash is that of its own payload; prev_hash points to the one before ('genesis' for the first). The order is a number."""
    h = rows.withColumn("payload", payload).withColumn("hash", F.sha2(payload.cast("binary"), 256))
    return _with_previous(h, by, order).withColumn("prev_hash", F.coalesce("before", F.lit("genesis"))).drop("before")


#: Entries of a chain, by number, that one window takes.
SPAN = 4096


def _with_previous(entries: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return previous(entries, by, F.floor(F.col(order) / SPAN), [order], {"hash": "before"})


def verify_chain(entries: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Each entry with whether its link and its own hash hold."""
    link = F.col("prev_hash") == F.coalesce("before", F.lit("genesis"))
    own = F.col("hash") == F.sha2(F.col("payload").cast("binary"), 256)
    return _with_previous(entries, by, order).select(*by, order, F.when(~own, "tampered").when(~link, "broken_link").otherwise("ok").alias("state"))


def sidecar_problems(rows: DataFrame) -> DataFrame:
    """rows: id, database, size_bytes, file_size, created_at, readable."""
    told = x.rules((~F.col("readable"), "malformed"), (F.coalesce("database", F.lit("")) == "", "no_name"), (F.col("file_size").isNotNull() & (F.col("file_size") != F.col("size_bytes")), "size_mismatch"), (F.col("created_at").isNull(), "no_timestamp"))
    return rows.select("id", F.array_join(told, ",").alias("problems"))


def percent_sample(rows: DataFrame, id: Column, percent: float, seed: int) -> DataFrame:
    """About so many percent of the rows, in tenths: those whose id's digest with the seed says so."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))
    return rows.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < round(10 * percent))
