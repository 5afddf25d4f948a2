"""Queries on verification, reports, health, metrics, events and copy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import proofs as p
from ..operators import reports
from ..operators import schedule as s
from ..operators.chains import previous, running
from ..sources.views import AS_OF
from .catalog import GAPS, aged
from .registry import query

REC = "rec AS (SELECT coalesce(s.name, d.name) AS name, coalesce(s.row_count, -1) AS source_rows, coalesce(d.row_count, -1) AS restored_rows, coalesce(s.row_count = d.row_count, false) AS match FROM tables_src s FULL JOIN tables_dst d ON s.name = d.name)"


@query("j1_reconcile", "tables_src", "tables_dst", sql=f"{REC} SELECT * FROM rec")
def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    return p.reconcile(a, b)


@query("j2_compare_databases", "tables_src", "tables_dst", sql="SELECT coalesce(s.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'missing_in_target' WHEN s.name IS NULL THEN 'extra_in_target' WHEN s.row_count <> d.row_count THEN 'row_mismatch' WHEN s.checksum <> d.checksum THEN 'checksum_mismatch' END AS difference, coalesce(d.row_count, 0) - coalesce(s.row_count, 0) AS row_delta FROM tables_src s FULL JOIN tables_dst d ON s.name = d.name WHERE CASE WHEN d.name IS NULL OR s.name IS NULL THEN true ELSE s.row_count <> d.row_count OR s.checksum <> d.checksum END")
def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    return p.compare_databases(a, b)


@query("a31_check_summary", "tables_src", "tables_dst", sql=f"{REC} SELECT count(*) AS tables, sum(greatest(source_rows, 0))::BIGINT AS source_rows, sum(greatest(restored_rows, 0))::BIGINT AS restored_rows, count(*) FILTER (NOT match) AS mismatches, count(*) FILTER (NOT match) = 0 AS ok FROM rec")
def check_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    return p.check_summary(p.reconcile(a, b))


@query("h1_name_union", "tables_src", "tables_dst", sql="SELECT name FROM tables_src UNION SELECT name FROM tables_dst")
def names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").union(b.select("name")).distinct()


@query("a30_table_checksum", "toc", sql="SELECT namespace, md5(string_agg(concat_ws('|', dump_id::VARCHAR, tag, data_length::VARCHAR), '' ORDER BY dump_id)) AS checksum FROM toc GROUP BY namespace")
def checksum(t: DataFrame) -> DataFrame:
    return p.table_checksum(t, ["namespace"], F.concat_ws("|", F.col("dump_id").cast("string"), "tag", F.col("data_length").cast("string")), ["dump_id"])


@query("a30_multiset_checksum", "backups", sql="SELECT database, count(*) AS rows, sum(('0x' || md5(concat_ws('|', id::VARCHAR, size_bytes::VARCHAR, status))[1:15])::BIGINT)::VARCHAR AS checksum FROM backups GROUP BY database")
def multiset(b: DataFrame) -> DataFrame:
    out = p.multiset_checksum(b, ["database"], F.concat_ws("|", F.col("id").cast("string"), F.col("size_bytes").cast("string"), "status"))
    return out.withColumn("checksum", F.col("checksum").cast("string"))


def _local(f: DataFrame) -> DataFrame:
    return f.select(F.col("path").alias("name"), "size", "modified_at")


def _remote(b: DataFrame) -> DataFrame:
    return b.where("cloud_location is not null").select(F.col("backup_path").alias("name"), F.col("size_bytes").alias("size"), (F.col("created_at") + F.expr("make_interval(0, 0, 0, int(id % 3) - 1)")).alias("modified_at"))


COPY = f"lo AS (SELECT path AS name, size, modified_at FROM files), re AS (SELECT backup_path AS name, size_bytes AS size, created_at + INTERVAL 1 DAY * (id % 3 - 1) AS modified_at FROM backups WHERE cloud_location IS NOT NULL), fj AS (SELECT coalesce(lo.name, re.name) AS name, lo.size AS ls, re.size AS rs, lo.modified_at AS lt, re.modified_at AS rt FROM lo FULL JOIN re ON lo.name = re.name)"


@query("j13_upload_plan", "files", "backups", sql=f"{COPY} SELECT name, CASE WHEN rt IS NULL THEN 'upload' WHEN lt IS NULL THEN 'delete' WHEN ls <> rs THEN 'upload' ELSE 'skip' END AS action, CASE WHEN rt IS NULL THEN 'new file' WHEN lt IS NULL THEN 'not in local' WHEN ls <> rs THEN 'size mismatch' ELSE 'already synced' END AS reason, coalesce(ls, rs) AS size FROM fj")
def upload(f: DataFrame, b: DataFrame) -> DataFrame:
    return p.upload_plan(_local(f), _remote(b), delete=True)


@query("j13_upload_newer", "files", "backups", sql=f"{COPY} SELECT name, CASE WHEN rt IS NULL OR lt > rt THEN 'upload' ELSE 'skip' END AS action, CASE WHEN rt IS NULL THEN 'new file' WHEN lt > rt THEN 'local is newer' ELSE 'remote is up to date' END AS reason, coalesce(ls, rs) AS size FROM fj WHERE lt IS NOT NULL")
def upload_newer(f: DataFrame, b: DataFrame) -> DataFrame:
    return p.upload_plan(_local(f), _remote(b), newer_only=True)


@query("j14_region_plan", "files", "backups", sql=f"lo AS (SELECT path AS name, size, modified_at FROM files WHERE path LIKE '/b/B%' AND {aged('modified_at')} <= 2000 * 86400), re AS (SELECT * FROM (SELECT backup_path AS name, size_bytes AS size, created_at + INTERVAL 1 DAY * (id % 3 - 1) AS modified_at FROM backups WHERE cloud_location IS NOT NULL) WHERE name LIKE '/b/B%' AND {aged('modified_at')} <= 2000 * 86400) SELECT coalesce(lo.name, re.name) AS name, CASE WHEN lo.name IS NULL THEN 'delete' ELSE 'copy' END AS action, CASE WHEN re.name IS NULL THEN 'missing' WHEN lo.name IS NULL THEN 'orphan' ELSE 'different' END AS reason, coalesce(lo.size, re.size) AS size FROM lo FULL JOIN re ON lo.name = re.name WHERE lo.name IS NULL OR re.name IS NULL OR lo.size <> re.size")
def region(f: DataFrame, b: DataFrame) -> DataFrame:
    return p.region_plan(_local(f), _remote(b), AS_OF, 2000, "/b/B", True)


@query("j15_orphan_objects", "toc", "tables", sql="SELECT dump_id AS id FROM toc WHERE dump_id NOT IN (SELECT table_id * 2 FROM tables) AND dump_id NOT IN (SELECT table_id * 3 FROM tables WHERE table_id % 7 <> 0)")
def orphans(t: DataFrame, u: DataFrame) -> DataFrame:
    return p.orphan_objects(t.select(F.col("dump_id").alias("id")), [u.select((F.col("table_id") * 2)), u.select(F.when(F.col("table_id") % 7 != 0, F.col("table_id") * 3))])


METRICS = f"mt AS (SELECT database, count(*) FILTER (backup_type = 'full') AS full_n, count(*) FILTER (backup_type = 'incremental') AS incremental_n, count(*) FILTER (status IN ('completed', 'verified')) AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (verified_at IS NOT NULL) AS verified, max(CASE WHEN status IN ('completed', 'verified') THEN struct_pack(a := created_at, i := id, s := size_bytes, d := duration) END) AS l FROM backups GROUP BY database), met AS (SELECT database, full_n, incremental_n, succeeded, failed, verified, l.a AS last_success, l.s AS last_size, round(l.d, 6) AS last_duration, {aged('l.a')} AS rpo_seconds FROM mt)"


@query("a8_backup_metrics", "backups", sql=f"{METRICS} SELECT * FROM met")
def backup_metrics(b: DataFrame) -> DataFrame:
    return p.backup_metrics(b, AS_OF)


@query("s18_exposition", "backups", sql=f"""{METRICS} SELECT 'backup_rpo_seconds{{database="' || database || '"}} ' || rpo_seconds AS line FROM met""")
def exposition(b: DataFrame) -> DataFrame:
    return p.exposition(p.backup_metrics(b, AS_OF), "backup_rpo_seconds", "database", "rpo_seconds")


@query("a9_restore_metrics", "oplog", sql="SELECT database, count(*) FILTER (type = 'restore_completed') AS restores, count(*) FILTER (type <> 'restore_completed') AS failures, round(avg(duration_s) FILTER (type = 'restore_completed'), 6) AS mean_duration, max(CASE WHEN type = 'restore_completed' THEN struct_pack(t := ts, i := id) END).i AS last_id FROM oplog WHERE type IN ('restore_completed', 'backup_failed') GROUP BY database")
def restore_metrics(o: DataFrame) -> DataFrame:
    return p.restore_metrics(o)


@query("a32_latest_restore", "oplog", sql="SELECT database, id, ts FROM oplog WHERE type = 'restore_completed' QUALIFY row_number() OVER (PARTITION BY database ORDER BY ts DESC, id DESC) = 1")
def latest_restore(o: DataFrame) -> DataFrame:
    m = o.where("type = 'restore_completed'").groupBy("database").agg(F.max(F.struct("ts", "id")).alias("m"))
    return m.select("database", "m.id", "m.ts")


@query("j8_databases_without_entry", "oplog", "backups", sql="SELECT DISTINCT database FROM oplog WHERE database NOT IN (SELECT lower(database) FROM backups)")
def without_entry(o: DataFrame, b: DataFrame) -> DataFrame:
    return o.select("database").distinct().join(b.select(F.lower("database").alias("database")), "database", "left_anti")


@query("j11_merged_restores", "oplog", "iterations", sql="m AS (SELECT database, 1 AS n, duration_s AS d FROM oplog WHERE type = 'restore_completed' UNION ALL SELECT 'db' || iteration % 20, 1, duration_sec FROM iterations WHERE phase = 'purchase') SELECT database, sum(n)::BIGINT AS restores, round(avg(d), 6) AS mean_duration FROM m GROUP BY database")
def merged(o: DataFrame, i: DataFrame) -> DataFrame:
    both = o.where("type = 'restore_completed'").select("database", F.col("duration_s").alias("d")).unionByName(i.where("phase = 'purchase'").select(F.concat(F.lit("db"), (F.col("iteration") % 20).cast("string")).alias("database"), F.col("duration_sec").alias("d")))
    return both.groupBy("database").agg(F.count("*").alias("restores"), F.round(F.avg("d"), 6).alias("mean_duration"))


_LIST = ", ".join(f"('{f}', '{c}', {w}::DOUBLE, '{i}', '{r}')" for f, c, w, i, r in p.CONTROLS)
JUDGED = f"""
ev AS (SELECT count(*) AS b, count(*) FILTER (encrypted) AS e, count(*) FILTER (drill_tested_at IS NOT NULL) AS d, count(*) FILTER (sha256 IS NOT NULL) AS h FROM backups WHERE status <> 'deleted'), cl(framework, category, weight, control, rule) AS (VALUES {_LIST}),
ju AS (SELECT framework, category, weight, control, rule, CASE rule WHEN 'encryption' THEN CASE WHEN e = 0 THEN 'non_compliant' WHEN b = 0 THEN 'not_applicable' WHEN 100.0 * e / b >= 100 THEN 'compliant' WHEN 100.0 * e / b >= 90 THEN 'partial' ELSE 'non_compliant' END WHEN 'policy' THEN CASE WHEN b = 0 THEN 'non_compliant' ELSE 'compliant' END WHEN 'testing' THEN CASE WHEN d = 0 THEN 'non_compliant' ELSE 'compliant' END WHEN 'procedures' THEN CASE WHEN d > 0 THEN 'compliant' ELSE 'partial' END WHEN 'integrity' THEN CASE WHEN h = b AND b > 0 THEN 'compliant' WHEN h > 0 THEN 'partial' ELSE 'non_compliant' END WHEN 'retention' THEN CASE WHEN b > 0 THEN 'compliant' ELSE 'partial' END ELSE CASE WHEN b > 0 THEN 'compliant' ELSE 'unknown' END END AS status FROM cl, ev)"""


@query("x41_controls", "backups", sql=f"{JUDGED} SELECT * FROM ju")
def controls(b: DataFrame) -> DataFrame:
    return p.judged(p.evidence(b))


@query("j9_evidence", "backups", sql="SELECT count(*) AS backups, count(*) FILTER (encrypted) AS encrypted, count(*) FILTER (drill_tested_at IS NOT NULL) AS drills, count(*) FILTER (sha256 IS NOT NULL) AS hashed FROM backups WHERE status <> 'deleted'")
def evidence(b: DataFrame) -> DataFrame:
    return p.evidence(b)


@query("a20_scores", "backups", sql=f"""{JUDGED},
pc AS (SELECT framework, category, max(weight) AS w, 100.0 * sum(CASE status WHEN 'compliant' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS s, count(*) AS n, count(*) FILTER (status = 'compliant') AS ok, count(*) FILTER (status = 'non_compliant' AND rule = 'encryption') AS hi, count(*) FILTER (status = 'non_compliant' AND rule <> 'encryption') AS me FROM ju GROUP BY framework, category)
SELECT framework, round(sum(s * w) / sum(w), 6) AS score, round(100.0 * sum(ok)::DOUBLE / sum(n), 6) AS rate, sum(hi)::BIGINT AS high, sum(me)::BIGINT AS medium, (5 * sum(hi) + 2 * sum(me))::BIGINT AS risk FROM pc GROUP BY framework""")
def scores(b: DataFrame) -> DataFrame:
    return p.scores(p.judged(p.evidence(b)))


_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.ADVICE.items() if k)


@query("a35_findings", "backups", sql=f"{JUDGED} SELECT framework, control, CASE WHEN rule = 'encryption' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN rule = 'encryption' THEN 'violation' ELSE 'gap' END AS kind, CASE control {_ADVICE} ELSE '{p.ADVICE['']}' END AS recommendation FROM ju WHERE status = 'non_compliant'")
def findings(b: DataFrame) -> DataFrame:
    return p.findings(p.judged(p.evidence(b)))


REPORT = f"""{JUDGED},
pc AS (SELECT framework, category, max(weight) AS w, 100.0 * sum(CASE status WHEN 'compliant' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS s, count(*) AS n, count(*) FILTER (status = 'compliant') AS ok, count(*) FILTER (status = 'non_compliant' AND rule = 'encryption') AS hi, count(*) FILTER (status = 'non_compliant' AND rule <> 'encryption') AS me FROM ju GROUP BY framework, category),
wh AS (SELECT framework, printf('%.1f', round(sum(s * w) / sum(w), 1)) AS score, printf('%.1f', round(100.0 * sum(ok)::DOUBLE / sum(n), 1)) AS rate, (5 * sum(hi) + 2 * sum(me))::BIGINT AS risk, sum(s * w) / sum(w) >= 100 AS whole, sum(hi) + sum(me) > 0 AS bad FROM pc GROUP BY framework),
st AS (SELECT *, CASE WHEN whole THEN 'compliant' WHEN bad THEN 'non_compliant' ELSE 'partial' END AS status FROM wh),
ca AS (SELECT framework, category AS name, printf('%.1f', round(s, 1)) AS score, CASE WHEN round(s, 1) >= 100 THEN 'compliant' WHEN s > 0 THEN 'partial' ELSE 'non_compliant' END AS status FROM pc),
fi AS (SELECT framework, control, CASE WHEN rule = 'encryption' THEN 'high' ELSE 'medium' END AS severity, CASE control {_ADVICE} ELSE '{p.ADVICE['']}' END AS recommendation FROM ju WHERE status = 'non_compliant')"""
_N = "chr(10)"


def _report(style: str, b: DataFrame) -> DataFrame:
    return reports.render(p.judged(p.evidence(b)), style, "Backup controls", AS_OF)


@query("s19_report_markdown", "backups", sql=f"""{REPORT},
cl2 AS (SELECT framework, string_agg('| ' || name || ' | ' || score || ' | ' || status || ' |', {_N} ORDER BY name) AS t FROM ca GROUP BY framework), fl AS (SELECT framework, string_agg('| ' || control || ' | ' || severity || ' | ' || recommendation || ' |', {_N} ORDER BY control) AS t FROM fi GROUP BY framework)
SELECT framework, concat_ws({_N}, '# Backup controls: ' || framework, '', 'Made at {AS_OF}. State: ' || status || '. Score ' || score || ' %, rate ' || rate || ' %, risk ' || risk || '.', '', '| Category | Score | State |', '|-|-|-|', cl2.t, '', '| Control | Severity | What to do |', '|-|-|-|', fl.t) AS report FROM st JOIN cl2 USING (framework) LEFT JOIN fl USING (framework)""")
def report_markdown(b: DataFrame) -> DataFrame:
    return _report("markdown", b)


@query("s19_report_html", "backups", sql=f"""{REPORT},
cl2 AS (SELECT framework, string_agg('<tr class="' || status || '"><td>' || name || '</td><td>' || score || '</td></tr>', {_N} ORDER BY name) AS t FROM ca GROUP BY framework), fl AS (SELECT framework, string_agg('<tr class="' || severity || '"><td>' || control || '</td><td>' || recommendation || '</td></tr>', {_N} ORDER BY control) AS t FROM fi GROUP BY framework)
SELECT framework, concat_ws({_N}, '<!DOCTYPE html>', '<html><head><meta charset="UTF-8"><title>Backup controls</title></head><body>', '<h1>Backup controls: ' || framework || '</h1>', '<p class="' || status || '">Made at {AS_OF}. Score ' || score || ' %, rate ' || rate || ' %, risk ' || risk || '.</p>', '<table>', cl2.t, '</table>', '<table>', fl.t, '</table>', '</body></html>') AS report FROM st JOIN cl2 USING (framework) LEFT JOIN fl USING (framework)""")
def report_html(b: DataFrame) -> DataFrame:
    return _report("html", b)


@query("s19_report_console", "backups", sql=f"""{REPORT},
cl2 AS (SELECT framework, string_agg('  ' || rpad(CASE status WHEN 'compliant' THEN '[ok]' WHEN 'partial' THEN '[part]' ELSE '[fail]' END, 7, ' ') || rpad(name, 24, ' ') || score, {_N} ORDER BY name) AS t FROM ca GROUP BY framework), fl AS (SELECT framework, string_agg('  ' || rpad(severity, 7, ' ') || rpad(control, 24, ' ') || recommendation, {_N} ORDER BY control) AS t FROM fi GROUP BY framework)
SELECT framework, concat_ws({_N}, 'Backup controls: ' || framework, 'made at {AS_OF}, ' || status || ', score ' || score || ' %, rate ' || rate || ' %, risk ' || risk, 'categories', cl2.t, 'findings', fl.t) AS report FROM st JOIN cl2 USING (framework) LEFT JOIN fl USING (framework)""")
def report_console(b: DataFrame) -> DataFrame:
    return _report("console", b)


@query("s19_report_json", "backups", sql=f"""{REPORT},
cl2 AS (SELECT framework, string_agg('{{{{"name":"' || name || '","score":' || score || ',"status":"' || status || '"}}}}', ',' ORDER BY name) AS t FROM ca GROUP BY framework), fl AS (SELECT framework, string_agg('{{{{"control":"' || control || '","severity":"' || severity || '","recommendation":"' || recommendation || '"}}}}', ',' ORDER BY control) AS t FROM fi GROUP BY framework)
SELECT framework, '{{{{"title":"Backup controls","framework":"' || framework || '","generated_at":"{AS_OF}","status":"' || status || '","score":' || score || ',"rate":' || rate || ',"risk":' || risk || ',"categories":[' || cl2.t || '],"findings":[' || coalesce(fl.t, '') || ']}}}}' AS report FROM st JOIN cl2 USING (framework) LEFT JOIN fl USING (framework)""".replace("{{", "{").replace("}}", "}"))
def report_json(b: DataFrame) -> DataFrame:
    return _report("json", b)


HEALTH = f"""{GAPS}, live AS (SELECT * FROM backups WHERE status <> 'deleted'),
ag AS (SELECT epoch(TIMESTAMP '{AS_OF}')::BIGINT - epoch(max(created_at))::BIGINT AS age, 100.0 * count(*) FILTER (verified_at IS NOT NULL AND verify_valid) / count(*) AS pct, count(*) AS n FROM live), gc AS (SELECT count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM gaps),
tp AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM live QUALIFY r <= 50), sn AS (SELECT count(*) FILTER (r <= 10 AND size IS NULL) AS missing, count(*) FILTER (r <= 10 AND size <> size_bytes) AS wrong, count(*) FILTER (size IS NULL) AS orphans FROM tp LEFT JOIN files ON path = backup_path WHERE cloud_location IS NULL),
hc AS (SELECT 'freshness' AS name, CASE WHEN n = 0 OR age > 259200 THEN 'critical' WHEN age > 86400 THEN 'warning' ELSE 'healthy' END AS status FROM ag UNION ALL SELECT 'gaps', CASE WHEN c > 0 THEN 'critical' WHEN n > 0 THEN 'warning' ELSE 'healthy' END FROM gc UNION ALL SELECT 'verification', CASE WHEN n > 0 AND pct < 25 THEN 'warning' ELSE 'healthy' END FROM ag UNION ALL SELECT 'integrity', CASE WHEN missing > 0 THEN 'critical' WHEN wrong > 0 THEN 'warning' ELSE 'healthy' END FROM sn UNION ALL SELECT 'orphans', CASE WHEN orphans > 0 THEN 'warning' ELSE 'healthy' END FROM sn)"""


def _health(b: DataFrame, f: DataFrame) -> DataFrame:
    return p.health(b, f, s.gaps(b, s.Schedule(86400, 21600, 172800), AS_OF), AS_OF, 86400)


@query("x42_health_checks", "backups", "files", sql=f"{HEALTH} SELECT * FROM hc")
def health(b: DataFrame, f: DataFrame) -> DataFrame:
    return _health(b, f)


@query("a21_health", "backups", "files", sql=f"{HEALTH} SELECT count(*) AS checks, CASE max(CASE status WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'healthy' END AS status FROM hc")
def health_summary(b: DataFrame, f: DataFrame) -> DataFrame:
    return p.health_summary(_health(b, f))


@query("x43_drill_checks", "tables_src", "tables_dst", sql="c AS (SELECT name, row_count AS expected, row_number() OVER (ORDER BY name) AS i FROM tables_src), k AS (SELECT name || ':' || (i % 3) AS check_id, CASE i % 3 WHEN 0 THEN 'table_exists' WHEN 1 THEN 'row_count' ELSE 'range' END AS kind, c.name, expected, d.row_count AS n FROM c LEFT JOIN tables_dst d USING (name)) SELECT check_id, kind, name, CASE kind WHEN 'table_exists' THEN n IS NOT NULL ELSE coalesce(CASE kind WHEN 'row_count' THEN n = expected ELSE n >= expected - 5 AND n <= expected + 5 END, false) END AS passed FROM k")
def drills(a: DataFrame, b: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.orderBy("name"))
    c = a.select("name", F.col("row_count").alias("expected"), i.alias("i"))
    c = c.select(F.concat_ws(":", "name", (F.col("i") % 3).cast("string")).alias("check_id"), F.when(F.col("i") % 3 == 0, "table_exists").when(F.col("i") % 3 == 1, "row_count").otherwise("range").alias("kind"), "name", "expected", (F.col("expected") - 5).alias("least"), (F.col("expected") + 5).alias("most"))
    return p.drill_checks(c, b)


@query("w8_audit_chain", "oplog", sql="e AS (SELECT database, id, type, CASE WHEN id % 97 = 0 THEN 'x' ELSE '' END AS bad, sha256(concat_ws('|', id::VARCHAR, type, severity)) AS h FROM oplog), l AS (SELECT *, lag(h, 1, 'genesis') OVER (PARTITION BY database ORDER BY id) AS ph FROM e), t AS (SELECT *, CASE WHEN id % 89 = 0 THEN 'forged' ELSE ph END AS prev FROM l) SELECT database, id, CASE WHEN bad = 'x' THEN 'tampered' WHEN prev <> ph THEN 'broken_link' ELSE 'ok' END AS state FROM t")
def audit(o: DataFrame) -> DataFrame:
    e = p.audit_entries(o, F.concat_ws("|", F.col("id").cast("string"), "type", "severity"), ["database"], "id")
    e = e.withColumn("payload", F.when(F.col("id") % 97 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))).withColumn("prev_hash", F.when(F.col("id") % 89 == 0, "forged").otherwise(F.col("prev_hash")))
    return p.verify_chain(e, ["database"], "id")


@query("x46_sidecar_problems", "backups", "files", sql="SELECT id, concat_ws(',', CASE WHEN id % 101 = 0 THEN 'malformed' END, CASE WHEN id % 103 = 0 THEN 'no_name' END, CASE WHEN size <> size_bytes THEN 'size_mismatch' END, CASE WHEN id % 107 = 0 THEN 'no_timestamp' END) AS problems FROM backups LEFT JOIN files ON path = backup_path")
def sidecars(b: DataFrame, f: DataFrame) -> DataFrame:
    rows = b.join(f.select(F.col("path").alias("backup_path"), F.col("size").alias("file_size")), "backup_path", "left")
    rows = rows.withColumn("readable", F.col("id") % 101 != 0).withColumn("database", F.when(F.col("id") % 103 != 0, F.col("database"))).withColumn("created_at", F.when(F.col("id") % 107 != 0, F.col("created_at")))
    return p.sidecar_problems(rows)


@query("x39_severities", "oplog", sql="SELECT id, CASE severity WHEN 'warning' THEN 2 WHEN 'error' THEN 3 ELSE 0 END::INT AS rank, severity IN ('warning', 'error') AS notify FROM oplog")
def severities(o: DataFrame) -> DataFrame:
    rank = x.severity_rank(F.col("severity"))
    return o.select("id", rank.alias("rank"), (rank >= 2).alias("notify"))


@query("x40_deltas", "backups", sql="SELECT database, id, size_bytes - lag(size_bytes) OVER w AS size_delta, round(duration - lag(duration) OVER w, 6) AS duration_delta FROM backups WINDOW w AS (PARTITION BY database ORDER BY created_at, id)")
def deltas(b: DataFrame) -> DataFrame:
    rows = previous(b, ["database"], F.date_trunc("month", "created_at"), ["created_at", "id"], {"size_bytes": "size_before", "duration": "duration_before"})
    return rows.select("database", "id", (F.col("size_bytes") - F.col("size_before")).alias("size_delta"), F.round(F.col("duration") - F.col("duration_before"), 6).alias("duration_delta"))


@query("p1_every_nth", "backups", sql="SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY database ORDER BY id) AS r FROM backups) WHERE r % 10 = 1")
def every_nth(b: DataFrame) -> DataFrame:
    """A sampling operator: every tenth row of each database, by id."""
    return running(b, ["database"], F.floor(F.col("id") / 4096), ["id"], F.lit(1), "r").where("r % 10 = 0").select("id")


@query("p2_percent", "backups", sql="SELECT id FROM backups WHERE ('0x' || md5('11/' || id)[1:8])::BIGINT % 1000 < 100")
def percent(b: DataFrame) -> DataFrame:
    """A sampling operator: a tenth of the rows, by a digest of the id, so that it doesn't change with partitions."""
    return p.percent_sample(b, F.col("id"), 10.0, 11).select("id")


@query("p3_first_n", "backups", sql="SELECT id FROM backups ORDER BY id LIMIT 1000")
def first_n(b: DataFrame) -> DataFrame:
    """A sampling operator: the first thousand by id."""
    return b.orderBy("id").limit(1000).select("id")
