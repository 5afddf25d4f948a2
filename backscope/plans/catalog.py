"""Queries over the catalog, the schedule and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import catalog as c
from ..operators import retention as r
from ..operators import schedule as s
from ..sources.views import AS_OF
from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
SLIM = ("id", "database", "status", "size_bytes", "created_at")


def aged(column: str = "created_at", now: str = NOW) -> str:
    return f"(epoch({now})::BIGINT - epoch({column})::BIGINT)"


@query("s1_scan", "backups", sql="SELECT * FROM backups")
def scan(b: DataFrame) -> DataFrame:
    return b


@query("s2_lookup_id", "backups", sql="SELECT * FROM backups WHERE id = 7")
def by_id(b: DataFrame) -> DataFrame:
    return c.lookup(b, "id", 7)


@query("s2_lookup_path", "backups", sql="SELECT * FROM backups WHERE backup_path = '/b/BUILDING/32'")
def by_path(b: DataFrame) -> DataFrame:
    return c.lookup(b, "backup_path", "/b/BUILDING/32")


@query("f1_search", "backups", sql="SELECT id, database, status, size_bytes, created_at FROM backups WHERE database LIKE 'B%' AND database_type = 'mysql' AND status = 'completed' AND backup_type = 'incremental' AND created_at BETWEEN '1995-01-01' AND '1999-12-31' AND size_bytes >= 100000 AND size_bytes <= 30000000000 AND encrypted")
def search(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search("B*", "mysql", None, "completed", "1995-01-01", "1999-12-31", 100_000, 30_000_000_000, "incremental", True)).select(*SLIM)


@query("f1_search_host", "backups", sql="SELECT id, database, status, size_bytes, created_at FROM backups WHERE host = 'host3'")
def search_host(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(host="host3")).select(*SLIM)


@query("f2_verified", "backups", sql="SELECT id FROM backups WHERE verified_at IS NOT NULL AND verify_valid")
def verified(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(verified=True)).select("id")


@query("f2_unverified", "backups", sql="SELECT id FROM backups WHERE verified_at IS NULL")
def unverified(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(verified=False)).select("id")


@query("f2_drill_tested", "backups", sql="SELECT id FROM backups WHERE drill_tested_at IS NOT NULL AND drill_success")
def drill_tested(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(drill_tested=True)).select("id")


@query("a1_stats", "backups", sql="SELECT count(*) AS total_backups, coalesce(sum(size_bytes), 0)::BIGINT AS total_size, min(created_at) AS oldest, max(created_at) AS newest, round(avg(duration), 6) AS avg_duration, (sum(size_bytes) // count(size_bytes))::BIGINT AS avg_size, count(*) FILTER (verified_at IS NOT NULL AND verify_valid) AS verified, count(*) FILTER (drill_tested_at IS NOT NULL AND drill_success) AS drill_tested FROM backups WHERE status <> 'deleted'")
def stats(b: DataFrame) -> DataFrame:
    return c.stats(b)


@query("a2_counts", "backups", sql="SELECT 'database' AS kind, database AS value, count(*) AS n FROM backups GROUP BY 2 UNION ALL SELECT 'database_type', database_type, count(*) FROM backups GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM backups GROUP BY 2")
def counts(b: DataFrame) -> DataFrame:
    return c.counts(b)


@query("a3_stats_by_database", "backups", sql="SELECT database, count(*) AS total_backups, coalesce(sum(size_bytes), 0)::BIGINT AS total_size, min(created_at) AS oldest, max(created_at) AS newest, round(avg(duration), 6) AS avg_duration, (sum(size_bytes) // count(size_bytes))::BIGINT AS avg_size, count(*) FILTER (verified_at IS NOT NULL AND verify_valid) AS verified, count(*) FILTER (drill_tested_at IS NOT NULL AND drill_success) AS drill_tested FROM backups WHERE status <> 'deleted' GROUP BY database")
def stats_by_database(b: DataFrame) -> DataFrame:
    return c.stats_by_database(b)


@query("a4_count", "backups", sql="SELECT count(*) AS n FROM backups WHERE status = 'failed' AND size_bytes >= 5000000000")
def count(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(status="failed", min_size=5_000_000_000)).agg(F.count("*").alias("n"))


@query("a5_databases", "backups", sql="SELECT DISTINCT database FROM backups ORDER BY 1")
def databases(b: DataFrame) -> DataFrame:
    return c.databases(b)


@query("a6_sync_status", "backups", sql="SELECT count(*) AS total, count(*) FILTER (status <> 'deleted') AS active, count(*) FILTER (status = 'deleted') AS deleted, count(DISTINCT regexp_extract(backup_path, '^(.*)/', 1)) AS folders FROM backups")
def sync_status(b: DataFrame) -> DataFrame:
    return c.sync_status(b)


@query("t1_search_page", "backups", sql="SELECT id, database, status, size_bytes, created_at FROM backups ORDER BY created_at DESC, id LIMIT 100 OFFSET 50")
def page(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(limit=100, offset=50)).select(*SLIM)


@query("t2_newest_of_database", "backups", sql="SELECT id, created_at FROM backups WHERE database = 'MACHINERY' ORDER BY created_at DESC, id LIMIT 20")
def newest_of(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search("MACHINERY", limit=20)).select("id", "created_at")


@query("t3_oldest", "backups", sql="SELECT id, created_at FROM backups ORDER BY created_at, id LIMIT 10")
def oldest(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(descending=False, limit=10)).select("id", "created_at")


@query("t15_browser_page", "backups", sql="SELECT id, database, size_bytes FROM backups WHERE status = 'verified' ORDER BY size_bytes DESC, id LIMIT 25 OFFSET 25")
def browser(b: DataFrame) -> DataFrame:
    return c.search(b, c.Search(status="verified", order_by="size_bytes", limit=25, offset=25)).select("id", "database", "size_bytes")


@query("s5_directory_sync", "backups", "files", sql="SELECT coalesce(backup_path, path) AS backup_path, id, CASE WHEN id IS NULL THEN 'added' WHEN modified_at IS NULL THEN 'deleted' WHEN size <> size_bytes THEN 'updated' ELSE 'unchanged' END AS action, coalesce(size, size_bytes) AS size_bytes, coalesce(created_at, modified_at) AS created_at, CASE WHEN id IS NOT NULL AND modified_at IS NULL THEN 'deleted' ELSE coalesce(status, 'completed') END AS status, verified_at, verify_valid, drill_tested_at FROM backups FULL JOIN files ON path = backup_path")
def directory_sync(b: DataFrame, f: DataFrame) -> DataFrame:
    return c.sync(b, f)


@query("j3_files_without_entry", "files", "backups", sql="SELECT path, size FROM files WHERE path NOT IN (SELECT backup_path FROM backups)")
def strangers(f: DataFrame, b: DataFrame) -> DataFrame:
    return f.join(b.select(F.col("backup_path").alias("path")), "path", "left_anti").select("path", "size")


@query("j3_entries_with_file", "backups", "files", sql="SELECT id FROM backups WHERE backup_path IN (SELECT path FROM files)")
def present(b: DataFrame, f: DataFrame) -> DataFrame:
    return b.join(f.select(F.col("path").alias("backup_path")), "backup_path", "left_semi").select("id")


@query("d1_insert", "backups", sql="SELECT id, backup_path FROM backups WHERE backup_type = 'full' OR encrypted")
def insert(b: DataFrame) -> DataFrame:
    return c.insert(b.where("backup_type = 'full'"), b.where("backup_type = 'full' or encrypted")).select("id", "backup_path")


@query("d2_update", "backups", sql="SELECT id, CASE WHEN status = 'failed' THEN 0 ELSE size_bytes END AS size_bytes, created_at FROM backups")
def update(b: DataFrame) -> DataFrame:
    changes = b.where("status = 'failed'").select("id", F.lit(0).cast("long").alias("size_bytes"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"))
    return c.update(b, changes, ["size_bytes", "created_at"]).select("id", "size_bytes", "created_at")


@query("d3_delete", "backups", sql="SELECT id FROM backups WHERE status <> 'failed'")
def delete(b: DataFrame) -> DataFrame:
    return c.delete(b, b.where("status = 'failed'")).select("id")


@query("d4_mark_verified", "backups", sql=f"SELECT id, CASE WHEN status = 'completed' THEN CASE WHEN sha256 IS NOT NULL THEN 'verified' ELSE 'corrupted' END ELSE status END AS status, CASE WHEN status = 'completed' THEN {NOW} ELSE verified_at END AS verified_at, CASE WHEN status = 'completed' THEN sha256 IS NOT NULL ELSE verify_valid END AS verify_valid FROM backups")
def mark_verified(b: DataFrame) -> DataFrame:
    return c.mark_verified(b, b.where("status = 'completed'").select("id", F.col("sha256").isNotNull().alias("valid")), AS_OF).select("id", "status", "verified_at", "verify_valid")


@query("d4_mark_drill_tested", "backups", sql=f"SELECT id, CASE WHEN backup_type = 'full' THEN {NOW} ELSE drill_tested_at END AS drill_tested_at, CASE WHEN backup_type = 'full' THEN status <> 'failed' ELSE drill_success END AS drill_success FROM backups")
def mark_drill(b: DataFrame) -> DataFrame:
    return c.mark_drill_tested(b, b.where("backup_type = 'full'").select("id", (F.col("status") != "failed").alias("success")), AS_OF).select("id", "drill_tested_at", "drill_success")


@query("s17_export", "backups", sql=f"""
u AS (SELECT *, CASE WHEN size_bytes < 1024 ** 2 THEN 1 WHEN size_bytes < 1024 ** 3 THEN 2 WHEN size_bytes < 1024 ** 4 THEN 3 ELSE 4 END AS k, floor(duration)::BIGINT AS d, {aged()} AS a FROM backups)
SELECT id::VARCHAR AS id, database, database_type, host, backup_path, backup_type, size_bytes::VARCHAR AS size_bytes, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE format('{{:.1f}}', round_even(size_bytes / 1024.0 ** k, 1)) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS size,
  compression, encrypted::VARCHAR AS encrypted, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN d < 60 THEN d || 's' WHEN d < 3600 THEN d // 60 || 'm ' || d % 60 || 's' ELSE d // 3600 || 'h ' || d % 3600 // 60 || 'm' END AS duration, status,
  CASE WHEN verified_at IS NULL THEN 'no' WHEN verify_valid THEN 'yes' ELSE 'failed' END AS verified, coalesce(strftime(verified_at, '%Y-%m-%d %H:%M:%S'), '') AS verified_at, CASE WHEN drill_tested_at IS NULL THEN 'no' WHEN drill_success THEN 'yes' ELSE 'failed' END AS drill_tested, coalesce(strftime(drill_tested_at, '%Y-%m-%d %H:%M:%S'), '') AS drill_tested_at,
  coalesce(cloud_location, '') AS cloud_location, coalesce(sha256, '') AS sha256, CASE WHEN a < 3600 THEN a // 60 || 'm' WHEN a < 86400 THEN a // 3600 || 'h' WHEN a < 2592000 THEN a // 86400 || 'd' WHEN a < 31536000 THEN a // 2592000 || 'mo' ELSE a // 31536000 || 'y' END AS age FROM u""")
def export(b: DataFrame) -> DataFrame:
    return c.export(b, AS_OF)


@query("r5_prune_candidates", "backups", "files", sql=f"SELECT id, database, backup_path, size_bytes, reason FROM (SELECT *, CASE WHEN cloud_location IS NULL AND backup_path NOT IN (SELECT path FROM files) THEN 'missing' WHEN {aged()} > 1000 * 86400 THEN 'age' WHEN status = 'failed' THEN 'status' END AS reason FROM backups WHERE database = 'FURNITURE') WHERE reason IS NOT NULL")
def prune(b: DataFrame, f: DataFrame) -> DataFrame:
    return c.prune_candidates(b, AS_OF, 1000, "FURNITURE", "failed", f)


@query("r6_forget_deleted", "backups", sql="SELECT id, status FROM backups WHERE NOT (status = 'deleted' AND created_at < TIMESTAMP '1998-01-01')")
def forget(b: DataFrame) -> DataFrame:
    return c.forget_deleted(b, "1998-01-01").select("id", "status")


@query("a26_dashboard", "backups", sql=f"""
n AS (SELECT *, {aged()} AS age_seconds FROM backups WHERE status <> 'deleted' QUALIFY row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) = 1)
SELECT database, id, created_at, age_seconds, CASE WHEN age_seconds <= 86400 THEN 'OK' WHEN age_seconds <= 604800 THEN 'AGING' ELSE 'STALE' END AS state, CASE WHEN size_bytes < 1024 ** 3 THEN format('{{:.1f}} MB', round_even(size_bytes / 1024.0 ** 2, 1)) ELSE format('{{:.1f}} GB', round_even(size_bytes / 1024.0 ** 3, 1)) END AS size FROM n""")
def dashboard(b: DataFrame) -> DataFrame:
    return c.dashboard(b, AS_OF)


@query("j12_compare_backups", "backups", sql="""
n AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) AS r FROM backups)
SELECT a.database, a.id AS id_a, b.id AS id_b, b.size_bytes - a.size_bytes AS size_delta, round(CASE WHEN a.size_bytes > 0 THEN 100.0 * (b.size_bytes - a.size_bytes)::DOUBLE / a.size_bytes ELSE 0 END, 6) AS size_pct, round(b.duration - a.duration, 6) AS duration_delta, epoch(b.created_at)::BIGINT - epoch(a.created_at)::BIGINT AS seconds_between FROM n a JOIN n b USING (database) WHERE a.r = 2 AND b.r = 1""")
def compare(b: DataFrame) -> DataFrame:
    two = c.newest(b, 2)
    return c.compare(two.where("rank = 2"), two.where("rank = 1"))


GOOD = "status IN ('completed', 'verified')"
GAPS = f"""
o AS (SELECT database, created_at, id, lead(created_at) OVER w AS nxt, count(*) OVER (PARTITION BY database) AS n FROM backups WHERE {GOOD} WINDOW w AS (PARTITION BY database ORDER BY created_at, id)),
g AS (SELECT database, id, created_at AS gap_start, coalesce(nxt, {NOW}) AS gap_end, epoch(coalesce(nxt, {NOW}))::BIGINT - epoch(created_at)::BIGINT AS gap_seconds, nxt IS NULL AS is_tail FROM o WHERE n >= 2),
gaps AS (SELECT *, CASE WHEN gap_seconds > 172800 THEN 'critical' WHEN gap_seconds > 172800 THEN 'warning' ELSE 'info' END AS severity FROM g WHERE gap_seconds > 86400 + 21600)"""


@query("w1_gap_detection", "backups", sql=f"{GAPS} SELECT database, id, gap_start, gap_end, gap_seconds, is_tail, severity FROM gaps")
def gaps(b: DataFrame) -> DataFrame:
    return s.gaps(b, s.Schedule(86400, 21600, 172800), AS_OF)


@query("w2_gap_summary", "backups", sql=f"{GAPS} SELECT database, count(*) AS gaps, count(*) FILTER (severity = 'critical') AS critical, max(gap_seconds) AS longest FROM gaps GROUP BY database")
def gap_summary(b: DataFrame) -> DataFrame:
    found = s.gaps(b, s.Schedule(86400, 21600, 172800), AS_OF)
    return found.groupBy("database").agg(F.count("*").alias("gaps"), F.count_if(F.col("severity") == "critical").alias("critical"), F.max("gap_seconds").alias("longest"))


@query("w3_rpo_status", "backups", sql=f"SELECT database, max(created_at) AS last_backup, min({aged()}) AS age_seconds, min({aged()}) <= 86400 AS rpo_met, max(created_at) + INTERVAL 1 DAY AS next_due, count(*) FILTER ({aged()} <= 86400) AS last_24h, count(*) FILTER ({aged()} <= 604800) AS last_7d FROM backups WHERE {GOOD} GROUP BY database")
def rpo(b: DataFrame) -> DataFrame:
    return s.rpo_status(b, 86400, AS_OF)


@query("a7_frequency", "backups", sql=f"""
{GAPS},
i AS (SELECT database, created_at, epoch(created_at)::BIGINT - epoch(lag(created_at) OVER (PARTITION BY database ORDER BY created_at, id))::BIGINT AS step FROM backups WHERE {GOOD}),
a AS (SELECT database, count(*) AS total, epoch(max(created_at))::BIGINT - epoch(min(created_at))::BIGINT AS period, sum(step) AS all_steps, min(step) AS min_interval, max(step) AS max_interval, stddev_pop(step) AS dev FROM i GROUP BY database),
k AS (SELECT database, count(*) AS n FROM gaps GROUP BY database)
SELECT a.database, total, period, (all_steps // (total - 1))::BIGINT AS mean_interval, min_interval, max_interval, round(dev, 6) AS deviation, round(CASE WHEN all_steps > 0 THEN 1 - least(dev / (all_steps / (total - 1)), 1.0) ELSE 0 END, 6) AS regularity, coalesce(k.n, 0) AS gaps, greatest(period // 86400 - total, 0)::BIGINT AS missed FROM a LEFT JOIN k USING (database)""")
def frequency(b: DataFrame) -> DataFrame:
    return s.frequency(b, 86400, AS_OF)


BREAKDOWN = """CASE WHEN cloud_location IS NOT NULL THEN (size_bytes / 12500000.0)::DOUBLE ELSE 0 END AS download_seconds, size_bytes / 100000000.0 * CASE WHEN compression <> 'none' THEN 1.3 ELSE 1 END * CASE WHEN encrypted THEN 1.1 ELSE 1 END AS restore_seconds"""
RTO = f"""
top AS (SELECT * FROM backups WHERE {GOOD} QUALIFY row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) <= 100),
l AS (SELECT *, {BREAKDOWN} FROM top QUALIFY row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) = 1),
h AS (SELECT database, count(*) AS n, bool_or(backup_type = 'incremental') AS incremental, (epoch(max(created_at))::BIGINT - epoch(min(created_at))::BIGINT) // greatest(count(*) - 1, 1) AS interval_seconds FROM top GROUP BY database),
an AS (SELECT l.database, l.id, {aged('l.created_at')} AS rpo_seconds, round(download_seconds, 6) AS download_seconds, round(restore_seconds, 6) AS restore_seconds, round(download_seconds + restore_seconds + 1800, 6) AS rto_seconds, {aged('l.created_at')} <= 86400 AS rpo_met, download_seconds + restore_seconds + 1800 <= 3600 AS rto_met, interval_seconds::BIGINT AS interval_seconds, incremental, database_type FROM l JOIN h USING (database))"""


@query("x24_rto", "backups", sql=f"{RTO} SELECT * EXCLUDE (incremental, database_type) FROM an")
def rto(b: DataFrame) -> DataFrame:
    return s.rto(b, s.Recovery(), AS_OF).drop("incremental", "database_type")


@query("x25_recommendations", "backups", sql=f"""{RTO},
r AS (SELECT database, unnest(list_filter([CASE WHEN NOT rpo_met THEN 'backup_frequency:critical' END, CASE WHEN NOT rto_met THEN 'parallel_restore:high' END, CASE WHEN download_seconds > 1800 THEN 'local_cache:medium' END, CASE WHEN NOT incremental AND interval_seconds > 21600 THEN 'incremental_backup:medium' END, CASE WHEN database_type = 'postgresql' THEN 'wal_archiving:medium' END], lambda x: x IS NOT NULL)) AS told FROM an)
SELECT database, split_part(told, ':', 1) AS recommendation, split_part(told, ':', 2) AS priority FROM r""")
def recommendations(b: DataFrame) -> DataFrame:
    return s.recommendations(s.rto(b, s.Recovery(), AS_OF))


@query("w4_rto_history", "backups", sql=f"SELECT database, id, round(download_seconds + restore_seconds + 1800, 6) AS rto_seconds, epoch(coalesce(lead(created_at) OVER (PARTITION BY database ORDER BY created_at, id), {NOW}))::BIGINT - epoch(created_at)::BIGINT AS rpo_seconds FROM (SELECT *, {BREAKDOWN} FROM backups WHERE {GOOD})")
def history(b: DataFrame) -> DataFrame:
    return s.history(b, s.Recovery(), AS_OF)


@query("a18_rto_summary", "backups", sql=f"{RTO} SELECT count(*) AS databases, count(*) FILTER (rpo_met) AS rpo_compliant, count(*) FILTER (rto_met) AS rto_compliant, count(*) FILTER (rpo_met AND rto_met) AS both_compliant, count(*) FILTER (NOT rpo_met) AS critical_issues, max(rpo_seconds) AS worst_rpo, round(max(rto_seconds), 6) AS worst_rto, max(struct_pack(a := rto_seconds, b := database)).b AS worst_rto_database, (sum(rpo_seconds) // count(*))::BIGINT AS mean_rpo, floor(avg(rto_seconds))::BIGINT AS mean_rto FROM an")
def summary(b: DataFrame) -> DataFrame:
    return s.summary(s.rto(b, s.Recovery(), AS_OF))


@query("a34_compliance_rates", "backups", sql=f"{RTO} SELECT round(100.0 * count(*) FILTER (rto_met) / count(*), 6) AS rto_rate, round(100.0 * count(*) FILTER (rpo_met) / count(*), 6) AS rpo_rate, round(100.0 * count(*) FILTER (rpo_met AND rto_met) / count(*), 6) AS full_rate FROM an")
def rates(b: DataFrame) -> DataFrame:
    return s.compliance_rates(s.summary(s.rto(b, s.Recovery(), AS_OF)))


@query("a19_mean_interval", "backups", sql=f"SELECT database, ((epoch(max(created_at))::BIGINT - epoch(min(created_at))::BIGINT) // (count(*) - 1))::BIGINT AS mean_interval FROM backups WHERE {GOOD} GROUP BY database HAVING count(*) >= 2")
def mean_interval(b: DataFrame) -> DataFrame:
    return s.mean_interval(b)


def _gfs(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    more = f"{by}, " if by else ""
    bucket = lambda fmt: f"strftime(created_at, '{fmt}')"
    ranked = ", ".join(f"row_number() OVER (PARTITION BY {more}{bucket(fmt)} ORDER BY created_at, id) AS old_{k}, max(created_at) OVER (PARTITION BY {more}{bucket(fmt)}) AS new_{k}, {bucket(fmt)} AS key_{k}" for k, fmt in (("w", "%G-W%V"), ("m", "%Y-%m"), ("y", "%Y")))
    dense = ", ".join(f"dense_rank() OVER ({part} ORDER BY new_{k} DESC, key_{k}) AS rank_{k}" for k in "wmy")
    return f"""
g0 AS (SELECT *, row_number() OVER ({part} ORDER BY created_at DESC, id DESC) AS rank_d, {ranked} FROM backups WHERE {GOOD}),
g1 AS (SELECT *, {dense} FROM g0)
SELECT id, database, size_bytes, CASE WHEN rank_d <= 7 THEN 'daily' WHEN old_w = 1 AND rank_w <= 4 THEN 'weekly' WHEN old_m = 1 AND rank_m <= 12 THEN 'monthly' WHEN old_y = 1 AND rank_y <= 3 THEN 'yearly' ELSE '' END AS tier FROM g1"""


@query("r1_gfs_catalog", "backups", sql=_gfs(""))
def gfs_catalog(b: DataFrame) -> DataFrame:
    return r.gfs_catalog(b, r.Tiers(7, 4, 12, 3))


@query("r1_gfs_per_database", "backups", sql=_gfs("database"))
def gfs_per_database(b: DataFrame) -> DataFrame:
    return r.gfs_catalog(b, r.Tiers(7, 4, 12, 3), per_database=True)


GFS_B = """
f AS (SELECT backup_path, database, created_at, id, size_bytes, strftime(created_at, '%Y-%m-%d') AS d, strftime(created_at, '%G-W%V') AS w, strftime(created_at, '%Y-%m') AS m, strftime(created_at, '%Y') AS y, dayofweek(created_at) = 0 AS qw, day(created_at) = 1 AS qm, day(created_at) = 1 AND month(created_at) = 1 AS qy FROM backups),
n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY created_at DESC, id DESC) AS nd, row_number() OVER (PARTITION BY w, qw ORDER BY created_at DESC, id DESC) AS nw, row_number() OVER (PARTITION BY m, qm ORDER BY created_at DESC, id DESC) AS nm, row_number() OVER (PARTITION BY y, qy ORDER BY created_at DESC, id DESC) AS ny,
  dense_rank() OVER (ORDER BY d DESC) AS rd, dense_rank() OVER (PARTITION BY qw ORDER BY w DESC) AS rw, dense_rank() OVER (PARTITION BY qm ORDER BY m DESC) AS rm, dense_rank() OVER (PARTITION BY qy ORDER BY y DESC) AS ry FROM f)"""


@query("r2_gfs_files", "backups", sql=f"{GFS_B} SELECT id, backup_path, CASE WHEN nd = 1 AND rd <= 7 THEN 'daily' WHEN qw AND nw = 1 AND rw <= 4 THEN 'weekly' WHEN qm AND nm = 1 AND rm <= 12 THEN 'monthly' WHEN qy AND ny = 1 AND ry <= 3 THEN 'yearly' ELSE '' END AS tier FROM n")
def gfs_files(b: DataFrame) -> DataFrame:
    return r.gfs_files(b, r.Tiers(7, 4, 12, 3))


@query("r2b_tiers_of_time", "backups", sql="SELECT id, array_to_string(list_filter(['daily', CASE WHEN dayofweek(created_at) = 0 THEN 'weekly' END, CASE WHEN last_day(created_at) = created_at::DATE THEN 'monthly' END, CASE WHEN last_day(created_at) = created_at::DATE AND month(created_at) = 1 THEN 'yearly' END], lambda x: x IS NOT NULL), ',') AS tiers FROM backups")
def tiers_of(b: DataFrame) -> DataFrame:
    return b.select("id", F.array_join(r.tiers_of(F.col("created_at"), weekly_day=0, monthly_day=0), ",").alias("tiers"))


@query("r3_age_policy", "backups", sql=f"SELECT id, database, CASE WHEN row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) <= 5 THEN 'keep' WHEN {aged()} > 365 * 86400 THEN 'delete' ELSE 'keep' END AS decision FROM backups")
def age_policy(b: DataFrame) -> DataFrame:
    return r.age_policy(b, 365, 5, AS_OF).select("id", "database", "decision")


@query("r4_simulation", "backups", sql=f"""
d AS (SELECT unnest([7, 30, 365, 1000]) AS days),
p AS (SELECT days, size_bytes, row_number() OVER (PARTITION BY days, database ORDER BY created_at DESC, id DESC) > 5 AND {aged()} > days * 86400 AS gone FROM backups, d)
SELECT days::INT AS days, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted, coalesce(sum(size_bytes) FILTER (gone), 0)::BIGINT AS freed FROM p GROUP BY days""")
def simulation(b: DataFrame) -> DataFrame:
    return r.simulate(b, [7, 30, 365, 1000], 5, AS_OF)


@query("r4_simulation_reasons", "backups", sql=f"SELECT id, CASE WHEN n <= 5 THEN 'minimum' WHEN a > 365 * 86400 THEN 'older than 365 days' ELSE 'within 365 days' END AS reason FROM (SELECT id, row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) AS n, {aged()} AS a FROM backups)")
def simulation_reasons(b: DataFrame) -> DataFrame:
    return r.age_policy(b, 365, 5, AS_OF).select("id", "reason")


@query("f12_cleanup_pattern", "backups", sql=f"SELECT id, CASE WHEN row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) <= 3 OR {aged()} <= 86400 * 500 THEN 'keep' ELSE 'delete' END AS decision FROM backups WHERE lower(backup_path) LIKE '/b/auto%'")
def cleanup(b: DataFrame) -> DataFrame:
    return r.age_policy(b.where(x.wildcard(F.col("backup_path"), "/b/AUTO*")), 500, 3, AS_OF).select("id", "decision")


@query("w12_manifest_rules", "backups", sql="""
k AS (SELECT id, database, created_at, row_number() OVER (PARTITION BY database ORDER BY created_at DESC, id DESC) AS n, row_number() OVER (PARTITION BY database, created_at::DATE ORDER BY created_at DESC, id DESC) AS nd, row_number() OVER (PARTITION BY database, strftime(created_at, '%G-W%V') ORDER BY created_at DESC, id DESC) AS nw, dense_rank() OVER (PARTITION BY database ORDER BY created_at::DATE DESC) AS rd, dense_rank() OVER (PARTITION BY database ORDER BY strftime(created_at, '%G-W%V') DESC) AS rw FROM backups)
SELECT id, n <= 5 OR (nd = 1 AND rd <= 7) OR (nw = 1 AND rw <= 4) AS keep FROM k""")
def manifest_rules(b: DataFrame) -> DataFrame:
    return r.manifest_rules(b, 5, 7, 4)
