"""Queries on dumps, tables, names, and scalar helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import dumps as d
from ..sources.views import AS_OF
from .registry import query

PHASE = "CASE WHEN regexp_matches(u, '^(CREATE (UNIQUE )?INDEX|CREATE TRIGGER|CREATE RULE)') OR (u LIKE 'ALTER TABLE%' AND u LIKE '%ADD CONSTRAINT%') THEN 'post-data' WHEN regexp_matches(u, '^(CREATE TABLE|ALTER TABLE|SET )') THEN 'pre-data' WHEN u LIKE 'COPY %' OR u LIKE 'INSERT INTO%' THEN 'data' ELSE 'unknown' END"


@query("x31_statements", "dump_lines", sql=f"l AS (SELECT line_no, line, upper(trim(line)) AS u FROM dump_lines) SELECT line_no, {PHASE} AS phase, CASE line_no % 6 WHEN 0 THEN 'create_table' WHEN 1 THEN 'copy' WHEN 2 THEN 'create_index' WHEN 3 THEN 'constraint' WHEN 4 THEN 'set' ELSE 'other' END AS type, CASE line_no % 6 WHEN 4 THEN NULL WHEN 5 THEN 't' || line_no % 97 ELSE 'public.t' || line_no % 97 END AS table_name FROM l")
def statements(t: DataFrame) -> DataFrame:
    line = F.col("line")
    return t.select("line_no", d.phase(line).alias("phase"), d.statement_type(line).alias("type"), d.table_of(line).alias("table_name"))


@query("a28_phase_counts", "dump_lines", sql=f"l AS (SELECT upper(trim(line)) AS u FROM dump_lines) SELECT {PHASE} AS phase, count(*) AS n FROM l GROUP BY 1")
def phase_counts(t: DataFrame) -> DataFrame:
    return t.groupBy(d.phase(F.col("line")).alias("phase")).agg(F.count("*").alias("n"))


@query("x32_index_methods", "dump_lines", sql="SELECT line_no, CASE line_no % 4 WHEN 0 THEN 'btree' WHEN 2 THEN 'gin' ELSE 'hash' END AS method FROM dump_lines WHERE line_no % 6 = 2")
def methods(t: DataFrame) -> DataFrame:
    return t.where(d.statement_type(F.col("line")) == "create_index").select("line_no", d.index_method(F.col("line")).alias("method"))


@query("x32_constraint_types", "dump_lines", sql="SELECT line_no, CASE WHEN line_no % 4 = 1 THEN 'primary_key' ELSE 'foreign_key' END AS type FROM dump_lines WHERE line_no % 6 = 3")
def constraints(t: DataFrame) -> DataFrame:
    return t.where(d.statement_type(F.col("line")) == "constraint").select("line_no", d.constraint_type(F.col("line")).alias("type"))


@query("t5_index_order", "dump_lines", sql="SELECT line_no, 0 AS rank FROM dump_lines WHERE line_no % 6 = 2 ORDER BY line_no % 50 DESC, line_no")
def index_order(t: DataFrame) -> DataFrame:
    i = t.where(d.statement_type(F.col("line")) == "create_index").withColumn("size", F.col("line_no") % 50)
    return d.index_order(i).select("line_no", "rank")


@query("t6_constraint_order", "dump_lines", sql="SELECT line_no, CASE WHEN line_no % 4 = 1 THEN 1 ELSE 4 END::BIGINT AS rank FROM dump_lines WHERE line_no % 6 = 3 ORDER BY rank, line_no")
def constraint_order(t: DataFrame) -> DataFrame:
    return d.constraint_order(t.where(d.statement_type(F.col("line")) == "constraint")).select("line_no", "rank")


@query("t7_dependency_order", "toc", sql="RECURSIVE dn AS (SELECT dump_id, 0 AS depth FROM toc WHERE depends_on = 0 UNION ALL SELECT t.dump_id, dn.depth + 1 FROM dn JOIN toc t ON t.depends_on = dn.dump_id) SELECT t.dump_id, depth, depth IS NULL AS leftover FROM toc t LEFT JOIN dn USING (dump_id)")
def dependency_order(t: DataFrame) -> DataFrame:
    return d.dependency_order(t.select("dump_id", "depends_on"))


@query("t8_object_order", "toc", sql="SELECT dump_id AS id, CASE dump_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 5 ELSE 6 END::BIGINT AS rank FROM toc")
def object_order(t: DataFrame) -> DataFrame:
    k = F.col("dump_id") % 6
    kind = F.when(k == 0, "schema").when(k == 1, "table").when(k == 2, "view").when(k == 3, "sequence").when(k == 4, "function").otherwise("cast")
    return d.object_order(t.select(F.col("dump_id").alias("id"), kind.alias("kind"))).select("id", "rank")


@query("f3_select_tables", "tables", sql="SELECT table_id FROM tables WHERE schema IN ('Brand#11', 'Brand#12', 'Brand#13') AND schema NOT IN ('Brand#12') AND NOT (name = 'PROMO BRUSHED STEEL' OR schema || '.' || name = 'PROMO BRUSHED STEEL') AND regexp_matches(schema || '.' || name, 'Brand#1[13].*(STEEL|TIN|COPPER|BRASS|NICKEL|[A-Z])') AND row_count >= 2000 AND row_count <= 45000")
def select_tables(t: DataFrame) -> DataFrame:
    return d.select_tables(t, ["Brand#11", "Brand#12", "Brand#13"], ["Brand#12"], (), ["PROMO BRUSHED STEEL"], "Brand#1[13].*(STEEL|TIN|COPPER|BRASS|NICKEL|[A-Z])", 2000, 45000).select("table_id")


@query("f4_select_excluding_first", "tables", sql="SELECT table_id FROM tables WHERE NOT (lower(schema || '.' || name) LIKE 'brand#1%' OR lower(name) LIKE 'brand#1%') AND (lower(schema || '.' || name) LIKE '%a%' OR lower(name) LIKE '%a%')")
def select_excluding(t: DataFrame) -> DataFrame:
    return d.select_tables_excluding_first(t, ["*a*"], ["Brand#1*"]).select("table_id")


@query("f9_changed_files", "files", sql="SELECT path FROM files WHERE modified_at > TIMESTAMP '1998-01-01' AND lower(path) NOT LIKE '/b/stray%'")
def changed(f: DataFrame) -> DataFrame:
    return d.changed_files(f, "1998-01-01", ["/b/stray*"]).select("path")


@query("f10_toc_filter", "toc", sql="SELECT dump_id FROM toc WHERE section IN (0, 2) AND (tag IN (SELECT tag FROM toc WHERE dump_id = 5) OR namespace || '.' || tag = 'Brand#13.x')")
def toc_filter(t: DataFrame) -> DataFrame:
    wanted = t.where("dump_id = 5").select("tag")
    return d.toc_filter(t, (), [0, 2]).join(wanted, "tag", "left_semi").select("dump_id")


@query("f11_wildcards", "backups", sql="SELECT id, lower(database) LIKE 'auto%' AS starts, lower(database) LIKE '%ery' AS ends, lower(database) LIKE '%chi%' AS holds FROM backups")
def wildcards(b: DataFrame) -> DataFrame:
    c = F.col("database")
    return b.select("id", x.wildcard(c, "auto*").alias("starts"), x.wildcard(c, "*ery").alias("ends"), x.wildcard(c, "*chi*").alias("holds"))


@query("f13_validation", "backups", sql="SELECT id, regexp_matches(database, '^[A-Za-z_][A-Za-z0-9_-]{0,62}$') AS name_ok, id % 70000 BETWEEN 1 AND 65535 AS port_ok, true AS host_ok, regexp_matches(lower(database), '^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$') AS bucket_ok FROM backups")
def validation(b: DataFrame) -> DataFrame:
    return b.select("id", d.valid_name(F.col("database")).alias("name_ok"), d.valid_port(F.col("id") % 70000).alias("port_ok"), d.valid_host(F.col("host")).alias("host_ok"), d.valid_bucket(F.lower("database")).alias("bucket_ok"))


@query("x33_table_priority", "tables", sql="SELECT table_id, CASE WHEN n LIKE 'user%' OR n LIKE 'account%' OR n LIKE 'order%' THEN 'critical' WHEN n LIKE '%log%' OR n LIKE '%audit%' OR n LIKE '%\\_old' ESCAPE '\\' THEN 'cold' WHEN n LIKE 'product%' OR n LIKE 'invoice%' THEN 'important' ELSE 'default' END AS priority FROM (SELECT table_id, CASE table_id % 5 WHEN 0 THEN 'users' WHEN 1 THEN 'order_log' WHEN 2 THEN 'event_log' WHEN 3 THEN 'products' ELSE 'misc' END || table_id % 3 AS n FROM tables)")
def priority(t: DataFrame) -> DataFrame:
    k = F.col("table_id") % 5
    name = F.concat(F.lit("public."), F.when(k == 0, "users").when(k == 1, "order_log").when(k == 2, "event_log").when(k == 3, "products").otherwise("misc"), (F.col("table_id") % 3).cast("string"))
    return t.select("table_id", d.table_priority(name).alias("priority"))


def _names(b: DataFrame) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, [".sql", ".sql.gz", ".dump", ".DUMP.GZ", ".tar.gz", ".sql.zst", ".tar", ".xyz"])), (F.col("id") % 8 + 1).cast("int"))
    return b.select("id", "size_bytes", F.concat(F.col("backup_path"), ends).alias("path"))


@query("s7_archive_format", "backups", sql="SELECT id, ['sql', 'sql_gzip', 'custom', 'custom_gzip', 'cluster', 'sql_zstd', 'tar', 'unknown'][id % 8 + 1] AS format FROM backups")
def archive_format(b: DataFrame) -> DataFrame:
    return _names(b).select("id", d.archive_format(F.col("path")).alias("format"))


@query("s8_compression", "backups", sql="SELECT id, ['none', 'gzip', 'none', 'gzip', 'gzip', 'zstd', 'none', 'none'][id % 8 + 1] AS compression FROM backups")
def compression(b: DataFrame) -> DataFrame:
    return _names(b).select("id", d.compression_of(F.col("path")).alias("compression"))


@query("x51_restore_preview", "backups", sql="SELECT id, ['sql', 'sql_gzip', 'custom', 'custom_gzip', 'cluster', 'sql_zstd', 'tar', 'unknown'][id % 8 + 1] AS format, ['none', 'gzip', 'none', 'gzip', 'gzip', 'zstd', 'none', 'none'][id % 8 + 1] AS compression, size_bytes * CASE WHEN id % 8 IN (1, 3, 4, 5) THEN 4 ELSE 1 END AS unpacked, round(size_bytes * CASE WHEN id % 8 IN (1, 3, 4, 5) THEN 4 ELSE 1 END / 1048576.0::DOUBLE / 50, 11) AS seconds FROM backups")
def preview(b: DataFrame) -> DataFrame:
    n = _names(b)
    return d.restore_preview(n, F.col("path"))


@query("s20_cloud_uri", "backups", sql="SELECT id, CASE WHEN cloud_location IS NOT NULL THEN ['s3', 'gcs', 'azure', NULL][id % 4 + 1] END AS provider, CASE WHEN cloud_location IS NOT NULL AND id % 4 <> 3 THEN 'bucket' END AS bucket, CASE WHEN cloud_location IS NOT NULL AND id % 4 <> 3 THEN id::VARCHAR END AS path FROM backups")
def cloud_uri(b: DataFrame) -> DataFrame:
    scheme = F.element_at(F.array(*map(F.lit, ["s3", "gs", "AZURE", "ftp"])), (F.col("id") % 4 + 1).cast("int"))
    u = d.cloud_uri(F.concat(scheme, F.lit("://"), F.substring("cloud_location", 6, 100)))
    return b.select("id", u.alias("u")).select("id", "u.provider", "u.bucket", "u.path")


@query("x37_error_hints", "oplog", sql="SELECT id, ['duplicate', 'disk_space', 'locks', 'permissions', 'network', 'corruption', 'unknown'][id % 7 + 1] AS category, [0, 3, 2, 2, 2, 3, 1][id % 7 + 1] AS weight FROM oplog")
def hints(o: DataFrame) -> DataFrame:
    texts = ['ERROR: relation "t" already exists', "write: No space left on device", "hint: increase max_locks_per_transaction", "permission denied for table t", "could not connect to server", "syntax error at or near x", "something else"]
    kind, weight = d.error_category(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 7 + 1).cast("int")))
    return o.select("id", kind.alias("category"), weight.alias("weight"))


def _text(t: DataFrame) -> DataFrame:
    k = F.col("line_no")
    line = F.when(k % 10 == 1, F.concat(F.lit("COPY public.t"), (k % 7).cast("string"), F.lit(" (id) FROM stdin;"))).when((k % 10 == 9) & (k % 30 != 9), "\\.").otherwise(k.cast("string"))
    return t.select(F.floor(k / 500).cast("long").alias("stream"), "line_no", line.alias("line"))


@query("w13_copy_blocks", "dump_lines", sql="m AS (SELECT line_no // 500 AS stream, line_no, CASE WHEN line_no % 10 = 1 THEN 'header' WHEN line_no % 10 = 9 AND line_no % 30 <> 9 THEN 'end' END AS mark FROM dump_lines), k AS (SELECT *, lead(mark) OVER (PARTITION BY stream ORDER BY line_no) AS nxt FROM m WHERE mark IS NOT NULL) SELECT stream, line_no, 'public.t' || line_no % 7 AS \"table\", coalesce(nxt <> 'end', true) AS truncated FROM k WHERE mark = 'header'")
def copy_blocks(t: DataFrame) -> DataFrame:
    return d.copy_blocks(_text(t))


@query("w14_error_context", "dump_lines", sql="l AS (SELECT line_no // 500 AS stream, line_no, line_no % 83 = 0 AS is_error FROM dump_lines), n AS (SELECT *, max(is_error::INT) OVER (PARTITION BY stream ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l) SELECT stream, line_no, is_error FROM n WHERE near = 1")
def context(t: DataFrame) -> DataFrame:
    return d.context_lines(_text(t), F.col("line_no") % 83 == 0, 3).select("stream", "line_no", "is_error")


@query("s14_insert_batches", "tables", sql="r AS (SELECT schema AS part, table_id, (row_number() OVER (PARTITION BY schema ORDER BY table_id) - 1) // 20 AS batch, '(' || table_id || ', ''' || name || ''', ' || CASE WHEN table_id % 9 = 0 THEN 'NULL' ELSE row_count::VARCHAR END || ')' AS v FROM tables) SELECT part, batch, count(*)::INT AS rows, 'INSERT INTO tables VALUES ' || string_agg(v, ', ' ORDER BY table_id) || ';' AS statement FROM r GROUP BY part, batch")
def insert_batches(t: DataFrame) -> DataFrame:
    rows = F.when(F.col("table_id") % 9 != 0, F.col("row_count"))
    v = F.concat(F.lit("("), d.mysql_literal(F.col("table_id"), "bigint"), F.lit(", "), d.mysql_literal(F.col("name"), "string"), F.lit(", "), d.mysql_literal(rows, "bigint"), F.lit(")"))
    return d.insert_batches(t.withColumn("part", F.col("schema")), "tables", v, "table_id", 20)


@query("x35_mysql_literals", "tables", sql="SELECT table_id, '''' || replace(replace(name || chr(39) || chr(10) || chr(92), chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)).replace(chr(10), chr(92) || 'n') || '''' AS text, CASE WHEN table_id % 4 = 0 THEN 'NULL' ELSE '0x' || hex(schema) END AS bytes, CASE WHEN table_id % 3 = 0 THEN 'NULL' ELSE row_count::VARCHAR END AS number FROM tables")
def literals(t: DataFrame) -> DataFrame:
    raw = F.when(F.col("table_id") % 4 != 0, F.col("schema").cast("binary"))
    return t.select("table_id", d.mysql_literal(F.concat("name", F.lit("'\n\\")), "string").alias("text"), d.mysql_literal(raw, "binary").alias("bytes"), d.mysql_literal(F.when(F.col("table_id") % 3 != 0, F.col("row_count")), "bigint").alias("number"))


@query("x36_postgres_types", "backups", sql="SELECT unnest(['id', 'database', 'size_bytes', 'created_at', 'duration', 'encrypted']) AS \"column\", unnest(['bigint', 'text', 'bigint', 'timestamp without time zone', 'double precision', 'boolean']) AS type")
def types(b: DataFrame) -> DataFrame:
    rows = [(c, d.postgres_type(b.schema[c].dataType)) for c in ("id", "database", "size_bytes", "created_at", "duration", "encrypted")]
    return b.sparkSession.createDataFrame(rows, "column string, type string")


@query("s13_copy_text", "tables", sql="SELECT table_id, concat_ws(chr(9), table_id::VARCHAR, replace(replace(schema || chr(9) || chr(92), chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), CASE WHEN table_id % 3 = 0 THEN chr(92) || 'N' ELSE row_count::VARCHAR END) AS line FROM tables")
def copy_text(t: DataFrame) -> DataFrame:
    return t.select("table_id", F.concat_ws("\t", d.copy_text(F.col("table_id")), d.copy_text(F.concat("schema", F.lit("\t\\"))), d.copy_text(F.when(F.col("table_id") % 3 != 0, F.col("row_count")))).alias("line"))


@query("w11_count_batches", "dump_lines", sql="SELECT line_no, ((row_number() OVER (PARTITION BY line_no % 6 ORDER BY line_no) - 1) // 100) AS batch FROM dump_lines")
def count_batches(t: DataFrame) -> DataFrame:
    return d.count_batches(t.select((F.col("line_no") % 6).alias("stream"), "line_no"), ["stream"], "line_no", 100).select("line_no", "batch")


@query("w11_greedy_batches", "dump_lines", sql="""RECURSIVE l AS (SELECT line_no % 6 AS stream, line_no, strlen(line) AS size, row_number() OVER (PARTITION BY line_no % 6 ORDER BY line_no) AS k FROM dump_lines),
f AS (
  SELECT stream, line_no, k, 0::BIGINT AS batch, 1 AS n, size AS held FROM l WHERE k = 1
  UNION ALL
  SELECT l.stream, l.line_no, l.k, CASE WHEN f.n >= 50 OR f.held + l.size > 2000 THEN batch + 1 ELSE batch END, CASE WHEN f.n >= 50 OR f.held + l.size > 2000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 50 OR f.held + l.size > 2000 THEN l.size ELSE f.held + l.size END
  FROM f JOIN l ON l.stream = f.stream AND l.k = f.k + 1)
SELECT stream, line_no, batch FROM f""")
def greedy(t: DataFrame) -> DataFrame:
    return d.greedy_batches(t.select((F.col("line_no") % 6).alias("stream"), "line_no", F.octet_length("line").alias("bytes")), ["stream"], "line_no", 50, 2000)


@query("s9_split_dumps", "dump_lines")
def split(t: DataFrame) -> DataFrame:
    spark = t.sparkSession
    text = t.groupBy(F.floor(F.col("line_no") / 300).cast("long").alias("dump_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.when(s["line"].startswith("COPY "), F.concat(s["line"], F.lit("\n1\ta\n2\tb\n\\."))).otherwise(s["line"])), "\n").alias("text"))
    return d.dump_stats(d.split_dumps(spark, text))


@query("x1_scalars", "backups", sql=f"""
u AS (SELECT id, size_bytes, floor(duration)::BIGINT AS s, created_at, epoch(TIMESTAMP '{AS_OF}')::BIGINT - epoch(created_at)::BIGINT AS a FROM backups)
SELECT id, CASE WHEN size_bytes < 1024 ** 3 THEN format('{{:.1f}} MB', round_even(size_bytes / 1024.0 ** 2, 1)) ELSE format('{{:.1f}} GB', round_even(size_bytes / 1024.0 ** 3, 1)) END AS size, CASE WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || s % 60 || 's' END AS duration, CASE WHEN a < 2592000 THEN a // 86400 || 'd' WHEN a < 31536000 THEN a // 2592000 || 'mo' ELSE a // 31536000 || 'y' END AS age, strftime(created_at, '%G-W%V') AS week, dayofweek(created_at)::INT AS weekday, last_day(created_at) = created_at::DATE AS last_day FROM u""")
def scalars(b: DataFrame) -> DataFrame:
    at = F.col("created_at")
    return b.select("id", x.human_bytes(F.col("size_bytes")).alias("size"), x.human_duration(F.col("duration")).alias("duration"), x.age_label(x.seconds(at, F.lit(AS_OF).cast("timestamp_ntz"))).alias("age"), x.iso_week(at).alias("week"), x.weekday(at).alias("weekday"), x.is_last_day(at).alias("last_day"))


@query("x4_parsing", "tables", sql="""
SELECT table_id, (table_id % 50) * [1, 1024, 1048576, 1073741824][table_id % 4 + 1] AS size, CASE WHEN table_id % 5 <> 0 THEN (table_id % 50) * [1024, 1048576][table_id % 2 + 1] END AS rate, (table_id % 50) * [1, 3600, 86400, 604800, 2592000, 31536000][table_id % 6 + 1] AS duration, [0, 1, 2, 3, 4, 5, 6, 0][table_id % 8 + 1] AS weekday FROM tables""")
def parsing(t: DataFrame) -> DataFrame:
    k = F.col("table_id")
    n = (k % 50).cast("string")
    def pick(values: list[str], of: int) -> "F.Column":
        return F.element_at(F.array(*map(F.lit, values)), (k % of + 1).cast("int"))

    rate = F.when(k % 5 == 0, "1.5MB/s").otherwise(F.concat(n, pick(["KB/s", "mb/s"], 2)))
    return t.select("table_id", x.parsed_size(F.concat(n, pick(["", "KB", " mb", "GiB"], 4))).alias("size"), x.parsed_rate(rate).alias("rate"), x.parsed_duration(F.concat(n, pick(["s", "h", "d", "w", "m", "y"], 6))).alias("duration"), x.weekday_number(pick(["Sunday", "mon", "TUESDAY", "wed", "thursday", "Fri", "saturday", "someday"], 8)).alias("weekday"))


@query("x7_timestamps", "backups", sql="SELECT id, CASE WHEN id % 5 <> 4 THEN created_at + INTERVAL 5 HOUR END AS at FROM backups")
def timestamps(b: DataFrame) -> DataFrame:
    at = F.col("created_at") + F.expr("interval 5 hours")
    text = F.when(F.col("id") % 5 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 5 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("id") % 5 == 2, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00 +0000"))).when(F.col("id") % 5 == 3, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.000000000"), F.lit(" +0000 +0000"))).otherwise("never")
    return b.select("id", x.parsed_time(text).cast("timestamp_ntz").alias("at"))


@query("x44_tags", "backups", sql="SELECT id, CASE WHEN id % 3 = 0 THEN 'prod' ELSE 'test' END AS env, '{\"env\":\"' || CASE WHEN id % 3 = 0 THEN 'prod' ELSE 'test' END || '\",\"host\":\"' || host || '\"}' AS tags FROM backups")
def tags(b: DataFrame) -> DataFrame:
    m = F.create_map(F.lit("env"), F.when(F.col("id") % 3 == 0, "prod").otherwise("test"), F.lit("host"), F.col("host"))
    return b.select("id", F.to_json(m).alias("tags")).select("id", F.from_json("tags", "map<string,string>")["env"].alias("env"), "tags")


@query("w9_ema", "samples", sql="""RECURSIVE r AS (SELECT key, epoch_us(ts) / 1e6 AS t, row_number() OVER o AS k, (sum(delta) OVER o)::DOUBLE AS total FROM samples WINDOW o AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
f AS (
  SELECT key, k, t, total, 0::DOUBLE AS ema, 0 AS n FROM r WHERE k = 1
  UNION ALL
  SELECT key, k, CASE WHEN early THEN t0 ELSE t END, CASE WHEN early THEN total0 ELSE total END, CASE WHEN early THEN ema WHEN ema = 0 THEN speed ELSE 0.2::DOUBLE * speed + 0.8::DOUBLE * ema END, CASE WHEN early THEN n ELSE n + 1 END
  FROM (SELECT r.key, r.k, r.t, r.total, f.t AS t0, f.total AS total0, f.ema, f.n, r.t - f.t < 0.5 AS early, greatest(r.total - f.total, 0) / (r.t - f.t) AS speed FROM f JOIN r ON r.key = f.key AND r.k = f.k + 1))
SELECT key, round(ema, 6) AS bytes_per_s, n AS samples, n >= 5 AS warm FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1""")
def ema(s: DataFrame) -> DataFrame:
    from ..streaming.events import ema_speed

    return ema_speed(s)


@query("m3_event_digest", "oplog", sql="SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, database, type, severity, host, count(*) AS n, min(id) AS first_id FROM oplog GROUP BY ALL")
def digest(o: DataFrame) -> DataFrame:
    from ..streaming.events import digest as f

    return f(o)


@query("m3_event_batches", "oplog", sql="""RECURSIVE e AS (SELECT host, ts, CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 0 END AS worst, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS k FROM oplog),
f AS (
  SELECT host, k, ts, worst, ts AS first_ts, 1 AS n, 1 AS batch FROM e WHERE k = 1
  UNION ALL
  SELECT host, k, ts, worst, CASE WHEN opens THEN ts ELSE first_ts END, CASE WHEN opens THEN 1 ELSE n + 1 END, CASE WHEN opens THEN batch + 1 ELSE batch END
  FROM (SELECT e.*, f.first_ts, f.n, f.batch, epoch_us(e.ts) - epoch_us(f.first_ts) >= 300000000 OR f.n >= 50 AS opens FROM f JOIN e ON e.host = f.host AND e.k = f.k + 1))
SELECT host, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(worst) AS worst FROM f GROUP BY host, batch""")
def batches(o: DataFrame) -> DataFrame:
    from ..streaming.events import batches as f

    return f(o)


@query("a27_escalation_states", "oplog")
def escalations(o: DataFrame) -> DataFrame:
    from ..streaming.events import escalate

    return escalate(o).groupBy("state").agg(F.count("*").alias("n"))


@query("m6_token_bucket", "samples", sql="""RECURSIVE r AS (SELECT key, epoch_us(ts) / 1e6 AS t, delta::DOUBLE AS want, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS k FROM samples),
f AS (
  SELECT key, k, t, 5e6 - want AS rest, greatest(want - 5e6, 0) / 1e6 AS wait FROM r WHERE k = 1
  UNION ALL
  SELECT key, k, t, rest, greatest(-rest, 0) / 1e6 FROM (SELECT r.key, r.k, r.t, least(f.rest + (r.t - f.t) * 1e6, 5e6) - r.want AS rest FROM f JOIN r ON r.key = f.key AND r.k = f.k + 1))
SELECT key, round(sum(wait), 3) AS waited_s, count(*) FILTER (WHERE wait > 0) AS delayed FROM f GROUP BY key""")
def bucket(s: DataFrame) -> DataFrame:
    from ..streaming.events import token_bucket

    return token_bucket(s, 1_000_000.0, 5_000_000.0)
