"""SQL dumps, tables and files: classification, selection, ordering, batching, export."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions import scalars as x
from .chains import depths, folded, previous, running

#: Numbers of lines or rows in a span.
SPAN = 4096


def _upper(sql: Column) -> Column:
    return F.upper(F.trim(sql))


def phase(sql: Column) -> Column:
    """pre-data, data, post-data or unknown, of a statement."""
    u = _upper(sql)
    later = u.rlike(r"^(CREATE (UNIQUE )?INDEX|CREATE TRIGGER|CREATE RULE)") | (u.startswith("ALTER TABLE") & u.rlike("ADD CONSTRAINT|ENABLE TRIGGER|ENABLE RULE"))
    first = u.rlike(r"^(CREATE (TABLE|TYPE|SEQUENCE|FUNCTION|OR REPLACE FUNCTION|SCHEMA|EXTENSION|DOMAIN|AGGREGATE|OPERATOR|COLLATION|CAST)|ALTER (TABLE|SEQUENCE|TYPE)|SET |SELECT PG_CATALOG\.SETVAL)")
    return F.when(later, "post-data").when(first, "pre-data").when(u.startswith("COPY ") | u.startswith("INSERT INTO"), "data").otherwise("unknown")


def statement_type(sql: Column) -> Column:
    u = _upper(sql)
    alter = u.startswith("ALTER TABLE")
    return (
        F.when(u.startswith("CREATE TABLE"), "create_table").when(u.rlike("^CREATE (UNIQUE )?INDEX"), "create_index").when(u.startswith("COPY "), "copy").when(alter & u.contains("ADD CONSTRAINT"), "constraint").when(alter & u.contains("OWNER"), "owner")
        .when(u.startswith("SET "), "set").when(u.startswith("SELECT PG_CATALOG.SETVAL"), "sequence_set").when(u.startswith("CREATE SEQUENCE"), "sequence").when(u.rlike("^CREATE (OR REPLACE )?FUNCTION"), "function").when(u.startswith("CREATE TRIGGER"), "trigger")
        .when(u.startswith("CREATE SCHEMA"), "schema").when(u.startswith("CREATE EXTENSION"), "extension").when(u.rlike("^(GRANT|REVOKE)"), "grant").when(u.startswith("COMMENT"), "comment").otherwise("other")
    )


def table_of(sql: Column) -> Column:
    """The table that a statement is about; null if none."""
    name = F.regexp_extract(F.trim(sql), r"(?i)^(?:CREATE TABLE\s+(?:IF NOT EXISTS\s+)?|ALTER TABLE\s+(?:ONLY\s+)?(?:IF EXISTS\s+)?(?:ONLY\s+)?|COPY\s+|INSERT INTO\s+|CREATE (?:UNIQUE )?INDEX.*?\sON\s+(?:ONLY\s+)?)([^\s(;]+)", 1)
    return F.nullif(name, F.lit(""))


def index_method(sql: Column) -> Column:
    u = F.upper(sql)
    return F.when(u.rlike(r"USING GIN|GIN \("), "gin").when(u.rlike(r"USING GIST|GIST \("), "gist").when(u.contains("USING HASH"), "hash").otherwise("btree")


def constraint_type(sql: Column) -> Column:
    u = F.upper(sql)
    return F.when(u.contains("PRIMARY KEY"), "primary_key").when(u.contains("FOREIGN KEY"), "foreign_key").when(u.contains("UNIQUE"), "unique").when(u.contains("CHECK"), "check").when(u.contains("EXCLUDE"), "exclusion").otherwise("other")


def _rank(value: Column, order: Sequence[str]) -> Column:
    """A value's place in a list; after it if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1))


def index_order(statements: DataFrame) -> DataFrame:
    """statements: line_no, line, size. Unique indexes, then by method, then the larger first."""
    unique = F.upper("line").startswith("CREATE UNIQUE")
    rank = F.when(unique, 0).otherwise(_rank(index_method(F.col("line")), ("btree", "hash", "gin", "gist")))
    return statements.withColumn("rank", rank).orderBy("rank", F.col("size").desc(), "line_no")


def constraint_order(statements: DataFrame) -> DataFrame:
    return statements.withColumn("rank", _rank(constraint_type(F.col("line")), ("primary_key", "unique", "check", "foreign_key", "exclusion", "other"))).orderBy("rank", "line_no")


def object_order(objects: DataFrame, kind: str = "kind") -> DataFrame:
    return objects.withColumn("rank", _rank(F.col(kind), ("schema", "sequence", "table", "view", "function"))).orderBy("rank", "id")


def dependency_order(entries: DataFrame) -> DataFrame:
    """entries: dump_id, depends_on (0: nothing). The depth from the roots; what hangs on a cycle, or on nothing known, comes last."""
    depth = depths(entries.select(F.col("dump_id").alias("id"), F.col("depends_on").alias("parent")))
    return depth.select(F.col("id").alias("dump_id"), "depth", F.col("depth").isNull().alias("leftover"))


def select_tables(tables: DataFrame, include_schemas: Sequence[str] = (), exclude_schemas: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), pattern: str | None = None, min_rows: int = 0, max_rows: int = 0) -> DataFrame:
    """Tables by schema, name, regular expression on the full name, and rows; a bound of 0 is off. Names may be full."""
    full = F.concat_ws(".", "schema", "name")
    out = tables
    if include_schemas:
        out = out.where(F.col("schema").isin(*include_schemas))
    if exclude_schemas:
        out = out.where(~F.col("schema").isin(*exclude_schemas))
    if include:
        out = out.where(F.col("name").isin(*include) | full.isin(*include))
    if exclude:
        out = out.where(~(F.col("name").isin(*exclude) | full.isin(*exclude)))
    if pattern:
        out = out.where(full.rlike(pattern))
    if min_rows:
        out = out.where(F.col("row_count") >= min_rows)
    return out.where(F.col("row_count") <= max_rows) if max_rows else out


def select_tables_excluding_first(tables: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Exclusion counts before inclusion; names may have * at their ends."""
    from functools import reduce

    full = F.concat_ws(".", "schema", "name")
    def any_of(patterns: Sequence[str]) -> Column:
        return reduce(Column.__or__, [x.wildcard(full, p) | x.wildcard(F.col("name"), p) for p in patterns], F.lit(False))

    out = tables.where(~any_of(exclude)) if exclude else tables
    return out.where(any_of(include)) if include else out


def toc_filter(toc: DataFrame, tags: Sequence[str] = (), sections: Sequence[int] = ()) -> DataFrame:
    """Entries by tag or namespace.tag, and by section."""
    out = toc.where(F.col("tag").isin(*tags) | F.concat_ws(".", "namespace", "tag").isin(*tags)) if tags else toc
    return out.where(F.col("section").isin(*sections)) if sections else out


def changed_files(files: DataFrame, since: str, skip: Sequence[str] = ()) -> DataFrame:
    """Files modified after the base backup and not on the skip list (patterns with * at their ends)."""
    out = files.where(F.col("modified_at") > F.lit(since).cast("timestamp_ntz"))
    for pattern in skip:
        out = out.where(~x.wildcard(F.col("path"), pattern))
    return out


#: Patterns of tables that count as critical, cold, important.
PRIORITIES = {"critical": ("user*", "account*", "order*"), "cold": ("*log*", "*audit*", "*_old"), "important": ("product*", "invoice*")}


def table_priority(name: Column, patterns: dict[str, Sequence[str]] = PRIORITIES) -> Column:
    """The first class with a matching pattern; the schema doesn't count."""
    bare = F.regexp_extract(name, r"([^.]*)$", 1)
    out = None
    for kind in ("critical", "cold", "important"):
        for p in patterns.get(kind, ()):
            out = F.when(x.wildcard(bare, p), kind) if out is None else out.when(x.wildcard(bare, p), kind)
    return F.lit("default") if out is None else out.otherwise("default")


#: Endings of archive names and their formats, the first that fits.
FORMATS = (
    (r"\.tar\.gz$|\.tgz$", "cluster"), (r"\.dump\.gz$", "custom_gzip"), (r"\.dump$", "custom"), (r"\.sql\.gz$", "sql_gzip"), (r"\.sql\.zst$", "sql_zstd"), (r"\.sql\.bz2$", "sql_bzip2"), (r"\.sql$", "sql"), (r"\.tar$", "tar"),
)


def archive_format(path: Column, head: Column | None = None) -> Column:
    """By the name's end, and for others by magic bytes."""
    out = None
    for pattern, name in FORMATS:
        hit = F.lower(path).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if head is not None:
        h = F.hex(head)
        out = out.when(h.startswith("5047444D50"), "custom").when(h.startswith("1F8B"), "sql_gzip").when(h.startswith("28B52FFD"), "sql_zstd")
    return out.otherwise("unknown")


def compression_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.(gz|tgz)$"), "gzip").when(p.rlike(r"\.(zst|zstd)$"), "zstd").when(p.endswith(".bz2"), "bzip2").when(p.endswith(".xz"), "xz").when(p.endswith(".lz4"), "lz4").otherwise("none")


#: Prefixes and the provider they name.
SCHEMES = {"s3": "s3", "s3a": "s3", "minio": "minio", "b2": "b2", "azure": "azure", "gs": "gcs", "gcs": "gcs", "sftp": "sftp"}


def cloud_uri(uri: Column) -> Column:
    """(provider, bucket, path) of a URI; null if its scheme is unknown or it names no bucket."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z0-9]+)://", 1))
    provider = F.element_at(F.create_map(*[F.lit(v) for kv in SCHEMES.items() for v in kv]), scheme)
    bucket, path = F.regexp_extract(uri, r"^[A-Za-z0-9]+://([^/]+)", 1), F.regexp_extract(uri, r"^[A-Za-z0-9]+://[^/]+/(.*)$", 1)
    return F.when(provider.isNotNull() & (bucket != ""), F.struct(provider.alias("provider"), bucket.alias("bucket"), path.alias("path")))


#: What error messages say, category, weight.
HINTS = (
    (r"(?i)already exists|duplicate key", "duplicate", 0), (r"(?i)no space left|disk full|insufficient.*space", "disk_space", 3), (r"(?i)max_locks_per_transaction|out of shared memory|could not open large object", "locks", 2),
    (r"(?i)permission denied|must be owner|access denied", "permissions", 2), (r"(?i)connection refused|could not connect|no pg_hba\.conf", "network", 2), (r"(?i)version mismatch|unsupported version", "version", 1), (r"(?i)syntax error|invalid command", "corruption", 3),
)


def error_category(message: Column) -> tuple[Column, Column]:
    kind, weight = None, None
    for pattern, name, w in HINTS:
        hit = message.rlike(pattern)
        kind, weight = (F.when(hit, name), F.when(hit, w)) if kind is None else (kind.when(hit, name), weight.when(hit, w))
    return kind.otherwise("unknown"), weight.otherwise(1)


def copy_blocks(lines: DataFrame) -> DataFrame:
    """lines: stream, line_no, line. Each COPY header with whether its block ends: another header, or the end of the text, before a terminator means that it is cut off."""
    header = F.upper(F.trim("line")).rlike(r"^COPY .* FROM STDIN;$")
    mark = F.when(header, "header").when(F.trim("line") == "\\.", "end")
    marks = lines.select("stream", "line_no", "line", mark.alias("mark"), (-F.col("line_no")).alias("back")).where("mark is not null")
    marks = previous(marks, ["stream"], F.floor(F.col("back") / SPAN), ["back"], {"mark": "next"})
    return marks.where("mark = 'header'").select("stream", "line_no", table_of(F.col("line")).alias("table"), F.coalesce(F.col("next") != "end", F.lit(True)).alias("truncated"))


def context_lines(lines: DataFrame, error: Column, around: int) -> DataFrame:
    """Lines within `around` of one that has an error, in the same stream. A block of a stream's lines is looked through at once, with `around` lines of its neighbours."""
    block = max(SPAN, around)
    rows = running(lines.withColumn("is_error", error), ["stream"], F.floor(F.col("line_no") / SPAN), ["line_no"], F.lit(1), "at")
    own = F.floor(F.col("at") / block)
    touched = F.filter(F.array(own - 1, own, own + 1), lambda b: (F.col("at") + around >= b * block) & (F.col("at") - around < (b + 1) * block))
    w = Window.partitionBy("stream", "block").orderBy("at").rowsBetween(-around, around)
    seen = rows.withColumn("block", F.explode(touched)).withColumn("near", F.max(F.col("is_error").cast("int")).over(w))
    return seen.where((F.col("near") == 1) & (F.col("block") == own)).select("stream", "line_no", "line", "is_error")


def count_batches(rows: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    """rows with `batch`: the number of their run of `size` rows, in the order of a number."""
    counted = running(rows, by, F.floor(F.col(order) / SPAN), [order], F.lit(1), "__n")
    return counted.withColumn("batch", F.floor(F.col("__n") / size).cast("long")).drop("__n")


def insert_batches(rows: DataFrame, table: str, values: Column, order: str, size: int = 5000) -> DataFrame:
    """One INSERT statement for each run of `size` rows, in the order of a number, within a table's parts (column part)."""
    numbered = count_batches(rows.select("part", F.col(order).alias("__o"), values.alias("__v")), ["part"], "__o", size)
    g = numbered.groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("r"))
    return g.select("part", "batch", F.size("r").alias("rows"), F.concat(F.lit(f"INSERT INTO {table} VALUES "), F.array_join(F.transform("r", lambda s: s["__v"]), ", "), F.lit(";")).alias("statement"))


def mysql_literal(value: Column, kind: str) -> Column:
    """A value as SQL text: NULL, numbers as they are (NaN and infinite ones NULL), bytes as hexadecimal digits, text escaped."""
    if kind in ("double", "float"):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(value.isNull() | bad, "NULL").otherwise(value.cast("string"))
    if kind == "binary":
        return F.when(value.isNull(), "NULL").when(F.octet_length(value) == 0, "''").otherwise(F.concat(F.lit("0x"), F.hex(value)))
    if kind == "string":
        text = value
        for raw, mark in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0"), ("\x1a", "\\Z")):
            text = F.replace(text, F.lit(raw), F.lit(mark))
        return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def copy_text(value: Column) -> Column:
    """A value in the text format of COPY."""
    text = value.cast("string")
    for raw, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return F.coalesce(text, F.lit("\\N"))


#: Spark's types as PostgreSQL's.
POSTGRES_TYPES = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "boolean": "boolean", "string": "text", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone"}


def postgres_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return postgres_type(kind.elementType) + "[]"
    return POSTGRES_TYPES.get(kind.simpleString(), "jsonb")


def greedy_batches(statements: DataFrame, by: Sequence[str], order: str, most_rows: int, most_bytes: int) -> DataFrame:
    """statements with bytes: numbers of batches, each closed before it would hold too many rows or bytes. A fold over one group's statements in order."""

    def step(s: list[int], at: object, size: int | None) -> list[tuple]:
        if s[1] and (s[1] >= most_rows or s[2] + (size or 0) > most_bytes):
            s[:] = s[0] + 1, 0, 0
        s[1], s[2] = s[1] + 1, s[2] + (size or 0)
        return [(at, s[0])]

    out = T.StructType([statements.schema[order], T.StructField("batch", T.LongType())])
    return folded(statements.select(*by, order, "bytes"), by, [order], out, lambda: [0, 0, 0], step, lambda _: [])


@udtf(returnType="seq bigint, kind string, phase string, table_name string, statement string, copy_rows bigint, copy_bytes bigint")
class SplitDump:
    """The statements of a dump's text; a COPY statement takes its rows along as their number and bytes."""

    def eval(self, text: str) -> Iterator[tuple]:
        import re

        if text is None:
            return
        seq, held, quote, dollar = 0, [], False, None
        lines = iter(text.split("\n"))
        for line in lines:
            bare = line.strip()
            if not held and (not bare or bare.startswith("--")):
                continue
            held.append(line)
            k = 0
            while k < len(line):  # quotes and dollar quotes hide semicolons
                if dollar:
                    at = line.find(dollar, k)
                    if at < 0:
                        break
                    k, dollar = at + len(dollar), None
                elif quote:
                    at = line.find("'", k)
                    if at < 0:
                        break
                    k, quote = at + 1, False
                else:
                    m = re.compile(r"'|\$[A-Za-z_]*\$").search(line, k)
                    if not m:
                        break
                    k = m.end()
                    quote, dollar = m[0] == "'", m[0] if m[0] != "'" else None
            if quote or dollar or not bare.endswith(";"):
                continue
            statement = "\n".join(held).strip()
            held = []
            head, rows, size = statement.upper(), None, None
            if head.startswith("COPY ") and head.endswith("FROM STDIN;"):
                rows, size = 0, 0
                for data in lines:
                    if data == "\\.":
                        break
                    rows, size = rows + 1, size + len(data.encode()) + 1
            m = re.match(r"(?is)(?:create table (?:if not exists )?|alter table (?:only )?|copy |insert into |create (?:unique )?index.*? on (?:only )?)([^\s(;]+)", statement)
            later = re.match(r"CREATE (UNIQUE )?INDEX|CREATE (TRIGGER|RULE)", head) or (head.startswith("ALTER TABLE") and "ADD CONSTRAINT" in head)
            data = head.startswith(("COPY ", "INSERT INTO"))
            yield seq, head.split("(")[0].split()[0].lower(), "post-data" if later else "data" if data else "pre-data" if re.match("CREATE|ALTER|SET|SELECT PG_CATALOG.SETVAL", head) else "unknown", m and m[1], statement, rows, size
            seq += 1
        if held:
            yield seq, "incomplete", "unknown", None, "\n".join(held), None, None


def split_dumps(spark: SparkSession, dumps: DataFrame) -> DataFrame:
    """dumps: dump_id, text. Their statements in order."""
    spark.udtf.register("split_dump", SplitDump)
    return spark.sql("SELECT d.dump_id, s.* FROM {d} d, LATERAL split_dump(d.text) s", d=dumps)


def dump_stats(statements: DataFrame) -> DataFrame:
    return statements.groupBy("dump_id").agg(F.count("*").alias("statements"), F.count_if(F.col("phase") == "pre-data").alias("pre_data"), F.count_if(F.col("kind") == "copy").alias("copies"), F.count_if(F.col("phase") == "post-data").alias("post_data"), F.sum("copy_rows").alias("rows"), F.max_by("table_name", F.struct("copy_bytes", "seq")).alias("largest"))


def valid_name(name: Column) -> Column:
    """Letters, digits, _ and -, not starting with a digit, up to 63."""
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_-]{0,62}$"), F.lit(False))


def valid_bucket(name: Column) -> Column:
    """3 to 63 lower-case letters, digits, dots and dashes, a letter or digit at both ends, no two dots, no address."""
    return F.coalesce(name.rlike(r"^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$") & ~name.contains("..") & ~name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False))


def valid_port(port: Column) -> Column:
    return F.coalesce(port.between(1, 65535), F.lit(False))


def valid_host(host: Column) -> Column:
    return F.coalesce((F.length(host) <= 253) & host.rlike(r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"), F.lit(False))


def restore_preview(backups: DataFrame, path: Column) -> DataFrame:
    """Format, compression, estimated unpacked size and seconds for each archive."""
    raw = F.when(compression_of(path) == "none", F.col("size_bytes")).otherwise(F.col("size_bytes") * 4)
    return backups.select("id", archive_format(path).alias("format"), compression_of(path).alias("compression"), raw.alias("unpacked"), F.round(raw / 1048576.0 / 50, 11).alias("seconds"))
