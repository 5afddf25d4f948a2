"""Transaction logs: chains, windows of recovery, timelines, filters of log text, recovery targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from .chains import ancestors, known, previous


def number_of(name: Column) -> Column:
    """The number at the end of a log file's name."""
    return F.regexp_extract(name, r"\.([0-9]+)$", 1).try_cast("long")


def position_of(text: Column) -> Column:
    """'file:offset' as (file number, offset), which compares in order."""
    return F.struct(number_of(F.split_part(text, F.lit(":"), F.lit(1))).alias("file"), F.split_part(text, F.lit(":"), F.lit(2)).try_cast("decimal(20,0)").alias("pos"))


#: Log numbers, or lines of a log, in a span.
SPAN = 1024


def _steps(files: DataFrame) -> DataFrame:
    """files with the series of their name and `before`, the number before theirs in it; a series meets span by span."""
    series = files.withColumn("series", F.regexp_extract("name", r"^(.*)\.[0-9]+$", 1))
    return previous(series, ["series"], F.floor(F.col("number") / SPAN), ["number", "name"], {"number": "before"})


def chain(files: DataFrame) -> DataFrame:
    """Each file with what is wrong before it: numbers that are missing, and another server than the last known one. Equal numbers go by name."""
    server = F.nullif(F.col("server_id"), F.lit(0))
    out = known(_steps(files), ["series"], F.floor(F.col("number") / SPAN), ["number", "name"], server, "server_before")
    return out.select("name", "number", F.when(F.col("number") != F.col("before") + 1, F.col("number") - F.col("before") - 1).otherwise(0).alias("missing"), ((F.col("server_id") != 0) & (F.col("server_before") != F.col("server_id"))).alias("server_changed"))


def chain_summary(files: DataFrame) -> DataFrame:
    return chain(files).agg(F.count("*").alias("files"), F.count_if(F.col("missing") > 0).alias("gaps"), F.sum("missing").alias("missing"), F.count_if("server_changed").alias("warnings"), (F.count_if(F.col("missing") > 0) == 0).alias("valid"))


#: Ranges that overlapping() takes at a time.
RANGES = 10_000


def overlapping(files: DataFrame, ranges: DataFrame, as_of: str) -> DataFrame:
    """Files whose time overlaps a range (range_id, range_start, range_end); a file without times always does, an open end lasts until now. At most RANGES ranges, which go to every executor."""
    if ranges.limit(RANGES + 1).count() > RANGES:
        raise ValueError(f"more than {RANGES} ranges: ask for them in parts")
    end = F.coalesce("end_time", F.lit(as_of).cast("timestamp_ntz"))
    timeless = F.col("start_time").isNull() & F.col("end_time").isNull()
    on = timeless | ((F.coalesce(F.col("start_time"), F.col("range_start")) <= F.col("range_end")) & (end >= F.col("range_start")))
    return files.join(F.broadcast(ranges), on).select("range_id", "name")


def recovery_windows(bases: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """bases: (base_id, base_time, start_number). For each the log files from its start on: how many, the last by end time, and gaps among them.

    The series is cut into spans of numbers. Inside a span files are summed from its end; whole spans are summed from the
    end of the series. A base finds its place by its span, so that nothing grows with bases times files.
    """
    def span(number: str) -> Column:
        return F.floor(F.col(number) / SPAN).alias("span")

    told = F.struct("end_time", "number", "name")
    f = files.select("number", "name", "end_time", span("number"))
    w = Window.partitionBy("span").orderBy("number")
    f = f.withColumn("next", F.lead("number").over(w))
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    gap = F.when(F.col("next") != F.col("number") + 1, 1).otherwise(0)
    inside = f.select("span", "number", F.count("*").over(rest).alias("n"), F.max(told).over(rest).alias("last"), F.sum(gap).over(rest).alias("gaps"), F.lag("number", 1, -1).over(w).alias("before"))
    sums = f.groupBy("span").agg(F.count("*").alias("n"), F.max(told).alias("last"), F.sum(gap).alias("gaps"), F.min("number").alias("low"), F.max("number").alias("high"))
    sums = sums.unionByName(bases.select(span("start_number")).distinct().join(sums, "span", "left_anti"), allowMissingColumns=True)
    # a row for each span of numbers: few enough for one order
    order = Window.orderBy(F.col("span").desc())
    later = order.rowsBetween(Window.unboundedPreceding, -1)
    following = F.last("low", ignorenulls=True).over(later)
    sums = sums.select("span", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later_n"), F.max("last").over(later).alias("later_last"), F.coalesce(F.sum("gaps").over(later), F.lit(0)).alias("later_gaps"), F.when(following != F.col("high") + 1, 1).otherwise(0).alias("edge"))
    # the gap after a span's last file is counted with the spans before it
    edges = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("later_gaps", F.col("later_gaps") + F.coalesce(F.sum("edge").over(edges), F.lit(0)))
    b = bases.select("base_id", "base_time", "start_number", span("start_number")).join(sums, "span")
    i = inside.withColumnRenamed("span", "own_span")
    out = b.join(i, (F.col("span") == F.col("own_span")) & (F.col("start_number") > F.col("before")) & (F.col("start_number") <= F.col("number")), "left")
    last = F.greatest(F.col("last"), F.col("later_last"))
    gaps = F.coalesce(F.col("gaps") + F.col("edge"), F.lit(0)) + F.col("later_gaps")
    out = out.withColumn("newest", last)
    return out.select("base_id", "base_time", (F.coalesce("n", F.lit(0)) + F.col("later_n")).alias("log_files"), F.coalesce(F.col("newest.end_time"), F.lit(as_of).cast("timestamp_ntz")).alias("end_time"), F.col("newest.name").alias("last_file"), (gaps > 0).alias("has_gaps"))


def replay_files(files: DataFrame, first: int, last: int) -> DataFrame:
    return files.where(F.col("number").between(first, last))


def archive_stats(files: DataFrame, full: int = 16 << 20) -> DataFrame:
    """files: name, size, time, compressed, encrypted. Totals, oldest and newest, and the rate against full segments."""
    g = files.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.count_if("compressed").alias("compressed"), F.count_if("encrypted").alias("encrypted"), F.min(F.struct("time", "name"))["name"].alias("oldest"), F.max(F.struct("time", "name"))["name"].alias("newest"))
    return g.withColumn("compression_rate", F.round(100.0 * (1 - F.col("size") / (F.col("files") * full)), 6))


def archive_metrics(files: DataFrame, as_of: str) -> DataFrame:
    """Count, size, oldest and newest, lag, window in minutes, gaps."""
    g = _steps(files).withColumn("step", F.col("number") - F.col("before")).agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.min("start_time").alias("oldest"), F.max("end_time").alias("newest"), F.count_if(F.col("step") > 1).alias("gaps"))
    return g.withColumn("lag_seconds", x.seconds(F.col("newest"), F.lit(as_of).cast("timestamp_ntz"))).withColumn("window_minutes", F.floor(x.seconds(F.col("oldest"), F.col("newest")) / 60).cast("long"))


#: Statements that change rows and name their table, statements of definition, and a whole line that chooses a database.
TABLE_REFERENCE = r"(?i)(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|REPLACE\s+INTO)\s+(?:`?([A-Za-z0-9_]+)`?\.)?`?([A-Za-z0-9_]+)`?"
DDL = r"(?i)^\s*(CREATE|ALTER|DROP|TRUNCATE|RENAME)\s"
USE = r"(?i)^USE\s+`?([A-Za-z0-9_]+)`?\s*;?\s*$"


def filter_lines(lines: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), skip_ddl: bool = False) -> DataFrame:
    """Log text (stream, line_no, line) with whether each line is kept. Comments and USE stay; a table without database takes that of the last USE before it. The lists only judge statements that change rows; definitions go with skip_ddl alone."""
    text = F.trim("line")
    used = F.nullif(F.regexp_extract(text, USE, 1), F.lit(""))
    told = lines.select("stream", "line_no", text.alias("text"), used.alias("used"), F.regexp_extract(text, TABLE_REFERENCE, 1).alias("own"), F.regexp_extract(text, TABLE_REFERENCE, 2).alias("table"))
    told = known(told, ["stream"], F.floor(F.col("line_no") / SPAN), ["line_no"], F.col("used"), "before").withColumn("db", F.coalesce("used", "before", F.lit("")))
    name = F.lower(F.concat(F.when(F.col("own") != "", F.col("own")).otherwise(F.col("db")), F.lit("."), F.col("table")))
    plain = (F.col("text") == "") | F.col("text").startswith("#") | F.col("text").startswith("--") | F.col("used").isNotNull()
    keep = F.when(plain, True)
    if skip_ddl:
        keep = keep.when(F.col("text").rlike(DDL), False)
    if include or exclude:
        fits = (name.isin(*[i.lower() for i in include]) if include else F.lit(True)) & (~name.isin(*[e.lower() for e in exclude]) if exclude else F.lit(True))
        keep = keep.when(F.col("table") != "", fits)
    return told.select("stream", "line_no", F.when(F.col("table") != "", name).alias("table"), keep.otherwise(True).alias("keep"))


def check_filter(include: Sequence[str], exclude: Sequence[str]) -> None:
    """Lists that exclude each other, and names without a database, are errors."""
    if include and exclude:
        raise ValueError("include and exclude can't both be given")
    bad = [n for n in (*include, *exclude) if n.count(".") != 1 or not all(n.split("."))]
    if bad:
        raise ValueError(f"not database.table: {', '.join(bad)}")


def log_headers(lines: DataFrame) -> DataFrame:
    """Of log text by stream: first and last time, server, first and last end position, last transaction id."""
    at = F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract("line", r"^#([0-9]{6})\s+([0-9:]{7,8})", 1), F.lit(" "), F.lpad(F.regexp_extract("line", r"^#([0-9]{6})\s+([0-9:]{7,8})", 2), 8, "0")), F.lit("yyyyMMdd HH:mm:ss"))
    end = F.regexp_extract("line", r"end_log_pos\s+([0-9]+)", 1).try_cast("decimal(20,0)")
    server = F.regexp_extract("line", r"server id\s+([0-9]+)", 1).try_cast("long")
    gtid = F.nullif(F.regexp_extract("line", r"GTID_NEXT=\s*'([^']+)'", 1), F.lit(""))
    told = lines.select("stream", "line_no", at.cast("timestamp_ntz").alias("at"), end.alias("end"), server.alias("server"), gtid.alias("gtid"))
    def first(c: str, f=F.min) -> Column:
        return f(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c]

    return told.groupBy("stream").agg(first("at").alias("start_time"), first("at", F.max).alias("end_time"), first("server").alias("server_id"), first("end").alias("first_pos"), F.max("end").alias("last_pos"), first("gtid", F.max).alias("gtid"))


def wal_name(name: Column) -> tuple[Column, Column, Column]:
    """Whether it is a segment's name (24 hexadecimal digits, and known endings), its timeline, and its segment as decimals."""
    base = F.regexp_replace(name, r"(\.gz|\.zst|\.enc|\.partial)+$", "")
    ok = base.rlike(r"^[0-9A-Fa-f]{24}$")
    return ok, F.when(ok, F.conv(F.substring(base, 1, 8), 16, 10).cast("decimal(20,0)")), F.when(ok, F.conv(F.substring(base, 9, 16), 16, 10).cast("decimal(20,0)"))


def lsn(text: Column) -> Column:
    """'hex/hex' as a number."""
    ok = text.rlike(r"^[0-9A-Fa-f]+/[0-9A-Fa-f]+$")
    high, low = (F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("decimal(20,0)") for k in (1, 2))
    return F.when(ok, high * F.lit(4294967296).cast("decimal(10,0)") + low).cast("decimal(38,0)")


def target_errors(kind: Column, value: Column, action: Column) -> Column:
    """What is wrong with recovery targets, in order; none if they are valid."""
    return x.rules(
        (~kind.isin("time", "xid", "lsn", "name", "immediate"), "type"),
        ((kind != "immediate") & (F.coalesce(value, F.lit("")) == ""), "empty"),
        ((kind == "time") & (value != "") & x.parsed_time(value).isNull(), "time"),
        ((kind == "xid") & (value != "") & ~value.rlike(r"^[0-9]{1,19}$"), "xid"),
        ((kind == "lsn") & (value != "") & ~value.rlike(r"^[0-9A-Fa-f]{1,16}/[0-9A-Fa-f]{1,16}$"), "lsn"),
        ((kind == "name") & (F.length(value) > 63), "name"),
        (~action.isin("pause", "promote", "shutdown"), "action"),
    )


def target_config(targets: DataFrame) -> DataFrame:
    """targets: id, type, value, action, timeline, inclusive. Rows of configuration."""
    kind = F.col("type")
    key = F.when(kind == "immediate", "recovery_target").otherwise(F.concat(F.lit("recovery_target_"), kind))
    pairs = F.array(
        F.struct(key.alias("k"), F.when(kind == "immediate", "immediate").otherwise(F.col("value")).alias("v")),
        F.struct(F.lit("recovery_target_action").alias("k"), F.col("action").alias("v")),
        F.struct(F.lit("recovery_target_timeline").alias("k"), F.coalesce(F.nullif("timeline", F.lit("")), F.lit("latest")).alias("v")),
        F.when(~kind.isin("immediate", "name"), F.struct(F.lit("recovery_target_inclusive").alias("k"), F.col("inclusive").cast("string").alias("v"))),
    )
    return targets.select("id", F.explode(F.array_compact(pairs)).alias("p")).select("id", F.col("p.k").alias("key"), F.col("p.v").alias("value"))


def timeline_paths(timelines: DataFrame, hops: int = 100) -> DataFrame:
    """(timeline, ancestor, depth) from each timeline up to its root. Timelines whose way is longer than that many hops have no path: see endless_timelines()."""
    found = _all_paths(timelines, hops)
    return found.join(found.where(F.col("depth") > hops).select("timeline").distinct(), "timeline", "left_anti")


def endless_timelines(timelines: DataFrame, hops: int = 100) -> DataFrame:
    """Timelines whose way up is longer than that many hops, which a cycle may have made."""
    return _all_paths(timelines, hops).where(F.col("depth") > hops).select("timeline", F.lit("possible cycle").alias("error")).distinct()


def _all_paths(timelines: DataFrame, hops: int) -> DataFrame:
    links = timelines.select(F.col("timeline").alias("id"), "parent")
    return ancestors(links, links, hops + 1).select(F.col("id").alias("timeline"), F.col("link").alias("ancestor"), "depth")


def broken_timelines(timelines: DataFrame) -> DataFrame:
    """Timelines (but the first) whose parent is unknown."""
    known = timelines.select(F.col("timeline").alias("parent"))
    return timelines.where("timeline > 1").join(known, "parent", "left_anti").select("timeline", "parent")


def timeline_segments(files: DataFrame, timelines: DataFrame) -> DataFrame:
    """The least and greatest segment of each known timeline."""
    ok, line, segment = wal_name(F.col("name"))
    seen = files.where(ok).select(line.cast("long").alias("timeline"), segment.alias("segment"))
    return seen.join(timelines.select("timeline"), "timeline").groupBy("timeline").agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.count("*").alias("segments"))


def timeline_at(timelines: DataFrame, position: str) -> DataFrame:
    """The newest timeline that had begun at a position, compared as numbers."""
    t = timelines.withColumn("at", lsn(F.col("switch_lsn"))).where(F.col("at") <= lsn(F.lit(position)))
    return t.agg(F.max(F.struct("at", "timeline"))["timeline"].alias("timeline"))


def timeline_tree(timelines: DataFrame, hops: int = 100) -> DataFrame:
    """Lines of a tree: by path, indented by depth."""
    paths = timeline_paths(timelines, hops).groupBy("timeline").agg(F.max("depth").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))), lambda s: F.lpad(s["ancestor"].cast("string"), 10, "0")), "/").alias("path"))
    return paths.select("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("timeline "), F.col("timeline").cast("string")).alias("line"))


def base_chain(backups: DataFrame, start: Column, hops: int = 100) -> DataFrame:
    """(id, link, depth): each backup that fits, what it builds on, up to a full one. backups: id, base_id."""
    return ancestors(backups.select("id", F.col("base_id").alias("parent")), backups.where(start).select("id"), hops)


def required_files(files: DataFrame, first: str, until: str) -> DataFrame:
    """Archived files (name, mod_time) from a name on, up to and with the first that is newer than the target time."""
    named = files.where(F.col("name") >= first).select("name", "mod_time")
    end = named.where(F.col("mod_time") > F.lit(until).cast("timestamp_ntz")).agg(F.min("name").alias("end"))
    return named.join(F.broadcast(end)).where("end is null or name <= end").select("name", "mod_time")


def choose_node(nodes: DataFrame, max_lag: float, strategy: str = "lowest_lag", prefer_replica: bool = True, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Of each cluster the acceptable replica by lag or priority; else its available primary."""
    fits = F.col("available") & (F.col("lag") <= max_lag)
    replica = F.col("role") == "replica"
    rank = F.when(replica & fits, 0).when((F.col("role") == "primary") & F.col("available"), 1 if prefer_replica else 0)
    first = F.col("priority") if strategy == "priority" else F.col("lag")
    w = Window.partitionBy(*by).orderBy("rank", first, "node_id")
    return nodes.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(w)).where("n = 1").select(*by, "node_id", "host", (F.col("rank") == 1).alias("fell_back"))
