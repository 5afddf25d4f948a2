"""Chains, trees and long orders without recursion and without one window for a whole key.

Links are followed by doubling: each round's pointers reach twice as far, as a written table, so that a chain of a million
links takes twenty rounds. Orders are cut into spans, and what crosses a span's edge comes from sums over spans.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir; where that is unset, on one machine, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new shared folder: lineage ends there, and a skewed join that reads it can be split."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def depths(links: DataFrame) -> DataFrame:
    """links: id, parent (0: a root's). (id, depth) from the roots on; null for what hangs on a cycle or on nothing known."""
    state = written(links.select("id", F.col("parent").alias("up"), F.lit(0).cast("long").alias("depth")), "depths")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.where("up <> 0").take(1):
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), (F.col("depth") + 1).alias("more"))
        state = written(state.join(above, "up", "left").select("id", F.when(F.col("up") == 0, F.col("up")).otherwise(F.col("next")).alias("up"), F.when(F.col("up") == 0, F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth")), "depths")
    return state.select("id", F.when(F.col("up") == 0, F.col("depth")).cast("int").alias("depth"))


def ancestors(links: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """links: id, parent; starts: id. (id, link, depth) for each start itself and all that it goes back to, at most so many hops.

    Pointers of 1, 2, 4 ... hops are made first; then, from the longest on, each row adds the one that lies so much further
    up. So every ancestor comes about once, in a number of rounds that grows with the logarithm of the hops.
    """
    known = links.select(F.col("id").alias("parent")).distinct()
    jumps = [written(links.join(known, "parent").select("id", F.col("parent").alias("up")), "jumps")]
    while 2 << len(jumps) - 1 <= hops and jumps[-1].take(1):
        last = jumps[-1]
        jumps.append(written(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "jumps"))
    rows = starts.select("id", F.col("id").alias("link"), F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps))):
        far = rows.join(jumps[k].select(F.col("id").alias("link"), "up"), "link").select("id", F.col("up").alias("link"), (F.col("depth") + (1 << k)).alias("depth"))
        rows = rows.unionByName(far.where(F.col("depth") <= hops))
        # a written table now and then keeps the plan short
        rows = written(rows, "ancestors") if k % 3 == 0 else rows
    return rows


def _spanned(rows: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    s = spans.withColumnsRenamed({c: f"__of_{c}" for c in (*by, "__span")})
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, "__span")]
    return rows.join(s, on).drop(*[f"__of_{c}" for c in (*by, "__span")])


def previous(rows: DataFrame, by: Sequence[str], span: Column, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """rows with columns of the row before, in the order given, under new names. The spans must go up with the order."""
    rows = rows.withColumn("__span", span)
    own = F.struct(*columns)
    inside = rows.withColumn("__lag", F.lag(own).over(Window.partitionBy(*by, "__span").orderBy(*order)))
    last = rows.groupBy(*by, "__span").agg(F.max_by(own, F.struct(*order)).alias("__last"))
    last = last.select(*by, "__span", F.lag("__last").over(Window.partitionBy(*by).orderBy("__span")).alias("__before"))
    out = _spanned(inside, last, by)
    return out.withColumns({new: F.coalesce("__lag", "__before")[old] for old, new in columns.items()}).drop("__span", "__lag", "__before")


def running(rows: DataFrame, by: Sequence[str], span: Column, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """rows with the sum of a value over all rows before them. The spans must go up with the order."""
    rows = rows.withColumn("__span", span).withColumn("__value", value)
    w = Window.partitionBy(*by, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(w), F.lit(0)))
    sums = rows.groupBy(*by, "__span").agg(F.sum("__value").alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__span", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    joined = _spanned(inside, sums, by)
    return joined.withColumn(out, F.col("__inside") + F.col("__base")).drop("__span", "__value", "__inside", "__base")


def known(rows: DataFrame, by: Sequence[str], span: Column, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """rows with the last value before them that isn't null. The spans must go up with the order."""
    rows = rows.withColumn("__span", span).withColumn("__value", value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__inside", F.last("__value", ignorenulls=True).over(before(Window.partitionBy(*by, "__span").orderBy(*order))))
    last = rows.groupBy(*by, "__span").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__last"))
    last = last.select(*by, "__span", F.last("__last", ignorenulls=True).over(before(Window.partitionBy(*by).orderBy("__span"))).alias("__before"))
    return _spanned(inside, last, by).withColumn(out, F.coalesce("__inside", "__before")).drop("__span", "__value", "__inside", "__before")


def newest(rows: DataFrame, by: Sequence[str], span: Column, order: Sequence[str], out: str) -> DataFrame:
    """rows with their rank from the last one on, nulls last. The spans must go up with the order."""
    rows = rows.withColumn("__span", span)
    inside = rows.withColumn("__inside", F.row_number().over(Window.partitionBy(*by, "__span").orderBy(*[F.col(c).desc() for c in order])))
    after = Window.partitionBy(*by).orderBy(F.col("__span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "__span").agg(F.count("*").alias("__rows"))
    counts = counts.select(*by, "__span", F.coalesce(F.sum("__rows").over(after), F.lit(0)).alias("__base"))
    return _spanned(inside, counts, by).withColumn(out, F.col("__inside") + F.col("__base")).drop("__span", "__inside", "__base")


def folded(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: StructType, begin: Callable[[], Any], step: Callable[..., list[tuple]], end: Callable[[Any], list[tuple]]) -> DataFrame:
    """Each key's rows in order through a fold: step(state, *the other columns) and end(state) give rows, which follow the key.

    One batch of rows and one state are held at once; Spark sorts, and spills. The rows of one key are read by one task,
    since what comes next depends on all before.
    """
    rest = [c for c in rows.columns if c not in by]
    schema = StructType([StructField(f.name, f.dataType) for f in (*(rows.schema[c] for c in by), *out)])
    arrow = to_arrow_schema(schema)

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for part in parts:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[: len(by)] != key:
                    if key is not None:
                        found += [(*key, *r) for r in end(state)]
                    key, state = row[: len(by)], begin()
                found += [(*key, *r) for r in step(state, *row[len(by) :])]
            yield table(found)
        if key is not None:
            yield table([(*key, *r) for r in end(state)])

    return rows.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
