"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: sources share the mix by weight; none gets more than `most` times its size, and what exceeds that is shared anew
by weight among the others. Blocks of equal numbers of words are the seats: they go to the sources by highest quotients
target / (2k + 1), and each source's blocks go to its shards likewise, by the shards' words. No shard gets more than `most`
times its words; what exceeds that goes to the source's other shards, by the words that they can still take. A shard of a source
is a ring of its documents in a seeded order; its quota is whole turns of the ring, and then words from a seeded start on.

A null text has no words and is never taken. Sources go by code point, null last, a source of its own. Documents of one
id, or wholly equal ones, are documents of their own. An empty table gives an empty result; where no document has words,
all targets are 0. Ties of quotients go to the source, or shard, that comes first. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Words in a block, documents in a shard (about), and the seed of all orders.
BLOCK, SHARD_DOCS, SEED = 32, 512, "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def fraction(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1, from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def apportioned(df: DataFrame, seats: Column, weight: Column, by: list[str], order: list[Column], out: str) -> DataFrame:
    """df with the seats that each row gets within its group `by`, by highest quotients weight / (2k + 1).

    With n rows and M seats, rounding weight * (M - n/2) / sum gives at most M seats, which all belong to the highest
    quotients; at most n are left, of which a row can get n * weight / sum + 1. So only about 2n quotients are compared.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = df.select("*", seats.alias("__m"), weight.alias("__w"), F.sum(weight).over(group).alias("__sum"), F.count("*").over(group).alias("__n"))
    share = F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum")).otherwise(F.lit(0.0))
    base = base.select("*", F.floor(F.greatest(F.lit(0.0), F.col("__m") - F.col("__n") / F.lit(2.0)) * share + F.lit(0.5)).alias("__base"), F.floor(F.col("__n") * share).alias("__few"))
    base = base.withColumn("__base", F.when(F.col("__w") > 0, F.greatest(F.lit(0), F.col("__base") - 1)).otherwise(F.lit(0)))
    tried = base.select("*", F.sum("__base").over(group).alias("__given")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__few") + 3)).alias("__k"))
    quotient = F.col("__w") / (F.lit(2.0) * (F.col("__base") + F.col("__k")) + F.lit(1.0))
    left = F.col("__m") - F.col("__given")
    ranked = tried.withColumn("__rank", F.row_number().over(group.orderBy(quotient.desc(), *order, F.col("__k"))))
    names = df.columns
    return ranked.groupBy(*names).agg((F.first("__base") + F.count_if((F.col("__rank") <= left) & (F.col("__w") > 0))).cast("long").alias(out)).select(*names, out)


def bounded(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with no quota above its cap: what exceeds caps goes to the group's other rows, in proportion to what they can still take, and is lost only where all are full."""
    group = Window.partitionBy(by)
    df = df.select("*", F.greatest(F.lit(0), F.col("cap") - F.col("quota")).alias("__room"), F.greatest(F.lit(0), F.col("quota") - F.col("cap")).alias("__over"))
    df = df.select("*", F.sum("__room").over(group).alias("__rooms"), F.sum("__over").over(group).alias("__overs"), F.sum("__room").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"))

    def given(upto: str) -> Column:
        """Whole words of the excess up to there; exact, as products may exceed 64 bits."""
        return F.expr(f"cast({upto} as decimal(19,0)) * cast(least(__overs, __rooms) as decimal(19,0)) div cast(greatest(__rooms, 1) as decimal(19,0))")

    more = given("__upto") - given("(__upto - __room)")
    return df.withColumn("quota", F.least("quota", "cap") + more).drop("__room", "__over", "__rooms", "__overs", "__upto")


def targets(sources: DataFrame, most: int = 3, weights: int = 3) -> DataFrame:
    """sources: (source, source_size). Adds weight and target: min(most * size, level * weight) with one level for all, so that the targets sum to all sizes."""
    everything = Window.partitionBy(F.lit(0))
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sources.select("source", "source_size", ((F.row_number().over(named) - 1) % weights + 1).cast("long").alias("weight"))
    cap = F.col("source_size") * most
    s = s.select("*", F.sum("source_size").over(everything).alias("all_size"), F.sum("weight").over(everything).alias("all_weight"), cap.alias("cap"))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.coalesce(F.sum("cap").over(fill), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("weight_before"))
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.select("*", level.alias("level"), (level * F.col("weight") <= F.col("cap")).alias("below"))
    s = s.withColumn("level", F.min(F.when(F.col("below"), F.struct("weight_before", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, most: int = 3) -> DataFrame:
    """For each row of df: doc_id, source, text_md5, size, source_size, target, turns (whole copies), extra_at and extra (words of one more, partial copy: they start at word extra_at, and go on at word 0 after the last if they wrap), taken."""
    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_md5"))
    rows = keep(rows, "mix-sizes")
    n = rows.count()
    shard = (fraction(F.lit(seed), F.lit("shard"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5")) % max(1, -(-n // shard_docs))).alias("shard")
    rows = rows.select("*", shard)
    cells = keep(rows.groupBy("source", "shard").agg(F.sum("size").alias("words")), "mix-cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    seats = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / F.lit(float(block))).cast("long")
    sources = keep(apportioned(sources.withColumn("seats", seats), F.col("seats"), F.col("target"), [], [F.col("source").asc_nulls_last()], "blocks").drop("seats"), "mix-sources")
    # null sources meet under a name that no other has
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("key")
    quota = cells.select(key, "shard", "words").join(sources.select(key, F.col("blocks"), "source_size", "target"), "key")
    quota = apportioned(quota, F.col("blocks"), F.col("words").cast("double"), ["key"], [F.col("shard")], "quota")
    quota = bounded(quota.withColumn("quota", F.col("quota") * block).withColumn("cap", F.col("words") * most), "key", "shard")
    quota = quota.select("key", "shard", "words", "source_size", "target", "quota")
    quota = keep(quota.withColumn("start", F.when(F.col("words") > 0, (fraction(F.lit(seed), F.lit("start"), F.col("key"), F.col("shard").cast("string")) % F.greatest(F.col("words"), F.lit(1)))).otherwise(F.lit(0))), "mix-quotas")
    ring = Window.partitionBy("shard", "key").orderBy(fraction(F.lit(seed), F.lit("ring"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), F.col("size"), F.col("text_md5")).rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.select("doc_id", "source", "text_md5", "size", "shard", key).repartition("shard").select("*", (F.sum("size").over(ring) - F.col("size")).alias("at"))
    done = laid.join(quota, ["shard", "key"])
    turns = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.greatest(F.col("words"), F.lit(1)))).otherwise(F.lit(0))
    done = done.select("*", turns.alias("turns"), F.when(F.col("words") > 0, F.col("quota") % F.greatest(F.col("words"), F.lit(1))).otherwise(F.lit(0)).alias("part"))
    # the ring's part [start, start + part) and, past its end, [0, start + part - words)
    low, high = F.greatest(F.col("at"), F.col("start")), F.least(F.col("at") + F.col("size"), F.col("start") + F.col("part"))
    direct = F.greatest(F.lit(0), high - low)
    wrapped = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("start") + F.col("part") - F.col("words")) - F.col("at"))
    done = done.select("*", (low - F.col("at")).alias("direct_at"), direct.alias("direct"), wrapped.alias("wrapped"))
    taken = F.col("turns") * F.col("size") + F.col("direct") + F.col("wrapped")
    return done.select("doc_id", "source", "text_md5", "size", "source_size", "target", "turns", F.when(F.col("direct") > 0, F.col("direct_at")).otherwise(F.lit(0)).alias("extra_at"), "direct", "wrapped", taken.cast("long").alias("taken"))
