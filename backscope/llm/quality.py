"""Document quality by hierarchical empirical Bayes, in DataFrame operations.

Evidence of a document: a naive Bayes log likelihood ratio over binned traits of its whole text (marks, capitals, repeated
words, words that repeat their predecessor, size). Evidence of its place: the share of good documents among the labelled
ones of its host is shrunk towards the global share, that of its path towards its host's, each with the prior strength that
the spread of the shares asks for (method of moments), so that sparse sites follow their parents. Posterior log odds are
the sum of the document's evidence and the log odds of its path. A document is rejected if it is more likely bad than good.

A null text counts as empty. A null host or path is a host or path of its own. Labels that are null are left out; an id
that repeats in the labels counts each time. Without labels every document is as likely good as bad, and kept. Repeated
rows are scored each on its own; so are rows whose id is null, which no label meets. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, keep

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters that count as marks.
MARKS = "%$#*&|!"
TRAITS = ("marks", "capitals", "variety", "echoes", "size")
BINS = 11
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Places that are sent to all executors at most; more are joined by a shuffle.
SENT = 100_000


def traits(text: Column) -> list[Column]:
    """Each trait's bin, 0 to BINS - 1, from integers only."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1))
    length = F.greatest(F.length(text), F.lit(1))
    def count(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))
    echoes = F.size(F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: a == b), lambda x: x))
    values = {"marks": F.floor(10 * count(MARKS) / n), "capitals": F.floor(10 * count(UPPER) / length), "variety": F.floor(10 * F.size(F.array_distinct(words)) / n), "echoes": F.floor(10 * echoes / n), "size": F.floor(F.log2(F.size(words) + F.lit(1.0)) / 2)}
    return [F.least(values[t], F.lit(BINS - 1)).cast("int").alias(t) for t in TRAITS]


def strength(sites: DataFrame, good: str, n: str, expected: Column) -> float:
    """The Beta prior's strength that the spread of shares around their expectation asks for; one row reaches the driver."""
    share = F.col(good) / F.col(n)
    x = sites.agg(F.sum(F.col(n) * (share - expected) ** 2), F.sum(expected * (1 - expected)), F.sum(F.col(n) * expected * (1 - expected)), F.count("*")).first()
    spread, noise, total, sites_n = x
    if not sites_n or not total:
        return STRONGEST
    # within a site of n documents the share's variance is v / n, so that n times it sums to v for each site
    between = (spread - noise) / total
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, 1 / between - 1))


def classify(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the given columns (but those that are called like a result), evidence, host_share, path_share, score (chance that it is good), kept (score >= 0.5)."""
    columns = tuple(c for c in columns if c not in (id, "doc_id", "evidence", "host_share", "path_share", "score", "kept"))
    given = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in columns]).alias("__given")
    places = [F.concat(F.when(F.col(f"`{c}`").isNull(), "n").otherwise("s"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in (host, path)]
    told = labels.select(F.col(f"`{id}`").alias("__label_id"), F.col(f"`{label}`").cast("int").alias("__good")).where("__label_id is not null and __good is not null")
    # texts are read once, and given columns written along
    told_of = keep(df.select(F.col(f"`{id}`").alias("__id"), given, places[0].alias("__host"), places[1].alias("__path"), *[c.alias(f"__{t}") for c, t in zip(traits(F.col(f"`{text}`")), TRAITS, strict=True)]), "quality-traits")
    known = told_of.withColumnsRenamed({f"__{t}": t for t in TRAITS}).join(told, F.col("__id") == F.col("__label_id"))
    known = keep(known.select("__host", "__path", (F.col("__good") > 0).cast("int").alias("__good"), *TRAITS), "quality-known")
    total, good = known.agg(F.count("*"), F.coalesce(F.sum("__good"), F.lit(0))).first()
    share = (good + 1) / (total + 2)
    paths = keep(known.groupBy("__host", "__path").agg(F.sum("__good").alias("path_good"), F.count("*").alias("path_n")), "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    m = strength(hosts, "host_good", "host_n", F.lit(share))
    hosts = keep(hosts.select("__host", ((F.col("host_good") + m * share) / (F.col("host_n") + m)).alias("host_share")), "quality-hosts")
    paths = paths.join(hosts, "__host")
    k = strength(paths, "path_good", "path_n", F.col("host_share"))
    paths = keep(paths.select("__host", "__path", ((F.col("path_good") + k * F.col("host_share")) / (F.col("path_n") + k)).alias("path_share")), "quality-shares")
    # at most BINS rows for each trait and label
    counts = {(r[0], r[1], r[2]): r[3] for t in TRAITS for r in known.groupBy(F.lit(t), F.col(t), "__good").count().collect()}

    def ratio(trait: str, b: int) -> float:
        n = [math.log((counts.get((trait, b, g), 0) + 1) / ((good if g else total - good) + BINS)) for g in (0, 1)]
        return n[1] - n[0]

    evidence = reduce(Column.__add__, [F.element_at(F.array(*[F.lit(ratio(t, b)) for b in range(BINS)]), F.col(f"__{t}") + 1) for t in TRAITS])
    rows = told_of.select(F.col("__id").alias("doc_id"), *["__given"] * bool(columns), "__host", "__path", evidence.alias("evidence"))
    for site, keys in ((hosts, ["__host"]), (paths, ["__host", "__path"])):
        rows = rows.join(F.broadcast(site) if site.count() <= SENT else site, keys, "left")
    rows = rows.withColumn("host_share", F.coalesce("host_share", F.lit(share))).withColumn("path_share", F.coalesce("path_share", "host_share"))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_share") / (1 - F.col("path_share"))))))
    return rows.select("doc_id", *[F.col("__given")[c].alias(c) for c in columns], "evidence", "host_share", "path_share", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)
