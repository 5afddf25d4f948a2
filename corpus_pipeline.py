"""A corpus from raw documents to token ids, in five stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backscope.llm import bpe, mixing, neardup, quality, secrets
from backscope.llm.common import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "[secret]"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=COLUMNS)
    return scored.where("kept").select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Of rows with one id in one group, the first by text, language, source; a row without id, or without words, always stays."""
    found = neardup.near_duplicates(docs, columns=COLUMNS[1:])
    # unrelated groups can have one smallest id; rows without id all stay, and are spread by v
    counted = F.col("v").isNotNull() & F.col("doc_id").isNotNull()
    again = Window.partitionBy("label", "doc_id", F.when(~counted, F.col("v"))).orderBy("text", "lang", "source", "n_chars")
    kept = found.where(F.col("kept") | F.col("doc_id").isNull() | F.col("v").isNull())
    return kept.withColumn("n", F.when(counted, F.row_number().over(again)).otherwise(1)).where("n = 1").select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    out = secrets.scan(docs, columns=COLUMNS, masked=MASK)
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole copies as they are, and the words of a partial copy joined by spaces."""
    facts = mixing.mix(docs).where("taken > 0")
    # equal rows are told apart by a number on both sides
    same = Window.partitionBy("doc_id", "text_md5", "source")
    facts = keep(facts.withColumn("n", F.row_number().over(same.orderBy("taken", "turns", "extra_at", "direct", "wrapped"))).select("doc_id", "text_md5", "source", "n", "turns", "extra_at", "direct", "wrapped"), "mix-facts")
    rows = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    rows = rows.withColumn("n", F.row_number().over(same.orderBy("lang", "n_chars")))
    on = [rows[c].eqNullSafe(facts[c]) for c in ("doc_id", "text_md5", "source", "n")]
    met = rows.join(facts, on).select(*[rows[c] for c in COLUMNS], "turns", "extra_at", "direct", "wrapped")
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.col("turns"), F.lit(1))), lambda _: F.struct(F.col("text"), F.col("n_chars")))
    whole = F.when(F.col("turns") > 0, whole).otherwise(F.array().cast("array<struct<text: string, n_chars: bigint>>"))
    words = F.regexp_extract_all("text", F.lit(f"({mixing.WORDS})"), F.lit(1))

    def part(at, n):
        text = F.array_join(F.slice(words, (at + 1).cast("int"), n.cast("int")), " ")
        return F.when(n > 0, F.array(F.struct(text.alias("text"), F.length(text).cast("long").alias("n_chars")))).otherwise(F.array().cast("array<struct<text: string, n_chars: bigint>>"))

    copies = F.concat(whole, part(F.col("extra_at"), F.col("direct")), part(F.lit(0), F.col("wrapped")))
    return met.select("doc_id", "lang", "source", F.explode(copies).alias("c")).select("doc_id", "c.text", "lang", "source", "c.n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [("quality classifier", good), ("near duplicates", single), ("secret scans", masked), ("source mixing", mixed), ("token ids", tokens)]
#: Byte-pair encoding has no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, name.replace(" ", "-"))
    return docs
