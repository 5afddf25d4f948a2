"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, lattice, media, mixing, neardup, quality, secrets, toxicity, warc
from .common import keep, scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_share", "path_share", "score")], "kept")


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=4, share=80)


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents")).select("doc_id", "spans")
    base = [r.kind for r in secrets.BASE]
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("spans"), base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([media.to_wav(media.padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_carved int"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_type", "media_length", "corrected")), strict=True):
            doc, n, stored, kind, length, corrected = row
            about, samples = media.from_wav(stored[:length])
            x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
            turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            told = f"{kind};rate={about['rate']};bits={about['bits']};channels={about['channels']};samples={len(x)};energy={int(x @ x)};peak={int(np.abs(x).max())};crossings={turns};bands={','.join(map(str, np.bincount((x + 128) >> 5, minlength=8)))}"
            rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), told, kind, corrected, len(media.found(samples))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op5_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The payload is stored as WAV samples in a media column declared as plain bytes, sniffed, and read back; n_carved counts the media that the payload itself holds."""
    source = table(spark, folder, "documents").select("doc_id", "text")
    stored = source.mapInArrow(_stored, "doc_id long, n_bytes long, media binary").withColumn("declared", F.lit("application/octet-stream"))
    stored = keep(stored, "media")
    sniffed = media.sniff(stored, "media", "declared", ("doc_id", "n_bytes"), carve=False)
    return sniffed.drop("carved", "declared_type").mapInArrow(_features, FEATURES)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return toxicity.score(documents, model).select("doc_id", "held_out", "score", "predicted", told.alias("offsets"))


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings"), 0.95)


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    out = warc.read(spark, archive, payloads=False)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_secret_scans, op4_source_mixing, op5_media_columns, op6_toxicity, op7_embedding_near_dedup, op8_lm_scoring, op9_bpe, op10_warc)}
