"""Content-addressed chunks: cutting, references, liveness, verification, restoring.

What is alive follows from the manifests' references; no counter is kept, so that pruning can't free what is still used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import running, written

#: Bytes of the shortest, usual and longest chunk.
SHORTEST, USUAL, LONGEST = 4096, 8192, 32768
_GEAR = np.random.default_rng(8192).integers(0, 2**63, 256, dtype=np.uint64)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. A rolling sum of the last 64 bytes' gears, shifted as they age, marks an end where its low bits are 0.

    The sum starts anew with each chunk, so that only bytes of the chunk count; as the shortest chunk is longer than the
    sum's reach, that equals one sum over all bytes, which is made at once.
    """
    n = len(data)
    if not n:
        return []
    gears = _GEAR[np.frombuffer(data, np.uint8)]
    rolled = gears.copy()
    step = 1
    while step < 64:  # sums of 2, 4, ... 64 bytes
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint64(step))
        step *= 2
    marks = np.flatnonzero((rolled & np.uint64(USUAL - 1)) == 0) + 1
    out, start = [], 0
    while n - start > SHORTEST:
        k = int(np.searchsorted(marks, start + SHORTEST))
        end = min(int(marks[k]) if k < len(marks) else n, start + LONGEST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


CHUNKS = "source_id long, seq int, offset long, length int, hash string, data binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        for source, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = 0
            for seq, end in enumerate(cuts(data or b"")):
                part = data[start:end]
                rows.append((source, seq, start, end - start, hashlib.sha256(part).hexdigest(), part))
                held += end - start
                start = end
            if held > 16 << 20:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()


def chunk(blobs: DataFrame, id: str = "blob_id", data: str = "data") -> DataFrame:
    """Content-defined chunks of each value, with their SHA-256. Null and empty values have none."""
    return blobs.select(F.col(id).cast("long"), F.col(data)).mapInArrow(_chunked, CHUNKS)


def restore(chunks: DataFrame) -> DataFrame:
    """Each value from its chunks in order, and whether every chunk still has its hash."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "data", "hash")))
    g = chunks.groupBy("source_id").agg(parts.alias("p"))
    whole = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["data"])), ""))
    return g.select("source_id", whole.alias("data"), F.forall("p", lambda p: F.sha2(p["data"], 256) == p["hash"]).alias("ok"))


def _firsts(refs: DataFrame) -> DataFrame:
    """The first reference of each hash over all manifests in order; sums are taken before the shuffle."""
    return refs.groupBy("hash").agg(F.min(F.struct("manifest", "seq", "length")).alias("f")).select("hash", "f.*")


def new_chunks(refs: DataFrame) -> DataFrame:
    """References with whether each is its hash's first over all manifests in order."""
    firsts = written(_firsts(refs).select("hash", F.col("manifest").alias("__manifest"), F.col("seq").alias("__seq")), "firsts")
    return refs.join(firsts, "hash").withColumn("is_new", (F.col("manifest") == F.col("__manifest")) & (F.col("seq") == F.col("__seq"))).drop("__manifest", "__seq")


def manifest_totals(refs: DataFrame) -> DataFrame:
    """Of each manifest: chunks, bytes, new chunks and their bytes, and the share that was saved."""
    new = _firsts(refs).groupBy("manifest").agg(F.count("*").alias("new_chunks"), F.sum("length").alias("new_bytes"))
    g = refs.groupBy("manifest").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes")).join(new, "manifest", "left")
    g = g.select("manifest", "chunks", "bytes", F.coalesce("new_chunks", F.lit(0)).alias("new_chunks"), F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"))
    return g.withColumn("dedup_ratio", F.round(F.when(F.col("bytes") > 0, 1 - F.col("new_bytes") / F.col("bytes")).otherwise(0.0), 6))


def references(refs: DataFrame) -> DataFrame:
    return refs.groupBy("hash").agg(F.count("*").alias("refs"), F.countDistinct("manifest").alias("manifests"))


def orphans(store: DataFrame, refs: DataFrame) -> DataFrame:
    return store.join(refs.select("hash"), "hash", "left_anti")


def garbage(store: DataFrame, refs: DataFrame) -> DataFrame:
    """What collecting unreferenced chunks frees."""
    return orphans(store, refs).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("stored"), F.lit(0)).alias("freed"))


def verify(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Each hash once for each manifest: missing, of another length, or ok."""
    each = refs.select("manifest", "hash", "length").dropDuplicates(["manifest", "hash"])
    found = each.join(store.select("hash", F.col("length").alias("stored_length")), "hash", "left")
    state = F.when(F.col("stored_length").isNull(), "missing").when(F.col("stored_length") != F.col("length"), "size_mismatch").otherwise("ok")
    return found.select("manifest", "hash", state.alias("state"))


def index_stats(store: DataFrame) -> DataFrame:
    """Chunks, bytes, stored bytes, and what is saved."""
    g = store.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.sum("stored").alias("stored"))
    return g.withColumn("ratio", F.round(1 - F.col("stored") / F.col("bytes"), 6)).withColumn("saved", F.col("bytes") - F.col("stored"))


def database_stats(refs: DataFrame) -> DataFrame:
    """References by database, a blank name counted as _default."""
    name = F.coalesce(F.nullif(F.trim("database"), F.lit("")), F.lit("_default"))
    per = refs.groupBy(name.alias("database"), "hash").agg(F.count("*").alias("n"), F.max("length").alias("length"), F.sum("length").alias("bytes"))
    g = per.groupBy("database").agg(F.sum("n").alias("refs"), F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum("length").alias("unique_bytes"))
    return g.withColumn("dedup_ratio", F.round(F.when(F.col("bytes") > 0, 1 - F.col("unique_bytes") / F.col("bytes")).otherwise(0.0), 6))


def split_layout(blobs: DataFrame, streams: int, id: str = "blob_id", data: str = "data") -> DataFrame:
    """Each row's stream and its offset there, by row id."""
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    placed = blobs.select(F.col(id), F.pmod(F.col(id), F.lit(streams)).cast("int").alias("stream"), size.alias("size"))
    return running(placed, ["stream"], F.floor(F.col(id) / 4096), [id], F.col("size"), "offset")
