"""What several training-data operators share: scratch tables, words and shingles as 64-bit hashes, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: 20 and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder. Where none is set (tests on one machine), under the machine's own temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: cuts its lineage, and lets a skewed join that reads it be split. Executors may be lost afterwards."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def done(*tables: DataFrame) -> None:
    """Remove tables that keep() has written and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def grouped(rows: Iterator[dict[str, np.ndarray]], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows, as columns of arrays, in one run for each value of the key. A run is held at once."""
    held: list[dict[str, np.ndarray]] = []
    for x in rows:
        k = x[key]
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[0][key][0] != k[0]:
            yield {c: np.concatenate([h[c] for h in held]) for c in x}
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            run = {c: y[a:b] for c, y in x.items()}
            if b == len(k):
                held.append(run)
            elif held:
                yield {c: np.concatenate([h[c] for h in [*held, run]]) for c in x}
                held = []
            else:
                yield run
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def needed(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value starts (one more than values). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of values of at most that many bytes together, or of one longer value."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes (A-Z lower-cased) of the words of the texts data[at[i]:at[i+1]], and each text's first word (one more than texts)."""
    at = at - at[0]
    n = int(at[-1])
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(solid & (cut[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (cut[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of runs of that many words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, width)
    seeds = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * seeds[i]
    return np.unique(mixed(total))


def shingle_sets(column: pa.Array, width: int, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, whole texts in runs of about that many bytes."""
    data, at = strings(column)
    for i, j in slices(at, most):
        part = at[i : j + 1]
        _, _, hashes, first = words(data[part[0] : part[-1]], part)
        for k in range(j - i):
            yield shingles(hashes[first[k] : first[k + 1]], width)


def set_key(values: np.ndarray) -> int:
    """64 bits of a sorted set's BLAKE2, signed: equal sets share it."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


#: Edges, a few MB, that one task may hold.
ONE_TASK = 100_000


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph: (v, label)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    told = [(v, r) for v in parent if (r := root(v)) != v]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in told], pa.int64()) for k in (0, 1)], ["v", "label"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, label): for each vertex of the edges (a, b) that isn't the smallest of its component, that smallest vertex.

    Rounds of hooking each vertex to its smallest neighbour and doubling pointers, each round a written table; their
    number grows with the logarithm of the longest chain. Sums are taken before the shuffle, and the joins read written
    tables, so that a vertex with very many neighbours can be split. As soon as no more than ONE_TASK edges are left, one
    task ends it. No edges give no rows.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("open")).distinct(), name)
    while True:
        if e.count() <= ONE_TASK:
            return keep(e.select("a", "b").repartition(1).mapInArrow(_spanned, "v long, label long"), name)
        p = keep(e.groupBy("a").agg(F.min("b").alias("p")), name)
        rest = e.select("a", "b").join(p, "a").where("b <> p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(True).alias("open"))
        up = p.select(F.col("a").alias("p"), F.col("p").alias("above"))
        tree = p.join(up, "p", "left").select("a", F.coalesce("above", "p").alias("b"), F.col("above").isNotNull().alias("open"))
        e = keep(rest.unionByName(tree).groupBy("a", "b").agg(F.max("open").alias("open")), name)
        if not e.where("open").take(1):
            return p.select(F.col("a").alias("v"), F.col("p").alias("label"))
