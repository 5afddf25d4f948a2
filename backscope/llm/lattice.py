"""Language-model scores by subword lattices.

The pieces of an existing byte-level vocabulary weight all ways to write a word: its probability is the sum over all
segmentations of the product of piece probabilities, by a forward recursion in log space. A text is its words, each with a
space before it, and an end; no piece holds a space after its first byte, so that the lattice of the text falls apart into
those of its words and its marginal is their product with the end's. Piece probabilities start from the vocabulary's order
(Zipf) and are fitted by expectation maximisation to all training words; with the end's they sum to 1.

Words are told apart by 64-bit hashes. Texts are read once, into shards of some MB with a vocabulary of their own; each
shard's words go to buckets, where they meet their counts over the whole corpus, and the answers return to their shards.
No table of all words ever reaches one task or the driver. Where there are many shards, a bucket's rows meet in salted
groups of shards first, each group's words once with their sums, and answers return by the same groups.

A null or empty text is the end alone. A null id counts as the empty text where the fold is taken. Repeated rows are
scored, and counted, each on its own. An empty table gives an empty result; without training rows all counts are 0.
"""

from __future__ import annotations

import base64
import copy
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import LOWER, keep, mixed, slices, strings, words

#: Bytes of text in a shard, bytes of text for a bucket, rounds of fitting, and what is added to each expected count.
SHARD_BYTES, BUCKET_BYTES, ROUNDS, ADDED = 12 << 20, 16 << 20, 4, 0.1
#: Shards, about, of which a bucket takes rows in one group.
SALTED = 4096
#: Words longer than this are done one by one.
LONG = 40
_RANDOM = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA0761D6478BD642F)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Pieces:
    """A vocabulary's pieces by the hash of their bytes, and natural logarithms of their probabilities."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw
        # a piece with a space, or an upper-case letter, after its first byte can't be part of a lower-cased word
        self.longest = max((len(p) for p in raw if b" " not in p[1:] and p.translate(bytes(LOWER)) == p), default=1)
        self.power, self.inverse = _powers(max(self.longest, LONG) + 2)
        self.shift, m = np.uint64(44), 1 << 20
        self.keys, self.ids = np.zeros(m + 64, np.uint64), np.full(m + 64, -1, np.int32)
        for i, h in enumerate(self.hashes(raw).tolist()):
            slot = h >> 44
            while self.keys[slot]:
                slot += 1
            self.keys[slot], self.ids[slot] = h, i
        self.scores = -np.log(np.arange(1, len(raw) + 1)) - math.log(sum(1 / k for k in range(1, len(raw) + 2)))

    def scored(self, scores: np.ndarray | None) -> Pieces:
        """The same pieces with other probabilities."""
        out = copy.copy(self)
        out.scores = self.scores if scores is None else scores
        return out

    @staticmethod
    def hashes(raw: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in raw])
        end = np.cumsum(size)
        place = np.arange(end[-1]) - np.repeat(end - size, size)
        weighed = _RANDOM[np.frombuffer(b"".join(raw), np.uint8)] * _powers(int(size.max()))[0][place]
        return mixed(np.add.reduceat(weighed, end - size) + size.astype(np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where there is no such piece."""
        slot = (hashes >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.ids[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] += 1
            key = self.keys[slot[left]]
            out[left] = np.where(key == hashes[left], self.ids[slot[left]], -1)
            left = left[(key != hashes[left]) & (key != 0)]
        return out

    def arcs(self, letters: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, piece ids) for words of one length, given as rows of bytes."""
        n, size = letters.shape
        total = np.zeros((n, size + 1), np.uint64)
        np.cumsum(_RANDOM[letters] * self.power[:size], axis=1, out=total[:, 1:])
        return [(i, j, self.find(mixed((total[:, j] - total[:, i]) * self.inverse[i] + np.uint64(j - i)))) for j in range(1, size + 1) for i in range(max(0, j - self.longest), j)]

    def forward(self, letters: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """The log probabilities of all prefixes."""
        padded = np.append(self.scores, -np.inf)
        out = np.full((letters.shape[1] + 1, len(letters)), -np.inf)
        out[0] = 0
        for i, j, ids in arcs if arcs is not None else self.arcs(letters):
            out[j] = np.logaddexp(out[j], out[i] + padded[ids])
        return out

    def expected(self, letters: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add how often each piece is expected in these words."""
        arcs, padded = self.arcs(letters), np.append(self.scores, -np.inf)
        ahead = self.forward(letters, arcs)
        back = np.full_like(ahead, -np.inf)
        back[-1] = 0
        for i, j, ids in sorted(arcs, key=lambda x: -x[1]):
            step = padded[ids]
            back_j = back[j]
            share = np.exp(ahead[i] + step + back_j - ahead[-1])
            hit = ids >= 0
            into += np.bincount(ids[hit], (share * weight)[hit], len(into))
            back[i] = np.logaddexp(back[i], step + back_j)

    def long_forward(self, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """One word: the log probabilities of its prefixes, and the pieces that end at each place, by length."""
        n = len(word)
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(self.longest, np.uint64), _RANDOM[word])), self.longest)[1 : n + 1]
        out, ends, padded = np.full(n + 1, -np.inf), [], np.append(self.scores, -np.inf)
        out[0] = 0
        for j in range(1, n + 1):
            m = min(j, self.longest)
            # sum of the last k bytes' values, each times the power of its place among them
            tail = wide[j - 1][self.longest - m :]
            total = np.zeros(m + 1, np.uint64)
            np.cumsum(tail * self.power[:m], out=total[1:])
            starts = np.arange(m)
            ids = self.find(mixed((total[m] - total[starts]) * self.inverse[starts] + (m - starts).astype(np.uint64)))
            ends.append(ids)
            out[j] = np.logaddexp.reduce(out[j - m : j] + padded[ids])
        return out, ends

    def long_expected(self, word: np.ndarray, weight: float, into: np.ndarray) -> None:
        ahead, ends = self.long_forward(word)
        n, padded = len(word), np.append(self.scores, -np.inf)
        back = np.full(n + 1, -np.inf)
        back[n] = 0
        for j in range(n, 0, -1):
            ids = ends[j - 1]
            here = slice(j - len(ids), j)
            share = np.exp(ahead[here] + padded[ids] + back[j] - ahead[n])
            hit = ids >= 0
            np.add.at(into, ids[hit], share[hit] * weight)
            back[here] = np.logaddexp(back[here], padded[ids] + back[j])


def by_length(data: np.ndarray, size: np.ndarray, rows: int = 8_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length, at most so many: which they are, and their bytes with a space before each."""
    start = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        n = int(size[order[a]])
        if n > LONG:
            continue
        for k in range(a, b, rows):
            which = order[k : min(b, k + rows)]
            letters = np.full((len(which), n + 1), 32, np.uint8)
            letters[:, 1:] = data[start[which][:, None] + np.arange(n)]
            yield which, letters


def word_logs(pieces: Pieces, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The log probability of each word."""
    out = np.zeros(len(size))
    for which, letters in by_length(data, size):
        out[which] = pieces.forward(letters)[-1]
    start = np.cumsum(size) - size
    for k in np.flatnonzero(size > LONG):
        out[k] = pieces.long_forward(np.append(np.uint8(32), data[start[k] : start[k] + size[k]]))[0][-1]
    return out


def word_counts(pieces: Pieces, data: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each as often as its weight."""
    out = np.zeros(len(pieces.raw))
    for which, letters in by_length(data, size):
        pieces.expected(letters, weight[which], out)
    start = np.cumsum(size) - size
    for k in np.flatnonzero(size > LONG):
        pieces.long_expected(np.append(np.uint8(32), data[start[k] : start[k] + size[k]]), float(weight[k]), out)
    return out


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as many bytes of 7 bits as it needs, high ones first, of which all but the last have the high bit."""
    values = values.astype(np.int64, copy=False)
    n, most = np.ones(len(values), np.int64), int(values.max()) if len(values) else 0
    for k in range(7, most.bit_length(), 7):
        n += values >= 1 << k
    end = np.cumsum(n)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = values & 127
    for k in range(1, int(n.max()) if len(n) else 0):
        more = n > k
        out[end[more] - 1 - k] = values[more] >> 7 * k & 127 | 128
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(x < 128)
    n = np.diff(end, prepend=-1)
    y = (x & 127).astype(np.int64)
    out = y[end]
    for k in range(1, int(n.max()) if len(n) else 0):
        more = n > k
        out[more] += y[end[more] - k] << 7 * k
    return out


SHARDS = "shard long, doc_id long, held_out boolean, n_words long, tokens binary, bucket long, hashes binary, places binary, counts binary, sizes binary, letters binary"


def _shards(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents, their words as places in the shard's vocabulary, and rows of that vocabulary by bucket."""
    number = TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in SHARDS.split(", ")]
    for batch in batches:
        ids, held = batch.column(0), np.array(batch.column(1).to_pylist(), bool)
        data, at = strings(batch.column(2))
        for i, j in slices(at, SHARD_BYTES):
            base, each, first, places = at[i], [], [0], []
            for a, b in slices(at[i : j + 1], 1 << 20):
                part = at[i + a : i + b + 1]
                starts, ends, hashes, docs = words(data[part[0] : part[-1]], part)
                places.append(np.stack((starts + part[0] - base, ends - starts)))
                each.append(hashes)
                first += (docs[1:] + first[-1]).tolist()
            hashes, (starts, sizes) = np.concatenate(each), np.concatenate(places, axis=1)
            first = np.array(first)
            train = np.repeat(~held[i:j], np.diff(first))
            known, one, local, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            # frequent words get short places
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            local = place[local]
            trained = np.bincount(local[train], minlength=len(order))
            known, one = known[order], one[order]
            rows: list[tuple] = [(number, d, bool(h), int(first[k + 1] - first[k]), packed(local[first[k] : first[k + 1]]), *[None] * 6) for k, (d, h) in enumerate(zip(ids.slice(i, j - i).to_pylist(), held[i:j], strict=True))]
            where = (known % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(where, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1) if len(by) else []:
                letters = LOWER[gathered(data[base : at[j]], starts[one[part]], sizes[one[part]])]
                rows.append((number, None, None, None, None, int(where[part[0]]), known[part].tobytes(), part.astype(np.int32).tobytes(), trained[part].astype(np.int64).tobytes(), sizes[one[part]].astype(np.int32).tobytes(), letters.tobytes()))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            number += 1


@lru_cache(1)
def vocabulary_of(content: bytes) -> Pieces:
    return Pieces([base64.b64decode(line.split()[0]) for line in content.splitlines()])


def pieces_of(content: bytes, scores: bytes | None) -> Pieces:
    return vocabulary_of(content).scored(None if scores is None else np.frombuffer(scores))


BUCKETS = "bucket long, salt long, hashes binary, distinct long, counts binary, sizes binary, letters binary, shards array<long>, places array<binary>, locals array<binary>"
#: Words that are done at once, where rows hold fewer.
TOGETHER = 100_000


def _bucketed(table: pa.Table) -> pa.Table:
    """A bucket's words, each once with its training count over these rows, and for each shard (or group of shards) that has some which they are."""
    shard, hashes, places, counts, sizes, letters = (table.column(c).to_pylist() for c in ("shard", "hashes", "places", "counts", "sizes", "letters"))
    known, one, local = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hashes]), return_index=True, return_inverse=True)
    count = np.bincount(local, np.concatenate([np.frombuffer(x, np.int64) for x in counts])).astype(np.int64)
    size = np.concatenate([np.frombuffer(x, np.int32) for x in sizes]).astype(np.int64)
    words_of = gathered(np.frombuffer(b"".join(letters), np.uint8), (np.cumsum(size) - size)[one], size[one])
    cut = np.cumsum([0, *(len(x) // 8 for x in hashes)])
    locals_of = [local[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(len(shard))]
    row = (table.column("bucket")[0].as_py(), table.column("salt")[0].as_py(), known.tobytes(), int((count > 0).sum()), count.tobytes(), size[one].astype(np.int32).tobytes(), words_of.tobytes(), shard, places, locals_of)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.table({x.split()[0]: pa.array([c], t) for x, c, t in zip(BUCKETS.split(", "), row, kinds, strict=True)})


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of buckets, as many as hold enough words."""
    rows, n = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            rows += batch.slice(k, 1).to_pylist()
            n += len(rows[-1]["sizes"]) // 4
            if n >= TOGETHER:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def _words(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts, sizes = (np.concatenate([np.frombuffer(r[c], t) for r in rows]).astype(np.int64) for c, t in (("counts", np.int64), ("sizes", np.int32)))
    return counts, sizes, np.frombuffer(b"".join(r["letters"] for r in rows), np.uint8)


def _expect(batches: Iterator[pa.RecordBatch], content: bytes, scores: bytes | None) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(content, scores)
    total = np.zeros(len(pieces.raw))
    for rows in _several(batches):
        weight, size, data = _words(rows)
        use = weight > 0
        start = np.cumsum(size) - size
        total += word_counts(pieces, gathered(data, start[use], size[use]), size[use], weight[use])
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["piece", "expected"])


def _told(batches: Iterator[pa.RecordBatch], content: bytes, scores: bytes | None) -> Iterator[pa.RecordBatch]:
    """For each shard (or group of shards) what its words in a bucket count and weigh."""
    pieces = pieces_of(content, scores)
    for rows in _several(batches):
        counts, size, data = _words(rows)
        logs = word_logs(pieces, data, size)
        first = 0
        for row in rows:
            n = len(row["sizes"]) // 4
            here, weigh = counts[first : first + n], logs[first : first + n]
            first += n
            back = [np.frombuffer(x, np.int32) for x in row["locals"]]
            yield _answers([row["bucket"]] * len(back), row["shards"], row["places"], [here[b].tobytes() for b in back], [weigh[b].tobytes() for b in back])


ANSWERS = "bucket long, shard long, places binary, counts binary, logs binary"


def _answers(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], [x.split()[0] for x in ANSWERS.split(", ")])


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a group of shards was told, for each of its shards."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            back, count, logs = [np.frombuffer(x, np.int32) for x in row["locals"]], np.frombuffer(row["counts"], np.int64), np.frombuffer(row["logs"])
            yield _answers([row["bucket"]] * len(back), row["shards"], row["places"], [count[b].tobytes() for b in back], [logs[b].tobytes() for b in back])


def _score(docs: pa.Table, found: pa.Table, docs_trained: int, train_tokens: int, distinct: int, end_log: float) -> pa.Table:
    """A shard: its documents' sums over what the buckets told of its words."""
    places = [np.frombuffer(x, np.int32) for x in found.column("places").to_pylist()]
    n = sum(map(len, places))
    count, logs = np.zeros(n, np.int64), np.zeros(n)
    for p, c, g in zip(places, found.column("counts").to_pylist(), found.column("logs").to_pylist(), strict=True):
        count[p], logs[p] = np.frombuffer(c, np.int64), np.frombuffer(g)
    plain = np.log10(count + 1.0)
    known, bases, scores, tokens = [], [], [], []
    below = math.log10(train_tokens + distinct + 1)
    for data in docs.column("tokens").to_pylist():
        local = unpacked(data)
        tokens.append(len(local) + 1)
        known.append(int((count[local] > 0).sum()) + (docs_trained > 0))
        bases.append(float(plain[local].sum()) + math.log10(docs_trained + 1) - (len(local) + 1) * below)
        scores.append(float(logs[local].sum() + end_log) / math.log(10))
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([train_tokens] * len(tokens), pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(id: Column, parts: int) -> Column:
    """crc32 of the id as text (null: the empty text), modulo the number of folds."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % parts


def score(df: DataFrame, ranks: str, held_out: Column | None = None, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, salted: int = SALTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    ranks: the path of a rank file (a piece in base64 and its rank a line), read by the driver and sent along.
    held_out: which rows not to learn from, by default those whose fold of 7 is 2. salted: shards, about, in a group.
    """
    with open(ranks, "rb") as f:
        content = f.read()
    held = fold(F.col(f"`{id}`"), 7) == 2 if held_out is None else held_out
    source = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = keep(source.mapInArrow(partial(_shards, buckets=max(32, size // BUCKET_BYTES)), SHARDS), "lm-shards")
    docs = shards.where("tokens is not null").select("shard", "doc_id", "held_out", "n_words", "tokens")
    vocabulary = shards.where("hashes is not null").select("bucket", "shard", "hashes", "places", "counts", "sizes", "letters")
    salts = docs.select("shard").distinct().count() // salted + 1
    grouped = vocabulary.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts))).groupBy("bucket", "salt").applyInArrow(_bucketed, BUCKETS)
    if salts > 1:
        groups = keep(grouped, "lm-groups")
        once = groups.select("bucket", F.col("salt").alias("shard"), "hashes", F.lit(b"").alias("places"), "counts", "sizes", "letters", F.lit(0).cast("long").alias("salt"))
        grouped = once.groupBy("bucket").applyInArrow(_bucketed, BUCKETS)
    buckets = keep(grouped.drop("salt", "hashes"), "lm-buckets")
    trained, tokens = docs.where("not held_out").agg(F.count("*"), F.coalesce(F.sum(F.col("n_words") + 1), F.lit(0))).first()
    scores, end_log = None, 0.0
    for _ in range(rounds):
        # at most one number for each piece of the vocabulary reaches the driver
        told = buckets.select("counts", "sizes", "letters").mapInArrow(partial(_expect, content=content, scores=scores), "piece long, expected double")
        expected = np.full(len(content.splitlines()), ADDED)
        for piece, n in told.groupBy("piece").agg(F.sum("expected")).collect():
            expected[piece] += n
        total = expected.sum() + trained + ADDED
        scores, end_log = np.log(expected / total).tobytes(), math.log((trained + ADDED) / total)
    found = buckets.drop("distinct").mapInArrow(partial(_told, content=content, scores=scores), ANSWERS)
    if salts > 1:
        found = found.select("bucket", F.col("shard").alias("salt"), "counts", "logs").join(groups.select("bucket", "salt", "shards", "places", "locals"), ["bucket", "salt"]).mapInArrow(_passed, ANSWERS)
    found = found.select("shard", "places", "counts", "logs")
    distinct = (buckets.agg(F.sum("distinct")).first()[0] or 0) + (trained > 0)
    return docs.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(lambda a, b: _score(a, b, trained, tokens, distinct, end_log), SCORES)
