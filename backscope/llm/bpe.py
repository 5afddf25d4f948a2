"""Byte-level BPE by a pair occurrence index.

Within a run of texts, each distinct piece of the pre-tokenizer is merged once. All pieces lie in one symbol sequence; an
index maps the rank of each adjacent pair to all positions where it stands. The lowest active rank is applied at all its
positions at once, and only the pairs beside them enter or leave the index. Memory follows the run, not the partition.

Null and empty texts give no ids and decode to the empty text. The special token's own string in a text is one id.
Repeated rows give repeated results. Other columns of the input don't appear unless named in `ids`.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer's pattern, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces that a run keeps before it starts anew, characters and rows that a run takes at a time.
MOST_PIECES, RUN_CHARS, RUN_ROWS = 300_000, 12_000_000, 4_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in such vocabularies: itself where it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, ids and bytes of a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, text: str) -> None:
        read = json.loads(text)
        ids, merges = read["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        characters = byte_characters()
        self.byte_id = np.array([ids[c] for c in characters], np.int32)
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        pairs = self.left << 32 | self.right
        self.rank_of = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.rank_of]
        byte_of = {c: b for b, c in enumerate(characters)}
        size = max([*ids.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for piece, i in ids.items():
            raw[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.special.items():
            raw[i] = piece.encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces_of = regex.compile(PATTERN).findall

    def pieces(self, text: str) -> list[str]:
        """What the pre-tokenizer makes of a text; special tokens stand alone."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pieces_of(text)
        return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else self.pieces_of(part))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it never merges."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank_of[at], -1)

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n, end = len(symbol), np.cumsum(size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[end - 1] = -1
        before[end - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index the pairs that start at these positions."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            firsts = rank[cuts[:-1]].tolist()
            for k, r in enumerate(firsts):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[cuts[k] : cuts[k + 1]])

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.unique(found[0])
            a, b = self.left[r], self.right[r]
            follows = after[at]
            at = at[(symbol[at] == a) & (follows >= 0) & (symbol[follows] == b)]
            if a == b and len(at) > 1:
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.made[r], -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            enter(np.unique(np.concatenate((ahead[ahead >= 0], at[beyond >= 0]))))
        alive = symbol >= 0
        count = np.concatenate(([0], np.cumsum(alive)))
        return symbol[alive].astype(np.uint32), count[end] - count[end - size]

    def text(self, ids: np.ndarray) -> str:
        """What the ids decode to; bytes that aren't UTF-8 become U+FFFD."""
        return gathered(self.raw, self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids]).tobytes().decode(errors="replace")


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i]:start[i]+size[i]] of all i, one after another."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return values[:0]
    return values[np.repeat(start - (total - size), size) + np.arange(total[-1])]


class Encoder:
    """Encodes run after run, and remembers the pieces met so far, a bounded number."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's start (one more than texts)."""
        if len(self.known) > MOST_PIECES:
            self.reset()
        v, old = self.vocabulary, len(self.known)
        met = [np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)) for found in map(v.pieces, texts)]
        if len(self.known) > old:
            new = list(self.known)[old:]
            ids, size = v.merged([p for p in new if p not in v.special]) if any(p not in v.special for p in new) else (self.ids[:0], self.size[:0])
            for k, p in enumerate(new):
                if p in v.special:
                    place = int(size[:k].sum())
                    ids, size = np.insert(ids, place, v.special[p]), np.insert(size, k, 1)
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        pieces = np.concatenate(met) if met else np.zeros(0, np.int32)
        size = self.size[pieces]
        ends = np.concatenate(([0], np.cumsum(size)))
        return gathered(self.ids, self.start[pieces], size), ends[np.concatenate(([0], np.cumsum([len(m) for m in met], dtype=np.int64)))]


@lru_cache(2)
def vocabulary_of(text: str) -> Vocabulary:
    return Vocabulary(text)


def runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each run of texts starts, and its texts."""
    for first in range(0, len(column), RUN_ROWS):
        texts = [x or "" for x in column.slice(first, RUN_ROWS).to_pylist()]
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= RUN_CHARS):
                chars += len(texts[j])
                j += 1
            yield first + i, texts[i:j]
            i = j


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, text: str, decode: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary_of(vocabulary))
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        rest = batch.drop_columns([text])
        for first, texts in runs(column):
            ids, at = encoder.run(texts)
            each = [ids[at[k] : at[k + 1]] for k in range(len(texts))]
            out = [*rest.slice(first, len(texts)).columns, pa.array(np.diff(at)), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]
            names = [*rest.schema.names, "n_tokens", "token_ids"]
            if decode:
                out.append(pa.array([encoder.vocabulary.text(x) for x in each], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The columns `ids`, n_tokens long, token_ids binary (unsigned 32-bit integers, little-endian), and if asked decoded string.

    vocabulary: the path of a tokenizers JSON file, read by the driver and sent along (a few MB).
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    source = df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode)
    return source.mapInArrow(partial(_encode, vocabulary=content, text="__text", decode=decode), schema)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary_of(vocabulary)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        texts = [v.text(np.frombuffer(x or b"", "<u4")) for x in column.to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])


def decode(df: DataFrame, vocabulary: str, token_ids: str = "token_ids", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `ids` and decoded string, of what encode() gave. Null ids decode to the empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    source = df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{token_ids}`").alias("__ids"))
    return source.mapInArrow(partial(_decode, vocabulary=content), T.StructType([*source.drop("__ids").schema.fields, T.StructField("decoded", T.StringType())]))
