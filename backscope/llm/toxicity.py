"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words, told apart by the letters they hold (Latin letters lower-cased, marks at their ends dropped), and by
their first six bytes. In a bounded sample of labelled training rows, words and beginnings that stand in toxic documents
far more often than chance allows are labelled as toxic tokens; a chain with two states is fitted to these labels, by word,
beginning and shape. Over whole texts, line by line, the forward-backward recursion gives each token's marginal; a
document's score is a logistic function of the chance that any token is toxic and of how many are expected to be, fitted
to the sample's document labels.

A null or empty text has no toxic token and gets the score of such texts. Without labelled rows, or with one label only,
the score is the rate of that label (0 without any) and nothing is tagged. Repeated rows are scored, each on its own; a
label that appears twice for an id counts twice. A row without id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mixed, powers, slices, strings

#: The sample's rows, the longest text in it (longer ones are left out of the sample, and scored whole like all others).
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 40_000
#: What a word's association with toxic documents must exceed (likelihood ratio), and in how many documents words must be.
EVIDENCE, LEAST_DOCS, MOST_WORDS = 15.0, 2, 400_000
#: Marginals below this don't add to a document's chance.
FLOOR = 0.02
_RANDOM = np.random.default_rng(4242).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RANDOM[~LETTER] = 0
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of a word's beginning.
BEGIN = 6


def small(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the accented capitals of Latin-1 lower-cased."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]] += 32
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes (two rows: words and their beginnings, 0 for none), shapes, and numbers of the lines (across texts) of the tokens of texts."""
    at = at - at[0]
    n = int(at[-1])
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros((2, 0), np.uint64), none, none
    solid, cut = ~SPACE[data], np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(solid & (cut[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (cut[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[small(data)] * power, out=total[1:])
    letters = np.flatnonzero(LETTER[data])
    count = np.zeros(n + 1, np.int32)
    np.cumsum(LETTER[data], out=count[1:])
    first = letters[np.minimum(count[starts], max(len(letters) - 1, 0))] if len(letters) else starts
    held = count[ends] - count[starts]
    hashes = np.where(held > 0, mixed((total[ends] - total[starts]) * inverse[first] + held.astype(np.uint64)), np.uint64(0))
    long = (held > BEGIN) & (first + BEGIN <= ends)
    begin = np.where(long, mixed((total[np.minimum(first + BEGIN, n)] - total[first]) * inverse[first] + np.uint64(1 << 40)), np.uint64(0))
    hashes = np.stack((hashes, begin))
    upper = np.zeros(n + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    loud = upper[ends] - upper[starts]
    shapes = (held > 0) * (1 + 2 * ((loud > 1) & (loud == held)) + (held < ends - starts))
    breaks = (data == 10) | cut[:-1]
    return starts, ends, hashes, shapes.astype(np.int64), np.cumsum(breaks)[starts]


def chains(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's tokens start, and how many they are, longest first."""
    first = np.flatnonzero(np.diff(lines, prepend=-1))
    size = np.diff(np.append(first, len(lines)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def marginals(odds: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Each token's chance to be toxic, the log of the sum over all labellings, and (if asked) expected transitions.

    odds: a toxic label's log weight at each token (the other's is 0). step: log weights of transitions.
    """
    n = len(odds)
    weight, move = np.exp(odds), np.exp(step)
    ahead, norm, back = np.empty((n, 2)), np.empty(n), np.empty((n, 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # lines longer than t
    state = None
    for t in range(longest):
        m = active[t]
        at = first[:m] + t
        base = np.ones((m, 2)) * 0.5 if t == 0 else state[:m] @ move
        base[:, 1] *= weight[at]
        total = base.sum(1)
        state = base / total[:, None]
        ahead[at], norm[at] = state, total
    toward = None
    moved = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        now = np.ones((m, 2))
        if t + 1 < longest and active[t + 1]:
            k = active[t + 1]
            nxt = first[:k] + t + 1
            seen = toward[:k].copy()
            seen[:, 1] *= weight[nxt]
            if pairs:
                moved += np.einsum("ni,ij,nj->ij", ahead[first[:k] + t], move, seen / norm[nxt][:, None])
            now[:k] = seen @ move.T / norm[nxt][:, None]
        back[at] = toward = now
    return ahead[:, 1] * back[:, 1], float(np.log(norm).sum()) if n else 0.0, moved


@dataclass(frozen=True)
class Model:
    """Hashes and weights of words and beginnings, weights of shapes, transitions, and the document's logistic function."""

    words: np.ndarray
    weights: np.ndarray
    shapes: np.ndarray
    step: np.ndarray
    logistic: np.ndarray

    def odds(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = self.shapes[shapes]
        for row in hashes:
            at = np.minimum(np.searchsorted(self.words, row), len(self.words) - 1)
            out = out + np.where(self.words[at] == row, self.weights[at], 0.0)
        return out

    def chances(self, hashes: np.ndarray, shapes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(shapes))
        return marginals(self.odds(hashes, shapes), self.step, *chains(lines))[0]

    def scores(self, chance: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence(chance, text, n) @ self.logistic)))


def evidence(chance: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text: the log odds that any token is toxic (within those of 1 in 1000 and its contrary), the logarithm of 1 and the expected number, and 1. Marginals below the floor count as none."""
    use = chance >= FLOOR
    miss = np.clip(np.bincount(text[use], np.log1p(-np.minimum(chance[use], 1 - 1e-9)), n), -7, -1e-3)
    many = np.log1p(np.bincount(text[use], chance[use], n))
    return np.stack((np.log(-np.expm1(miss)) - miss, many, np.ones(n)), axis=1)


def lexicon(hashes: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample's words in enough documents, and which of them belong to toxic documents beyond chance."""
    order = np.lexsort((text, hashes))
    h, t = hashes[order], text[order]
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, bool)
    h, t = h[keep], t[keep]
    words, local, docs = np.unique(h, return_inverse=True, return_counts=True)
    bad = np.bincount(local, toxic[t], len(words))
    n, m = len(toxic), toxic.sum()
    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    ratio = 2 * (term(bad, docs * m / n) + term(docs - bad, docs * (n - m) / n) + term(m - bad, (n - docs) * m / n) + term(n - m - docs + bad, (n - docs) * (n - m) / n))
    use = (docs >= LEAST_DOCS) & (words != 0)
    if use.sum() > MOST_WORDS:
        use &= docs >= np.sort(docs[use])[-MOST_WORDS]
    mostly = bad / np.maximum(docs, 1) >= 0.5
    return words[use], ((ratio > EVIDENCE) & mostly & (bad > docs * m / n))[use]


def fitted(texts: list[str], toxic: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> Model:
    """A model of labelled texts: limited-memory quasi-Newton ascent on the penalised likelihood."""
    nothing = np.zeros(0)
    if not len(texts) or toxic.min() == toxic.max():
        rate = float(toxic.mean()) if len(texts) else 0.0
        return Model(nothing.astype(np.uint64), nothing, np.zeros(5), np.zeros((2, 2)), np.array([0.0, 0.0, 30.0 if rate else -30.0]))
    data, at = strings(pa.array(texts, pa.large_string()))
    parts = [(*tokens(data[at[i] : at[j]], at[i : j + 1]), i, j) for i, j in slices(at, 1 << 20)]
    hashes, shapes = np.concatenate([p[2] for p in parts], axis=1), np.concatenate([p[3] for p in parts])
    text = np.concatenate([np.searchsorted(at[p[5] : p[6] + 1] - at[p[5]], p[0], "right") - 1 + p[5] for p in parts])
    lines = np.cumsum(np.concatenate([np.concatenate(([1], np.diff(p[4]) > 0)) if len(p[4]) else p[4] for p in parts]).astype(np.int64))
    found = [lexicon(row, text, toxic.astype(float)) for row in hashes]
    words, bad = np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])
    order = np.argsort(words)
    words, bad = words[order], bad[order]
    place = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
    known = words[place] == hashes if len(words) else np.zeros(hashes.shape, bool)
    label = (known & bad[place]).any(0) & (toxic[text] > 0) if len(words) else known.any(0)
    first, size = chains(lines)
    nw = len(words)
    gold_w = sum(np.bincount(place[r][known[r] & label], minlength=max(nw, 1))[:nw] for r in (0, 1))
    gold_s = np.bincount(shapes[label], minlength=5)
    same = np.diff(lines, prepend=-1) == 0
    pair = np.zeros((2, 2))
    np.add.at(pair, (label[:-1][same[1:]].astype(int), label[1:][same[1:]].astype(int)), 1)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        odds = x[nw + shapes] + sum(np.where(known[r], x[place[r]], 0.0) for r in (0, 1))
        step = np.array([[0.0, x[-3]], [x[-2], x[-1]]])
        p, total, moved = marginals(odds, step, first, size, True)
        gain = float(odds[label].sum() + (pair * step).sum())
        slope_w = sum(np.bincount(place[r][known[r]], p[known[r]], max(nw, 1))[:nw] for r in (0, 1)) - gold_w
        g = np.concatenate((slope_w, np.bincount(shapes, p, 5) - gold_s, (moved - pair)[[0, 1, 1], [1, 0, 1]]))
        return total - gain + ridge / 2 * float(x @ x), g + ridge * x

    x = np.concatenate((np.zeros(nw), np.full(5, -4.0), np.zeros(3)))
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, a = g.copy(), []
        for s, y in reversed(past):
            a.append(float(s @ d) / float(s @ y))
            d -= a[-1] * y
        d *= float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).max()))
        for (s, y), b in zip(past, reversed(a), strict=True):
            d += s * (b - float(y @ d) / float(s @ y))
        rate = 1.0
        while rate > 1e-4:
            new, slope = loss(x - rate * d)
            if new < value - 1e-4 * rate * float(g @ d):
                break
            rate /= 3
        else:
            break
        s, y = -rate * d, slope - g
        x, g, gained, value = x - rate * d, slope, value - new, new
        if float(s @ y) > 1e-10:
            past = [*past[-6:], (s, y)]
        if gained < 1e-5 * abs(value):
            break
    model = Model(words, x[:nw], x[nw : nw + 5], np.array([[0.0, x[-3]], [x[-2], x[-1]]]), np.zeros(3))
    seen = evidence(model.chances(hashes, shapes, lines), text, len(texts))
    at = np.array([1.0, 0.0, 0.0])
    for _ in range(60):  # Newton steps on the document's parameters, lightly penalised
        p = 1 / (1 + np.exp(-(seen @ at)))
        slope = seen.T @ (p - toxic) + 0.02 * (at - [1, 0, 0])
        at = at - np.clip(np.linalg.solve((seen * (p * (1 - p))[:, None]).T @ seen + 0.02 * np.eye(3), slope), -1, 1)
    return Model(model.words, model.weights, model.shapes, model.step, at)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        data, at = strings(column)
        for i, j in slices(at, 1 << 21):
            part = at[i : j + 1]
            here = data[part[0] : part[-1]]
            starts, ends, hashes, shapes, lines = tokens(here, part)
            text = np.searchsorted(part - part[0], starts, "right") - 1
            chance = model.chances(hashes, shapes, lines)
            score = model.scores(chance, text, j - i)
            spans: list[list[dict]] = [[] for _ in range(j - i)]
            # code points before each byte
            points = np.concatenate(([0], np.cumsum((here & 0xC0) != 0x80)))
            for k in np.flatnonzero(chance >= 0.5).tolist():
                low = points[part[text[k]] - part[0]]
                spans[int(text[k])].append({"start": int(points[starts[k]] - low), "end": int(points[ends[k]] - low), "chance": float(chance[k])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], [*batch.schema.names[:-1], "score", "predicted", "spans"])


SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint, chance: double>>"


def held(id: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of at most `rows` labelled rows outside the held-out fold, those whose ids' digests come first, of at most `chars` characters each, also where ids repeat. Of more than MOST_WORDS words the most frequent are learnt."""
    told = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label is not null").where(~held(F.col("id")))
    chosen = told.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id", "label").limit(rows)
    texts = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.length("text") <= chars)
    # the ids are at most `rows`
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id", "label", "text").limit(rows).collect()
    found.sort(key=lambda r: (r["id"], r["label"], r["text"]))
    return fitted([r["text"] for r in found], np.array([float(r["label"] > 0) for r in found]))


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans: start, end (code points, exclusive) and chance of the tokens tagged as toxic."""
    source = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), held(F.col(f"`{id}`")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(partial(_score, model=model), SCORED)
