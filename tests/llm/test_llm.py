"""The ten operators against plain versions, on small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import base64
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from backscope.llm import bpe, common, covertree, lattice, media, mixing, neardup, quality, queries, secrets, sql, toxicity, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(common.LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def odd_documents(r):
    """Texts that tend to break things: null, empty, blank, repeated, very long, with odd characters; copies and near copies."""
    def vocabulary(n):
        return ["".join(r.choice("abcdefgéß漢") for _ in range(r.randint(1, 8))) for _ in range(n)]

    v = vocabulary(400)
    texts = [None, "", " \t\n", "one", "One", "a b c", "a b c d e f", "x" * 5000, "the " * 6000, None, ""]
    for _ in range(25):
        base = [r.choice(v) for _ in range(r.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(v)
            texts.append((" " if r.random() < 0.5 else "\n").join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "a", None]), None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[3], (None, "no id here at all", "en", "a", 17)]


@pytest.fixture(scope="module")
def rows():
    return odd_documents(random.Random(11))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing names: columns that the operators make themselves
    return spark.createDataFrame(rows, DOCS).withColumn("v", F.lit(1)).withColumn("node", F.lit("x")).withColumn("spans", F.lit(2)).withColumn("size", F.lit(3)).withColumn("__text", F.lit(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles_match_plain_ones(rows):
    column = pa.array([r[1] for r in rows], pa.string())
    data, at = common.strings(column)
    starts, ends, hashes, first = common.words(data, at)
    names = {}
    for i, r in enumerate(rows):
        mine = [data[starts[k] : ends[k]].tobytes().translate(LOWER) for k in range(first[i], first[i + 1])]
        assert mine == words(r[1])
        for w, h in zip(mine, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    for width in (4, 5):
        for r, s in zip(rows, common.shingle_sets(column, width), strict=True):
            assert len(s) == len(shingles(r[1], width))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {x.v: x.label for x in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = groups(600, edges)
    assert got == {i: want[i] for i in range(600) if want[i] != i}
    assert not common.components(spark.createDataFrame([], "a long, b long"), "t").collect()


# 1
def test_quality_keeps_clean_and_rejects_bad(spark, folder):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(d, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in out) / len(out) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "some plain words here", "en", "big", 1) for i in range(200)] + [(900, "some plain words here", "en", "small", 1)]
    labels = [(i, int(i % 10 > 0)) for i in range(200)] + [(900, 0)]
    out = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert abs(out[5].host_share - 0.9) < 0.05 and out[900].host_share > 0.3 and len(out) == 201


def test_quality_odd_input(spark, docs, empty, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).collect() == []


def test_quality_with_columns_that_clash(spark, docs, rows):
    """Given columns come along, whatever their names; those called like a result are the result."""
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    more = docs.withColumns({c: F.lit("x") for c in ("score", "evidence", "path_share", "__host", "marks", "__good")})
    out = quality.classify(more, labels, columns=("text", "score", "evidence", "path_share", "__host", "marks", "__good", "doc_id"))
    assert out.columns == ["doc_id", "text", "__host", "marks", "__good", "evidence", "host_share", "path_share", "score", "kept"]
    plain = quality.classify(docs, labels)
    assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect())) and out.where("marks = 'x'").count() == len(rows)


# 2
@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    got = Counter(map(tuple, neardup.near_duplicates(docs, width).collect()))
    sets = [shingles(r[1], width) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = groups(len(rows), links)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[label[i]].append(r[0])
    want = Counter((r[0], len(s), c := min(low[label[i]], default=None) if s else r[0], r[0] is not None and r[0] == c) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    assert got == want


def test_near_duplicates_of_a_hot_group(spark):
    """A large group of near copies of one text, whose pairs aren't all links, beside strangers that share a passage with it."""
    r = random.Random(9)
    v = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [r.choice(v) for _ in range(100)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            copy[r.randrange(100)] = r.choice(v)
        texts.append(" ".join(copy))
    texts += [" ".join(base[:40] + [r.choice(v) for _ in range(60)]) for _ in range(200)]
    sets = [shingles(t, 4) for t in texts]
    label = groups(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # small nodes of 20 only, so that branching is reached; a task may hold 50 sets, or 2000 shingles, only, so that written levels and blocks are
    for options in ({}, {"small": 20}, {"small": 20, "big": 50}, {"small": 20, "big": 50, "held": 2000}):
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df, 4, **options).collect()}
        assert got == dict(enumerate(label)), options


def test_dense_nodes_give_links_and_no_pairs():
    """600 sets whose sketches are all alike, of which some are links: a node of them gives its sets, and then one link fewer than each component has sets."""
    r = np.random.default_rng(4)
    base = r.integers(-(2**62), 2**62, 60)
    # sorted as the operator sorts them, as numbers without sign
    shared = [np.unique(np.concatenate((base[: 60 - k % 3], r.integers(-(2**62), 2**62, 5 + 4 * (k % 3)))).view(np.uint64)).view(np.int64) for k in range(600)]
    n = len(shared)
    facts = {"node": np.full(n, 3), "label": np.arange(n), "levels": np.full(n, -1, np.int32), "side": np.zeros(n, np.int32), **{c: np.zeros(n, np.int64) for c in neardup.SKETCH}}
    batch = pa.RecordBatch.from_pydict({**facts, "v": np.arange(n), "tokens": pa.array([None] * n, pa.list_(pa.int32()))})
    (out,) = neardup._candidates(iter([batch]), 0.8, 10)
    assert out.column("a").to_pylist() == list(range(n)) and out.column("b").null_count == n and set(out.column("node").to_pylist()) == {3}
    for side in (facts["side"], (np.arange(n) % 2).astype(np.int32)):
        batch = pa.RecordBatch.from_pydict({**facts, "side": side, "v": np.arange(n), "shared": pa.array(shared, pa.list_(pa.int64()))})
        links = [p for b in neardup._joined(iter([batch.slice(0, 250), batch.slice(250)]), 0.8, 80) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        sets = [set(s.tolist()) for s in shared]
        alike = [(i, j) for i, j in itertools.combinations(range(n), 2) if (side is facts["side"] or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert set((b, a) for a, b in links) <= set(alike) and groups(n, links) == groups(n, alike)
        assert len(links) == n - len(set(groups(n, alike)))


def test_blocks_meet_once(spark):
    rows = spark.createDataFrame([(7, v, v, 0) for v in range(90)], "node long, v long, label long, side int")
    assert sorted(neardup.blocks(rows, F.lit(1)).collect()) == sorted(rows.collect())
    cells = defaultdict(lambda: ([], []))
    for r in neardup.blocks(rows, F.lit(5)).collect():
        cells[r.node][r.side].append(r.v)
    met = Counter()
    for one, two in cells.values():
        met.update(frozenset(p) for p in (itertools.product(one, two) if two else itertools.combinations(one, 2)))
    assert met == dict.fromkeys((frozenset(p) for p in itertools.combinations(range(90), 2)), 1)


def test_sketches_of_small_sets_at_the_threshold():
    """Of 6000 pairs of 4 to 20 shingles whose similarity is exactly 0.8 the filter rejects none, whichever shingles differ."""
    r = np.random.default_rng(3)
    texts, pairs = [], 6000
    for k in range(pairs):
        n = 1 + k % 4
        words = [f"w{x}" for x in r.integers(0, 2**62, 5 * n)]
        own = int(r.integers(0, n + 1))
        texts += [" ".join(words[: 4 * n + own]), " ".join(words[: 4 * n] + words[4 * n + own :])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 3 + [pa.array(texts)], ["doc_id", "hash", "hash2", "text"])
    (out,) = neardup._sketched(iter([batch]), 1)
    bits = np.stack([out.column(c).to_numpy() for c in neardup.SKETCH], axis=1)
    for words in (16, neardup.AHEAD):
        differ = np.bitwise_count((bits[::2, :words] ^ bits[1::2, :words]).view(np.uint64)).sum(axis=1)
        assert len(differ) == pairs and (differ <= neardup.most_apart(0.8, words)).all()


def test_near_duplicates_in_a_group_that_thins_out_slowly(spark):
    """Lone pairs near the threshold among strangers that share most of their text: branching must end before it parts them."""
    r = random.Random(12)
    v = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [r.choice(v) for _ in range(56)]
    texts = [" ".join(base + [r.choice(v) for _ in range(44)]) for _ in range(500)]
    texts += [" ".join(t.split()[:90] + [r.choice(v) for _ in range(10)]) for t in texts[:60]]
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert links == [(i, 500 + i) for i in range(60)]
    # few trees and small nodes, so that a small table branches as deep as a large one
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df, 4, trees=3, small=2).collect()}
    assert got == dict(enumerate(groups(len(texts), links)))


def test_depth_of_branching():
    assert neardup.missed(0.8, 12, 5) < neardup.MISSED < neardup.missed(0.8, 12, 6)
    assert [neardup.deepest(0.8, 12, 24), neardup.deepest(0.5, 12, 24), neardup.deepest(0.8, 12, 3)] == [5, 1, 3]


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).collect() == []


# 3
def plain_spans(text):
    found = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(secrets.RULES) for m in r.compiled().finditer(text or "") if m.end(r.group) - m.start(r.group) >= r.least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(spark, docs, rows):
    r = random.Random(2)
    bits = ["password", "PassWd", "tokeN", "api_key", "apikey", "=", ": ", " ", '"', "'", "AKIA", "ABCDEFGH0123", "0123456789abcdef", "deadbeefdeadbeef", "é", "漢", "\n", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "Ab0", "eyJ", ".", "bearer ", "AIza", "xoxb-", "sk_live_", "https://", "u:", "pppppppp", "@", " ſecret=", "toKen="]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(800)] + [None, "", "token=" + "a" * 100_000]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), masked="*").collect()
    for row in out:
        want = plain_spans(texts[row.doc_id])
        assert [(s.kind, s.start, s.end) for s in row.spans] == want
        if not want:
            assert row.text == texts[row.doc_id]
        elif row.doc_id < 800:
            covered = {i for _, a, b in want for i in range(a, b)}
            assert row.text.replace("*", "") == "".join(c for i, c in enumerate(texts[row.doc_id]) if i not in covered).replace("*", "")
    assert secrets.scan(docs).count() == len(rows)


@pytest.mark.parametrize("text", ["x://y " + "q" * 1_000_000, "eyJ" * 400_000, "eyJab." * 200_000, "eyJ." * 200_000, "-----BEGIN " + "A " * 400_000, "a://b:" * 200_000, "bearer " * 200_000 + " " * 500_000, "token = " * 150_000, "ghp_" * 300_000])
def test_secrets_of_very_long_texts(text):
    """Every rule is linear: a text of a million characters that almost matches takes a second or two, not hours."""
    scanner, began = secrets.Scanner([secrets.lengthened(r) for r in secrets.RULES]), time.time()
    found = [secrets.RULES[k].kind for _, k, _ in scanner.spans(*common.strings(pa.array([text])))[0]]
    assert time.time() - began < 20 and set(found) <= {"assign", "bearer"}


def test_linear_patterns_find_what_plain_ones_do():
    r = random.Random(8)
    parts = ["eyJ", "eyJ", ".", "a", "Zz9_", "-", " ", "://", "://", "http", "Ax", ":", "@", "/", "secret99", "\n", "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(20_000)]
    rules = [secrets.Rule(x.kind, x.pattern, x.group, 0, x.any_case, x.linear) for x in secrets.RULES if x.linear]
    scanner = secrets.Scanner(rules)
    for text, got in zip(texts, scanner.spans(*common.strings(pa.array(texts))), strict=True):
        assert got == sorted((m.start(), k, m.end()) for k, x in enumerate(rules) for m in x.compiled().finditer(text)), text


def test_queries_of_rules():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query("abcd|efgh") in (("or", (("and", ("abc", "bcd")), ("and", ("efg", "fgh")))), ("or", (("and", ("efg", "fgh")), ("and", ("abc", "bcd")))))


# 4
def test_mixing(docs, rows):
    out = mixing.mix(docs, block=8, shard_docs=20).collect()
    again = mixing.mix(docs.repartition(7), block=8, shard_docs=20).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    total, weight = sum(size.values()), {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, targets = set(), {}
    while True:
        left, w = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        targets = {s: 3 * size[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and targets[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= 8 * 6


@pytest.mark.parametrize("size", [3, 5, 10, 20])
def test_mixing_of_rare_short_texts(spark, size):
    """Sources with about one short document in a shard get their targets, at a third of their size as at three times it."""
    rows = [(i, "x " * size, "a" if i < 180 else "b" if i < 240 else "c") for i in range(270)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_docs=1).collect()
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.turns * r.size + r.direct + r.wrapped
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in out}
    assert targets == {"a": 60 * size, "b": 120 * size, "c": 90 * size}
    assert all(abs(taken[s] - target) <= mixing.BLOCK for s, target in targets.items()), taken


def test_highest_quotients(spark):
    r = random.Random(4)
    for seats in (0, 1, 7, 100, 1001):
        weights = [r.choice([0.0, 1.0, r.random() * 100]) for _ in range(9)] + [1.0]
        df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "i int, w double")
        got = {x.i: x.seats for x in mixing.apportioned(df, F.lit(seats), F.col("w"), [], [F.col("i")], "seats").collect()}
        want = Counter()
        for _ in range(seats):
            want[max((i for i in range(10) if weights[i] > 0), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
        assert got == {i: want[i] for i in range(10)}


def test_mixing_of_nothing(empty, spark):
    assert mixing.mix(empty).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, "x"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0)] * 2


# 5
def some_media():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 128, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    return {"image/png": png, "image/bmp": bmp, "image/gif": gif, "audio/wav": media.to_wav(b"abcd"), "application/gzip": gzip.compress(b"hello" * 50, mtime=0), "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF"}


def test_media_types_and_carving(spark):
    kinds = some_media()
    whole = list(kinds.items())
    rows = [(i, d, "text/plain") for i, (_, d) in enumerate(whole)] + [(100, None, None), (101, b"", None), (102, b"BM RIFF GIF89a %PDF-1 PK\x03\x04 plain text", "text/plain"), (103, b"x" * 10 + kinds["image/png"] + b"yy" + kinds["image/gif"] + b"z" * 100_000, None), (104, kinds["image/png"][:-3], "image/png")]
    out = {r.doc_id: r for r in media.sniff(spark.createDataFrame(rows, "doc_id long, media binary, declared string"), "media", "declared").collect()}
    for i, (kind, data) in enumerate(whole):
        assert (out[i].media_type, out[i].media_length, out[i].corrected) == (kind, len(data), True), kind
    assert all(out[i].media_type is None and not out[i].carved for i in (100, 101, 102, 104))
    assert [(c.type, c.offset, bytes(c.data)) for c in out[103].carved] == [("image/png", 10, kinds["image/png"]), ("image/gif", 12 + len(kinds["image/png"]), kinds["image/gif"])]


def ogg_page(stream, flags, data=b"abc"):
    return b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<I", stream) + bytes(8) + b"\x01" + bytes([len(data)]) + data


def test_media_of_rarer_shapes():
    """64-bit and open boxes, streams that interleave, bytes that fill, gzip headers with names."""
    box = lambda kind, data: struct.pack(">I", 8 + len(data)) + kind + data
    long = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345"
    whole = {
        "video/mp4": [box(b"ftyp", b"isom") + long + box(b"moov", b"x"), box(b"ftyp", b"isom") + box(b"moov", b"x") + struct.pack(">I4s", 0, b"mdat") + b"rest"],
        "audio/ogg": [ogg_page(1, 2) + ogg_page(2, 2) + ogg_page(1, 4) + ogg_page(2, 0) + ogg_page(2, 4)],
        "image/jpeg": [b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xff\xda\0\x02xy\xff\0z\xff\xd9"],
        "application/gzip": [gzip.compress(b"x" * 999, mtime=5), b"\x1f\x8b\x08\x08" + bytes(6) + b"name\0" + gzip.compress(b"abc", mtime=0)[10:]],
        "application/pdf": [b"%PDF-1.4\n%%EOF\nstartxref\n0\n%%EOF"],
    }
    for kind, values in whole.items():
        for data in values:
            assert media.found(data) == [(kind, 0, len(data))], data
            # an MP4 or PDF that is cut short may be whole up to an earlier part
            assert kind in ("video/mp4", "application/pdf") or media.found(data[:-1]) == []
    assert media.found(b"".join(v[0] for v in whole.values()))[0][2] == len(whole["video/mp4"][0])


@pytest.mark.parametrize("unit", [m for m, *_ in media.FORMATS] + [b"\0\0\0\x08ftyp", b"\0\0\0\x08ftyp\0\0\0\x08abcd", b"GIF89a" + bytes(7) + b"!!\x06GIF89a", b"\xff\xd8\xff\xe0\0\x02", b"PK\x03\x04PK\x05\x06" + bytes(18), b"%PDF-1.", b"%PDF-1.%%EOF", b"fLaC\0\0\0\x22" + bytes(34), b"\x1f\x8b\x08\x08" + b"a" * 9])
def test_media_of_nothing_but_magic(unit):
    began = time.time()
    media.found(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20


def test_media_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op5_media_columns(spark, str(tmp_path)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), "audio/wav")] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_type) for r in out) == want
    by = defaultdict(set)
    for r in out:
        by[r.payload_sha256].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in by.values())
    for r in rows:
        p = media.padded(r[1])
        stored = media.to_wav(p)
        x = [b - 128 for b in p]
        bands = ",".join(str(sum(b // 32 == k for b in p)) for k in range(8))
        want = f"audio/wav;rate=8000;bits=8;channels=1;samples={len(p)};energy={sum(v * v for v in x)};peak={max(map(abs, x))};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};bands={bands}"
        assert by[hashlib.sha256(p).hexdigest()] == {(hashlib.sha256(stored).hexdigest(), want, len(stored))}


# 6
def test_marginals():
    r = np.random.default_rng(1)
    odds, step, lines = r.normal(size=9), r.normal(size=(2, 2)), np.array([1, 1, 1, 1, 2, 2, 3, 4, 4])
    got, total, moved = toxicity.marginals(odds, step, *toxicity.chains(lines), True)
    z, want, pairs = 0.0, np.zeros(9), np.zeros((2, 2))
    for y in map(np.array, itertools.product([0, 1], repeat=9)):
        w = math.exp(odds[y == 1].sum() + sum(step[y[i], y[i + 1]] for i in range(8) if lines[i] == lines[i + 1]))
        z, want = z + w, want + w * y
        for i in range(8):
            if lines[i] == lines[i + 1]:
                pairs[y[i], y[i + 1]] += w
    assert np.allclose(got, want / z) and np.allclose(moved, pairs / z) and math.isclose(total, math.log(z / 2**4))


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, labels, rows=1500)
    out = toxicity.score(d, model).join(labels, "doc_id").where("held_out").collect()
    bad = [r for r in out if r.toxic]
    assert sum(r.predicted for r in bad) / len(bad) > 0.8
    assert sum(r.predicted for r in out if not r.toxic) / len(out) < 0.02
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)


def test_toxicity_odd_input(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by_id = defaultdict(set)
    for x in rows:
        by_id[x[0]].add(x[1])
    for r in out:
        assert all(any(t and t[s.start : s.end] and not t[s.start : s.end].isspace() for t in by_id[r.doc_id]) for s in r.spans)
    # columns called like results, and ids that repeat more often than the sample has rows
    again = toxicity.score(docs.withColumns({"score": F.lit("x"), "predicted": F.lit(7), "held_out": F.lit(1)}), model)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    many = toxicity.train(docs.unionByName(docs), labels, rows=5)
    assert toxicity.score(docs, many).count() == len(rows)
    for other in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.score < 0.5 and not r.spans for r in toxicity.score(docs, toxicity.train(docs, other)).collect())
    assert toxicity.score(empty, model).collect() == []


# 7
def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b) / (math.sqrt(float(a @ a)) * math.sqrt(float(b @ b)))


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings(spark, block):
    r = np.random.default_rng(5)
    hot = r.normal(size=16)
    vectors = [hot + 0.05 * r.normal(size=16) for _ in range(120)] + [hot + 0.12 * r.normal(size=16) for _ in range(60)] + [r.normal(size=16) for _ in range(60)]
    vectors += [2 * vectors[0], vectors[0], vectors[0]] + [v + 0.2 * r.normal(size=16) for v in vectors[180:220]]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0] * 15 + [float("nan")]), (1004, [1.0] * 15 + [float("inf")]), (1005, [1.0] * 15 + [None]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2)).withColumn("unit", F.lit(3))
    got = Counter(map(tuple, covertree.near_duplicates(df, 0.95, sample=100, block=block).collect()))
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, j in itertools.combinations(good, 2) if len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.95]
    label, n, low = groups(len(rows), links), Counter(x for p in links for x in p), {}
    for i, (k, _) in enumerate(rows):
        low[label[i]] = min(low.get(label[i], k), k)
    assert got == Counter((k, n[i], low[label[i]], k == low[label[i]]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_cover_trees_nest_part_and_cover(n):
    r = np.random.default_rng(n)
    x = covertree.units(np.concatenate([r.normal(size=(n, 6)), r.normal(size=6) + 0.05 * r.normal(size=(n // 2, 6))]))
    order, nodes, radii = covertree.cover_tree(x, 0.3)
    assert sorted(order.tolist()) == list(range(len(x)))
    x = x[order]
    for (centre, low, high, first, many), radius in zip(nodes.tolist(), radii, strict=True):
        assert low <= centre < high and radius == pytest.approx(covertree.distance(x[low:high], x[[centre]]).max(), abs=1e-7)
        if many:
            below = nodes[first : first + many]
            assert below[0, 0] == centre and below[0, 1] == low and below[-1, 2] == high and (below[1:, 1] == below[:-1, 2]).all()
            gaps = covertree.distance(x[below[:, 0]], x[below[:, 0]])[np.triu_indices(many, 1)]
            scale = 2.0 ** math.floor(math.log2(gaps.min()))  # all closer centres are of the level that halves down to this
            assert gaps.min() > scale and all(covertree.distance(x[a:b], x[below[:, 0]]).min(1).max() <= 2 * scale for _, a, b, _, _ in below.tolist())


def test_bundles_hold_each_unit_once():
    sizes = {k: 1 + 7 * k % 40 for k in range(30)} | {300: 100, 301: 51}
    got = covertree.bundles(sizes, lambda u: np.array([float(u), 1.0]), 50)
    assert set(got) == set(sizes) and got[300] == (300, 2) and got[301] == (301, 2)
    filled = Counter()
    for unit, (block, parts) in got.items():
        filled[block] += sizes[unit] if parts == 1 else 0
    assert max(filled.values()) <= 50 and len(filled) < 25


def test_embeddings_of_nothing(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(r) for r in covertree.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


# 8
@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_lattice_sums_all_segmentations(ranks):
    raw = [base64.b64decode(x.split()[0]) for x in open(ranks, "rb")]
    p = lattice.Pieces(raw)
    at = {piece: i for i, piece in enumerate(raw)}
    r = random.Random(1)
    some = ["a", "the", "é", "x" * 45, "thing" * 12] + ["".join(r.choice("thenaè%.") for _ in range(r.randint(1, 30))) for _ in range(60)]
    data = [w.encode() for w in some]
    size = np.array([len(w) for w in data])
    got = lattice.word_logs(p, np.frombuffer(b"".join(data), np.uint8), size)
    expected = lattice.word_counts(p, np.frombuffer(b"".join(data), np.uint8), size, np.ones(len(data)))
    for w, log in zip(data, got, strict=True):
        w = b" " + w
        ahead = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            ahead[j] = sum(ahead[i] * math.exp(p.scores[at[w[i:j]]]) for i in range(j) if w[i:j] in at)
        assert math.isclose(math.log(ahead[-1]), log, rel_tol=1e-9)
    assert math.isclose(sum(expected[i] * len(raw[i]) for i in np.flatnonzero(expected)), size.sum() + len(data))


def test_lm_scores(docs, rows, ranks, empty):
    got = lattice.score(docs, ranks, rounds=1).collect()
    held = [zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows]
    count = Counter(w for r, h in zip(rows, held, strict=True) if not h for w in [*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r, h in zip(rows, held, strict=True):
        t = [*words(r[1]), None]
        want[(r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # the words' probabilities and the end's add up
    ends = {round(r.score, 9) for r in got if r.n_tokens == 1}
    assert len(ends) == 1
    assert lattice.score(empty, ranks).collect() == []


def test_lm_scores_after_rounds_of_fitting(spark, ranks):
    """Probabilities of whole texts after two rounds, against sums over all segmentations, one by one."""
    raw = [base64.b64decode(x.split()[0]) for x in open(ranks, "rb")]
    at = {piece: i for i, piece in enumerate(raw)}
    texts = ["the cat", "The  cat sat", None, "", "a catalogue é", "cat\nsat", "held out word", "the the the", "xqzzj cat"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    scores = list(lattice.Pieces(raw).scores)

    def ways(word):
        """All segmentations as lists of pieces."""
        return [[]] if not word else [[at[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in at for rest in ways(word[k:])]

    train = [t for t, h in zip(texts, held, strict=True) if not h]
    for _ in range(2):
        expected = [lattice.ADDED] * len(raw)
        for t in train:
            for w in words(t):
                each = [(x, math.exp(sum(scores[i] for i in x))) for x in ways(b" " + w)]
                total = sum(p for _, p in each)
                for x, p in each:
                    for i in x:
                        expected[i] += p / total
        total = sum(expected) + len(train) + lattice.ADDED
        scores, end = [math.log(e / total) for e in expected], math.log((len(train) + lattice.ADDED) / total)
    want = [(sum(math.log(sum(math.exp(sum(scores[i] for i in x)) for x in ways(b" " + w))) for w in words(t)) + end) / math.log(10) for t in texts]
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, rounds=2).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(want):
        assert got[i].held_out == held[i] and math.isclose(got[i].score, x, rel_tol=1e-9), (texts[i], got[i].score, x)


def test_lm_scores_in_salted_groups(spark, docs, ranks):
    """Groups of shards change no result."""
    many = docs.repartition(6)
    plain, salted = (sorted(map(tuple, lattice.score(many, ranks, rounds=1, salted=n).collect()), key=str) for n in (4096, 2))
    assert len(plain) == len(salted) == docs.count()
    key = lambda r: (str(r[0]), r[2], r[5], r[6])
    for a, b in zip(sorted(plain, key=key), sorted(salted, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1] * 3)
    assert (lattice.unpacked(lattice.packed(v)) == v).all() and len(lattice.unpacked(b"")) == 0


def test_varints_of_many_words():
    v = np.array([0, 2**21 - 1, 2**21, 3_000_000, 2**28 - 1, 2**28, 2**31 - 1, 2**40, 2**62, 127, 128])
    assert (lattice.unpacked(lattice.packed(v)) == v).all() and (lattice.unpacked(lattice.packed(v[2:4])) == v[2:4]).all()


# 9
def test_bpe_equals_the_library(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(1)
    letters = " \n\t\r\x0b\x0c\x1c\x1f\x85  ab'sStrevmldABZé漢字٣Ⅻ½_-.,!?😀́‍﻿\x00"
    texts = [x[1] for x in rows] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1000)] + ["a" * k for k in range(40)] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, path, decode=True)
    for row in encoded.collect():
        want = t.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.token_ids, "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == t.decode(want, skip_special_tokens=False) == (texts[row.doc_id] or "")
    assert {x.doc_id: x.decoded for x in bpe.decode(encoded, path).collect()} == {i: s or "" for i, s in enumerate(texts)}
    assert bpe.encode(docs, path).count() == len(rows)


def test_bytes_that_are_no_text():
    v = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(8)]
        assert v.text(np.array(ids)) == t.decode(ids, skip_special_tokens=False)


# 10
def test_warc(spark, tmp_path):
    r = random.Random(6)
    big = "é" + "x" * 200
    pages = [(i, f"http://h/{i}", r.choice([big, big, "small", "y" * 99, "z" * 100, "".join(r.choice("abc ") for _ in range(r.randint(0, 3000)))])) for i in range(300)]
    pages += [(300, None, None), (301, "", ""), (302, "http://a b/\r\nX: y", "q" * 150), (5, "http://again", pages[5][2]), (None, "http://n", big), (303, "u", "w" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("shard", F.lit(1))
    listed = warc.write(df, f"file://{tmp_path}/a", shard_bytes=60_000, roll_bytes=8_000).collect()
    out = warc.read(spark, f"file://{tmp_path}/a").collect()
    low = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            low[b] = min(low.get(b, i), i)
    want, first = Counter(), set()
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = i is not None and len(b) >= 100 and (low[b] != i or (i, b) in first)
        first.add((i, b))
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", low[b] if revisit else None)] += 1
    assert Counter((x.id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in out) == want
    assert all(x.block_ok for x in out) and len(listed) > 5
    assert {hashlib.sha256(bytes(x.payload)).hexdigest() == x.payload_digest for x in out if x.record_type == "response"} == {True}
    for f in listed:
        raw = open(f"{tmp_path}/a/{f.name}", "rb").read()
        assert len(raw) == f.bytes and hashlib.sha256(raw).hexdigest() == f.sha256 and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    again = warc.write(df.repartition(5), f"file://{tmp_path}/b", shard_bytes=60_000, roll_bytes=8_000).collect()
    assert sorted(again) == sorted(listed)
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    with pytest.raises(FileExistsError):
        warc.write(df, f"file://{tmp_path}/a")


def test_warc_shards_of_uneven_ids(spark, tmp_path):
    """Outlying ids, and rows without id, don't put all others into one shard."""
    r = random.Random(2)
    pages = [(i, "u", "".join(r.choice("abcdef ") for _ in range(2000))) for i in range(300)] + [(-(2**63), "u", "low"), (2**63 - 1, "u", "high"), (10**15, "u", "far")]
    pages += [(None, f"n{i}", "".join(r.choice("abcdef ") for _ in range(2000))) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    listed = warc.write(df, f"file://{tmp_path}/u", shard_bytes=50_000).collect()
    assert sum(f.records for f in listed) == len(pages) and max(f.records for f in listed) < 60 and len({f.shard for f in listed}) >= 18
    out = warc.read(spark, f"file://{tmp_path}/u").collect()
    assert Counter((x.id, bytes(x.payload).decode()) for x in out) == Counter((i, h) for i, _, h in pages) and all(x.block_ok for x in out)


def test_warc_second_attempts(tmp_path):
    """A finished file of the same bytes stays; one that an earlier, unlisted run has left is replaced."""
    def attempt(text):
        roll = warc.Roll(f"file://{tmp_path}", 0, 1 << 20)
        roll.add(1, text)
        return roll

    one, two = attempt(b"same"), attempt(b"same")
    row = one.close()
    before = os.stat(tmp_path / row[1])
    assert two.close() == row and os.stat(tmp_path / row[1]).st_ino == before.st_ino
    assert not os.listdir(tmp_path / "_temporary")
    other = attempt(b"other").close()
    assert gzip.decompress((tmp_path / row[1]).read_bytes()) == b"other" and other[4] != row[4]


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(df, f"file://{tmp_path}/e").collect() == [] and warc.read(spark, f"file://{tmp_path}/e").collect() == []


def test_sql_answers_the_queries(spark, folder):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    def plain(v):
        return None if v is None else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)

    for name, text in sql.SQL.items():
        df = queries.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        found = c.execute(text)
        order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
        assert [found.description[i][0] for i in order] == columns
        assert sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall()) == sorted(repr(tuple(plain(r[k]) for k in columns)) for r in df.collect()), name
