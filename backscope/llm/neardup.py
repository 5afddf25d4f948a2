"""Near duplicates on word shingles by a chosen-path set similarity join.

Each distinct shingle set gets minwise tokens. In every one of a number of independent trees the root branches sets by one
or two chosen tokens; a node's sets share the tokens of its path. Two sets of similarity s stay together in 1.25 s children
on average, so that at the threshold a path survives and at much less it dies out. Nodes of one set end. First, each set of
a node is held against a few of the node's sets, other ones in each node, and linked to the closest of them: this joins even
a group of very many copies of one text without its pairs. Nodes whose sets are now in one component are done. Large ones
of the others branch again, as written tables, for as long as that thins them out and hardly parts links. A node that fits
a task branches there as before, and what is small in the end is compared exhaustively across components. Nodes that stay
large are dense: they are cut into blocks, and every two blocks of one are compared by a task of its own.

Where candidates are few, they are confirmed in a join. A node, or a pair of blocks, in which they outnumber the sets gives
no pairs: its sets come together with their full shingles, as many as one task may hold, and are compared there, until they
are one component. So no link between two components is lost, and no group gives the square of its sets as rows.

Candidates first pass a sketch of 1024 bits, each of another minwise order (a pair at the threshold fails less than ten times
in a million); links are then confirmed on full sets. Branching ends at the last level after which all trees miss a pair at the
threshold less than once in a thousand (the fifth for 0.8 and 12 trees, with 0.75 in a thousand); most nodes are small long before.
Pairs inside one component need not be found. Dense remainders that share much without links cost the square of their sets.

Rows whose sets are equal count as one set (told apart by 64 bits). A text without words has the empty set and links with
nothing. A null text counts as empty; a null id is never the smallest of its component, and a component of null ids only
has a null component_id. Repeated rows are each in the result. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, done, grouped, keep, set_key, shingle_sets

#: Minwise tokens that trees choose from, trees, the sets of a node that are compared exhaustively, levels at most, the share of rows left in large nodes up to which a level counts as thinning.
TOKENS, TREES, SMALL, LEVELS, THINNER, SEED = 96, 12, 256, 24, 0.8, 5
#: Sets of a node that all its sets are first held against; the sets of a node, or of two blocks, and the shingles of full sets that one task may hold; candidates for each set of a node up to which they are given as pairs.
CENTRES, BIG, HELD, SPARSE = 8, 4096, 1 << 22, 2
#: Standard deviations that the sketch filter leaves below the threshold.
SLACK = 4.5
#: The share of pairs at the threshold that all trees together may miss.
MISSED = 0.001
#: Columns of the sketch, and how many of them are compared first.
SKETCH = tuple(f"s{k}" for k in range(16))
AHEAD = 4
_FACTORS = np.random.default_rng(31).integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(values: np.ndarray) -> np.ndarray:
    """For each of 1024 orders the least value of a set under it: 512 products, of which either half is an order."""
    out = np.full(1024, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 256):
        out = np.minimum(out, (values[k : k + 256, None] * _FACTORS).view(np.uint32).min(axis=0))
    return out


def sketch_bits(least: np.ndarray) -> np.ndarray:
    """One bit of each least value, by all of its bits: the low bit alone of a low half is the shingle's own in every order."""
    x = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (x >> np.uint32(31)).astype(np.uint8)


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, hash, hash2, text) with the size of their set, its key, tokens and sketch in place of the text."""
    for batch in batches:
        size, key, tokens, bits = [], [], [], []
        for values in shingle_sets(batch.column(3), width):
            size.append(len(values))
            if not len(values):
                key.append(None), tokens.append(np.zeros(0, np.uint32)), bits.append([None] * 16)
                continue
            least = minwise(values)
            key.append(set_key(values)), tokens.append(least[1::2][:TOKENS])
            bits.append(np.packbits(sketch_bits(least)).view(np.int64).tolist())
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens).view(np.int32) if tokens else [], pa.int32()))
        sketch = [pa.array(c, pa.int64()) for c in (zip(*bits, strict=True) if bits else [[]] * 16)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(key, pa.int64()), listed, *sketch], ["doc_id", "hash", "hash2", "n_shingles", "v", "tokens", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Texts as (v, shared): the key of the set, and the full set as a sorted array."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            values = [x for x in shingle_sets(batch.column(0).slice(k, 500), width) if len(x)]
            if values:
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in values], pa.int64()), listed], ["v", "shared"])


def most_apart(threshold: float, words: int = len(SKETCH)) -> int:
    """In how many bits of so many words of two sketches sets at the threshold differ at most, but for chance."""
    bits, same = 64 * words, (1 + threshold) / 2
    return bits - math.floor(bits * same - SLACK * math.sqrt(bits * same * (1 - same)))


def missed(threshold: float, trees: int, level: int) -> float:
    """The share of pairs at the threshold that no tree keeps together over so many levels, over the numbers of tokens that such a pair shares."""
    def parted(s: float) -> float:
        out = 0.0
        for _ in range(level):
            one = 1 - s + s * out
            out = 0.75 * one + 0.25 * one * one
        return out

    return sum(math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) * parted(k / TOKENS) ** trees for k in range(TOKENS + 1))


def deepest(threshold: float, trees: int, levels: int) -> int:
    """The last level, of at most so many and from the root's on, whose planned recall is enough."""
    level = 1
    while level < levels and missed(threshold, trees, level + 1) <= MISSED:
        level += 1
    return level


def roots(sets: DataFrame, trees: int, seed: int) -> DataFrame:
    """(node, v): the children of all trees' roots."""
    chosen = random.Random(seed)
    paths = [(tree, k) for tree in range(trees) for k in chosen.sample(range(TOKENS), 1 + (chosen.random() < 0.25))]
    nodes = [F.xxhash64(F.lit(tree), F.lit(k), F.col("tokens")[k]) for tree, k in paths]
    return sets.select(F.explode(F.array(*nodes)).alias("node"), "v")


def branched(rows: DataFrame) -> DataFrame:
    """(node, v, label, tokens): the children of nodes, each by one or two tokens that the node's name chooses."""
    def child(salt: str) -> Column:
        at = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", at, F.element_at("tokens", at + 1))

    two = F.pmod(F.xxhash64("node", F.lit("two")), F.lit(4)) == 0
    return rows.select(F.explode(F.when(two, F.array(child("a"), child("b"))).otherwise(F.array(child("a")))).alias("node"), "v", "label", "tokens")


def still_open(rows: DataFrame) -> DataFrame:
    """The rows of nodes that span components, with the number n of the node's sets. A written table."""
    counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    return keep(rows.join(keep(counts.where("least <> most").select("node", "n"), "cp-open"), "node"), "cp-nodes")


#: Bits of the filter that keeps other texts out: with 64 in a row, 2^20 rows at most are sent to all executors. Used texts up to which it is taken; beyond, texts meet the used ones in a join.
FILTER_BITS, FILTERED = 1 << 26, 1 << 22


def full_sets(vertices: DataFrame, most: int, source: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(v, shared): the full sets of these vertices (v), at most so many, made anew from one text of each. Some more may come along."""
    used = vertices.distinct().join(places, "v").select("place")
    if most <= FILTERED:
        bits = max(1 << 16, min(FILTER_BITS, 1 << (16 * most).bit_length()))

        def at(place: str) -> Column:
            return F.pmod(F.col(place), F.lit(bits))

        cells = used.groupBy(F.shiftright(at("place"), 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(place, {bits}) % 64))")).alias("bits"))
        some = source.join(F.broadcast(cells), F.shiftright(at("place"), 6) == F.col("cell")).where(F.expr(f"bit_get(bits, int(pmod(place, {bits}) % 64)) = 1"))
    else:
        some = source.join(keep(used, "cp-used"), "place", "left_semi")
    return keep(some.select("text").mapInArrow(partial(_sets, width=width), "v long, shared array<long>").dropDuplicates(["v"]), "cp-sets")


def linked(x: str, y: str, share: int) -> Column:
    """100 * intersection >= share * union."""
    common = F.size(F.array_intersect(x, y)).cast("long")
    return 100 * common >= share * (F.size(x) + F.size(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b), of a written table, that are linked."""
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("shared").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("shared").alias("y")), "b")
    return keep(both.where(linked("x", "y", share)).select("a", "b"), "cp-links")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of x differs from each row of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def partners(x: dict[str, np.ndarray], own: np.ndarray, among: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of sets of two components whose sketches are alike, i of own, j of among, for some of own at a time."""
    label, sketch = x["label"], x["sketch"]
    for k in range(0, len(own), 128):
        part = own[k : k + 128]
        near = (apart(sketch[part, :AHEAD], sketch[among, :AHEAD]) <= most_apart(threshold, AHEAD)) & (label[part, None] != label[None, among])
        i, j = np.nonzero(near)
        i, j = part[i], among[j]
        alike = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most_apart(threshold)
        yield i[alike], j[alike]


def leaves(node: int, tokens: np.ndarray, small: int, levels: int) -> Iterator[tuple[int, np.ndarray]]:
    """Names and places of the sets of a node's descendants, branched by tokens that a name chooses, until children are small or levels end."""
    todo = [(node, np.arange(len(tokens)), levels)]
    while todo:
        name, own, left = todo.pop()
        if len(own) <= small or not left:
            yield name, own
            continue
        chosen = random.Random(name)
        for k in chosen.sample(range(TOKENS), 1 + (chosen.random() < 0.25)):
            value = tokens[own, k]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for child in np.split(order, cuts):
                if len(child) > 1:
                    todo.append((hash((name, k, int(value[child[0]]))), own[child], left - 1))


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)


def _branching(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of a batch, with tokens and sketches as matrices; nodes that don't branch have no tokens."""
    tokens, matrix = batch.column("tokens"), np.zeros((batch.num_rows, TOKENS), np.int32)
    matrix[tokens.is_valid().to_numpy(zero_copy_only=False)] = tokens.flatten().to_numpy().reshape(-1, TOKENS)
    return {c: batch.column(c).to_numpy() for c in ("node", "v", "label", "levels", "side")} | {"sketch": _sketches(batch), "tokens": matrix}


def sides(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of two blocks, or of one twice."""
    one, two = (np.flatnonzero(x["side"] == k) for k in (0, 1))
    return (one, two) if len(one) and len(two) else (one if len(one) else two,) * 2


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float, small: int) -> Iterator[pa.RecordBatch]:
    """Of nodes, or pairs of blocks, sorted: pairs (a, b), or, where these are many, the sets a that have a partner, with their node, label and side."""
    for x in grouped(map(_branching, (b for b in batches if b.num_rows)), "node"):
        if (x["label"] == x["label"][0]).all():
            continue
        left = int(x["levels"][0])
        for name, own, among in [(int(x["node"][0]), *sides(x))] if left < 0 else [(name, own, own) for name, own in leaves(int(x["node"][0]), x["tokens"], small, left)]:
            n, pairs, some = 0, [], np.zeros(len(x["v"]), bool)
            for i, j in partners(x, own, among, threshold):
                n += len(i)
                some[i] = some[j] = True
                if n <= 2 * SPARSE * len(own):
                    pairs.append((i, j))
            if not n:
                continue
            if n <= 2 * SPARSE * len(own):
                ends = [x["v"][np.concatenate(c)] for c in zip(*pairs, strict=True)]
                rows = np.unique(np.stack([np.maximum(*ends), np.minimum(*ends)]), axis=1)
                none = np.zeros(rows.shape[1], np.int64)
                columns = [pa.array(none, pa.int64(), mask=np.ones(len(none), bool)), *map(pa.array, rows), pa.array(none), pa.array(none.astype(np.int32))]
            else:
                some = np.flatnonzero(some)
                none = np.zeros(len(some), np.int64)
                columns = [pa.array(np.full(len(some), name)), pa.array(x["v"][some]), pa.array(none, pa.int64(), mask=np.ones(len(none), bool)), pa.array(x["label"][some]), pa.array(x["side"][some].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "a", "b", "label", "side"])


def _full(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of a batch, with sketches as a matrix, and each full set as an array of its own."""
    listed = batch.column("shared")
    flat, at = listed.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy())))
    shared = np.empty(batch.num_rows, object)
    shared[:] = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    return {c: batch.column(c).to_numpy() for c in ("node", "v", "label", "side")} | {"sketch": _sketches(batch), "shared": shared}


def _joined(batches: Iterator[pa.RecordBatch], threshold: float, share: int) -> Iterator[pa.RecordBatch]:
    """Of dense nodes, or pairs of blocks, sorted: links (a, b) that join components, confirmed on full sets; those that a node's own links have joined aren't compared further."""
    for x in grouped(map(_full, (b for b in batches if b.num_rows)), "node"):
        v, shared, label, links = x["v"], x["shared"], x["label"].copy(), []
        size = np.array([len(s) for s in shared])
        for i, j in partners(x, *sides(x), threshold):
            cuts = np.flatnonzero(i[1:] != i[:-1]) + 1
            for own, others in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
                others = others[label[others] != label[own[0]]] if len(own) else others
                if not len(others):
                    continue
                one, near = own[0], np.concatenate(shared[others])
                at = np.minimum(np.searchsorted(shared[one], near), size[one] - 1)
                common = np.add.reduceat((shared[one][at] == near).astype(np.int64), np.concatenate(([0], np.cumsum(size[others])[:-1])))
                for other in others[100 * common >= share * (size[one] + size[others] - common)]:
                    if label[other] != label[one]:
                        links.append((max(v[one], v[other]), min(v[one], v[other])))
                        label[label == label[other]] = label[one]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def blocks(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows (node, v, label and what else) of large nodes, in so many parts, as pairs of blocks: each block with itself, and with every other. One part stays as it is."""
    own = F.pmod(F.xxhash64("v", F.lit("block")), parts).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    apart = F.when(parts == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    return met.withColumn("side", F.when(parts == 1, F.col("side")).otherwise((F.col("own") > F.col("other")).cast("int"))).withColumn("node", apart).drop("own", "other")


def near_duplicates(df: DataFrame, width: int = 5, share: int = 80, id: str = "doc_id", text: str = "text", trees: int = TREES, small: int = SMALL, levels: int = LEVELS, seed: int = SEED, columns: tuple[str, ...] = (), big: int = BIG, held: int = HELD) -> DataFrame:
    """For each row of df, or with columns each row and those columns, the set's key v and its component's least key label: doc_id, n_shingles, component_id (smallest id reachable by links of at least share % similarity), kept (doc_id = component_id)."""
    threshold = share / 100
    words = F.col(f"`{text}`").cast("string")
    digest = [F.xxhash64(words).alias("hash"), F.xxhash64(F.lit(share), words).alias("hash2")]
    source = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), *digest, words.alias("text"))
    place = F.xxhash64("doc_id", "hash", "hash2").alias("place")
    rows = keep(source.mapInArrow(partial(_sketched, width=width), "doc_id long, hash long, hash2 long, n_shingles long, v long, tokens array<int>, " + ", ".join(f"{c} long" for c in SKETCH)), "cp-rows")
    # one row stands for each set; its text is found again by its place
    some = rows.where("v is not null").select("v", "doc_id", F.struct(place, "n_shingles", "tokens", *SKETCH).alias("s"))
    sets = keep(some.groupBy("v").agg(F.min("doc_id").alias("first_id"), F.min("s").alias("s")).select("v", "first_id", "s.*"), "cp-firsts")
    places, source = sets.select("v", "place"), source.select(place, "text")

    # centres of a node: of each part of it the least after its bits are mixed with the node's
    mixed = F.col("v").bitwiseXOR(F.xxhash64("node"))
    first = roots(sets.select("v", "tokens"), trees, seed).withColumn("mixed", mixed)
    part = F.pmod(F.xxhash64("mixed"), F.lit(CENTRES))
    lows = [F.min(F.when(part == k, F.col("mixed"))).alias(f"c{k}") for k in range(CENTRES)]
    counts = keep(first.groupBy("node").agg(F.count("*").alias("n"), *lows).where("n > 1"), "cp-counts")
    centre = F.coalesce(F.col("mixed").isin(*[F.col(f"c{k}") for k in range(CENTRES)]), F.lit(False)).alias("centre")
    met = keep(first.join(counts, "node").select("node", "v", "n", centre).join(sets.select("v", *SKETCH), "v"), "cp-roots")
    centres = keep(met.where("centre").groupBy("node").agg(F.collect_list(F.struct(F.col("v").alias("c"), *SKETCH)).alias("centres")), "cp-centres")

    def held_against(c: Column) -> Column:
        differ = [F.bit_count(c[s].bitwiseXOR(F.col(s))) for s in SKETCH]
        return F.struct(sum(differ[1:], differ[0]).alias("differ"), c["c"].alias("c"))

    near = F.filter(F.transform("centres", held_against), lambda c: (c["differ"] <= most_apart(threshold)) & (c["c"] != F.col("v")))
    stars = met.join(centres, "node").select("v", F.array_min(near)["c"].alias("c")).where("c is not null")
    stars = keep(stars.select(F.greatest("v", "c").alias("a"), F.least("v", "c").alias("b")).distinct(), "cp-pairs")
    full = full_sets(stars.select(F.explode(F.array("a", "b")).alias("v")), 2 * stars.count(), source, places, width)
    links = confirmed(stars, full, share)
    names = met.where("n > 2").select("node", "v")

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(components(links, "cp-components"), "v", "left").withColumn("label", F.coalesce("label", "v"))

    nodes = still_open(keep(labelled(names, links).select("node", "v", "label"), "cp-marked"))
    parts: list[DataFrame] = []
    last, level, before = deepest(threshold, trees, levels), 1, math.inf
    while True:
        parts.append(nodes.where(F.col("n") <= big).select("node", "v", "label", "n", F.lit(last - level).alias("levels"), F.lit(0).alias("side")))
        many = nodes.where(F.col("n") > big)
        left = many.count()
        if not left:
            break
        if level == last or left > before * THINNER:
            cells = many.select("node", "v", "label", "n", F.lit(-1).alias("levels"), F.lit(0).alias("side"))
            parts.append(blocks(cells, F.ceil(F.col("n") / max(1, big // 2)).cast("int")))
            break
        if level == 1:
            many = keep(many.select("node", "v", "label").join(sets.select("v", "tokens"), "v"), "cp-many")
        nodes, level, before = still_open(branched(many)), level + 1, left
    compared = parts[0]
    for more in parts[1:]:
        compared = compared.unionByName(more)
    tokens = F.when((F.col("n") > small) & (F.col("levels") > 0), F.col("tokens")).alias("tokens")
    compared = compared.join(sets.select("v", "tokens", *SKETCH), "v").select("node", "v", "label", "levels", "side", tokens, *SKETCH)
    found = keep(compared.repartition("node").sortWithinPartitions("node").mapInArrow(partial(_candidates, threshold=threshold, small=small), "node long, a long, b long, label long, side int"), "cp-found")
    pairs, dense = found.where("node is null").select("a", "b").distinct(), found.where("node is not null").select("node", F.col("a").alias("v"), "label", "side")
    done(full)
    full = full_sets(found.select(F.explode(F.array("a", "b")).alias("v")).where("v is not null"), 2 * found.count(), source, places, width)
    links = links.unionByName(confirmed(pairs, full, share))
    if dense.take(1):
        dense = keep(dense.join(sets.select("v", "n_shingles", *SKETCH), "v"), "cp-dense")
        weights = keep(dense.groupBy("node").agg(F.ceil(F.sum("n_shingles") / held).cast("int").alias("parts")), "cp-weights")
        cells = blocks(dense.join(weights, "node"), F.col("parts")).drop("parts", "n_shingles").join(full, "v")
        links = links.unionByName(keep(cells.repartition("node").sortWithinPartitions("node").mapInArrow(partial(_joined, threshold=threshold, share=share), "a long, b long"), "cp-joined"))
    done(full)
    named = keep(labelled(sets.select("v", "first_id"), links), "cp-named")
    smallest = keep(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "cp-smallest")
    facts = keep(named.join(smallest, "label").select("v", "label", "component_id"), "cp-facts")
    if not columns:
        out = rows.select("doc_id", "n_shingles", "v").join(facts, "v", "left")
    else:  # equal texts, told apart by 128 bits, have one set
        by_text = keep(rows.select("hash", "hash2", "n_shingles", "v").distinct().join(facts, "v", "left"), "cp-texts")
        out = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in columns if c != id], *digest).join(by_text, ["hash", "hash2"])
    done(sets, counts, met, centres, stars, named, smallest)
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    extra = [F.col(f"`{c}`") for c in columns if c != id] + [F.col("v"), F.col("label")] * bool(columns)
    return out.select("doc_id", *extra, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
