"""Exact near-duplicate embeddings by dual traversal of cover trees.

On the unit sphere, cosine >= t is distance <= r = sqrt(2 - 2t). A bounded sample of vectors gives the top of the tree:
balls of radius r/2 that hold many of them, and at most CELLS cells of a net whose radii halve from level to level. Every
vector goes to its ball, or else to the cell of its nearest centre; the covering radius of each is then measured over all
of its vectors. Members of one large ball are all linked, so it counts as a whole. Small units share a block with their
neighbours, large ones are dealt over blocks; a block is stored with the cover tree of its vectors, built once: nested
levels of members as centres, with separation and covering radii that halve again. Pairs of units, then of blocks, then of
nodes are followed down both trees: pruned where centres are further apart than both covering radii and r, counted as a
whole where even the farthest members are within r, and compared vector by vector at the leaves. The result is exact; what
a sample can't show only costs time. Where all vectors are far from each other no radius helps, and all blocks meet, as do
the blocks of one cell that is too large for one.

Equal vectors are one vector with a count. Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do vectors of different dimensions with each other. A null vec_id is never the smallest; a component of
null ids only has a null component_id. Repeated rows link with each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep

#: Vectors of the sample (and its bytes at most), members of it that make a ball, balls and cells, and vectors in a block (and their bytes at most).
SAMPLE, SAMPLE_BYTES, BALL_MEMBERS, BALLS, CELLS, BLOCK, BLOCK_BYTES = 2048, 32 << 20, 8, 256, 64, 4096, 4 << 20
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of unit vectors or points inside the sphere."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, the vector's key (null if it can't link), dimension, and bytes (32-bit floats where they hold it exactly)."""
    for batch in batches:
        column = batch.column(1)
        keys: list[int | None] = []
        dims: list[int | None] = []
        raws: list[bytes | None] = []
        for item in column:
            x = np.array(item.values.to_numpy(zero_copy_only=False), np.float64) if item.is_valid and item.values is not None and len(item.values) and not item.values.null_count else None
            if x is None or not np.isfinite(x).all() or not x.any():
                keys.append(None), dims.append(None), raws.append(None)
                continue
            x = x + 0.0  # one zero
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            raw = narrow.tobytes() if (narrow == x).all() else x.tobytes()
            keys.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
            dims.append(len(x)), raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "v", "dim", "raw"])


def numbers(raw: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in raw]) if raw else np.zeros((0, dim))


class Top:
    """The top of the tree over one dimension: centres of balls, then of cells."""

    def __init__(self, sample: np.ndarray, r: float) -> None:
        near = distance(sample, sample) <= r / 2 - SLACK if len(sample) else np.zeros((0, 0), bool)
        free, balls = np.ones(len(sample), bool), []
        while len(balls) < BALLS and free.any():
            many = (near & free).sum(1) * free
            best = int(many.argmax())
            if many[best] < BALL_MEMBERS:
                break
            balls.append(best)
            free &= ~near[best]
        cells: list[int] = []
        # the finest level of the net, radii halving from 2, that has no more cells than allowed
        radius = 2.0
        while radius > r / 4:
            level = list(cells)
            gap = distance(sample, sample[level]).min(1) if level else np.full(len(sample), np.inf)
            while len(level) <= CELLS and (gap > radius).any():
                level.append(int(gap.argmax()))
                gap = np.minimum(gap, distance(sample, sample[level[-1:]])[:, 0])
            if len(level) > CELLS:
                cells = level[:CELLS] if not cells or len(cells) < CELLS // 4 else cells
                break
            cells, radius = level, radius / 2
        self.balls, self.cells = sample[balls], sample[cells or [0]] if len(sample) else np.ones((1, sample.shape[1])) / math.sqrt(sample.shape[1])
        self.reach = r / 2 - SLACK

    def unit(self, x: np.ndarray) -> np.ndarray:
        """For each vector its ball's number, or its cell's, counted on from BALLS."""
        out = BALLS + distance(x, self.cells).argmin(1)
        if len(self.balls):
            d = distance(x, self.balls)
            best = d.argmin(1)
            out = np.where(d[np.arange(len(x)), best] <= self.reach, best, out)
        return out

    def centre(self, unit: int) -> np.ndarray:
        return self.balls[unit] if unit < BALLS else self.cells[unit - BALLS]


def _assigned(batches: Iterator[pa.RecordBatch], tops: dict[int, Top]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.array(batch.column(1).to_pylist(), np.int64)
        unit, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
        raws = batch.column(2).to_pylist()
        for dim in np.unique(dims).tolist():
            which = np.flatnonzero(dims == dim)
            x, top = units(numbers([raws[k] for k in which], dim)), tops[dim]
            unit[which] = top.unit(x)
            centres = np.stack([top.centre(u) for u in unit[which].tolist()])
            far[which] = np.sqrt(((x - centres) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit), pa.array(far)], [*batch.schema.names, "unit", "far"])


BLOCKS = "dim int, unit long, part long, n long, vs binary, counts binary, raw binary, wide boolean, centre binary, radius double, nodes binary, radii binary"
#: Vectors that are compared rather than parted further.
LEAF = 32


def cover_tree(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cover tree of some vectors: their order, nodes (centre, low, high, first child, children) and covering radii.

    Every centre is one of the vectors. The centres of a level lie further apart than its radius, and every vector within
    it of one; radii halve from level to level. Each level has all centres of the one above (a node's first child has its
    own centre), and a new centre belongs to the closest one above. A node's vectors are those from low to high of the
    order, and its covering radius is measured over them. Levels end at r / 8, or before one with more centres than a
    sixteenth of the vectors; nodes without a new centre below, or of at most LEAF vectors, are not parted.
    """
    gap = distance(x, x[[int(distance(x, x.mean(0)[None])[:, 0].argmin())]])[:, 0]
    first = int(gap.argmin())
    centres, owner, most = [first], np.zeros(len(x), np.int64), max(4, len(x) // 16)
    ends, above, settled = [1], [-1], owner.copy()
    radius = 2.0
    while radius > r / 8 and gap.max() > r / 8:
        radius /= 2
        while len(centres) <= most and gap.max() > radius:
            k = int(gap.argmax())
            above.append(int(settled[k]))
            d = distance(x, x[[k]])[:, 0]
            d[k] = 0.0
            closer = d < gap
            gap[closer], owner[closer] = d[closer], len(centres)
            centres.append(k)
        if len(centres) > most:
            break
        ends.append(len(centres))
        settled = owner.copy()
    # the finest whole level owns the vectors; sums over what hangs below a centre give each node's size
    last = len(ends) - 1
    owned = np.argsort(settled, kind="stable")
    cut = np.searchsorted(settled[owned], np.arange(ends[last] + 1))
    new: list[dict[int, list[int]]] = [{} for _ in ends]
    for level in range(1, last + 1):
        for c in range(ends[level - 1], ends[level]):
            new[level].setdefault(above[c], []).append(c)

    def members(c: int, level: int) -> np.ndarray:
        own = [owned[cut[c] : cut[c + 1]]]
        for below in range(level + 1, last + 1):
            own += [members(k, below) for k in new[below].get(c, [])]
        return np.concatenate(own)

    order = np.zeros(0, np.int64)
    nodes: list[list[int]] = [[0, 0, len(x), 0, 0]]
    radii = [0.0]
    todo = [(0, 0, 0, members(0, 0))]
    leaves: list[tuple[int, np.ndarray]] = []
    while todo:
        at, c, level, which = todo.pop()
        low = nodes[at][1]
        radii[at] = float(np.sqrt(((x[which] - x[centres[c]]) ** 2).sum(1).max()))
        nodes[at][0] = centres[c]
        while level < last and c not in new[level + 1]:
            level += 1
        if level == last or len(which) <= LEAF:
            leaves.append((low, which))
            continue
        nodes[at][3:] = len(nodes), 1 + len(new[level + 1][c])
        for k in [c, *new[level + 1][c]]:
            held = members(k, level + 1)
            todo.append((len(nodes), k, level + 1, held))
            nodes.append([0, low, low + len(held), 0, 0])
            radii.append(0.0)
            low += len(held)
    order = np.concatenate([which for _, which in sorted(leaves, key=lambda leaf: leaf[0])])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    table = np.array(nodes, np.int64)
    table[:, 0] = place[table[:, 0]]
    return order, table, np.array(radii)


def _blocked(table: pa.Table, r: float) -> pa.Table:
    """A block, its vectors in the order of its cover tree, with the tree."""
    dim = table.column("dim")[0].as_py()
    raw = table.column("raw").to_pylist()
    v, n = (np.array(table.column(c).to_pylist(), np.int64) for c in ("v", "n"))
    by = np.argsort(v, kind="stable")
    x = numbers(raw, dim)[by]
    u = units(x)
    order, nodes, radii = cover_tree(u, r)
    by = by[order]
    wide = any(len(y) != 4 * dim for y in raw)
    row = {"dim": dim, "unit": table.column("unit")[0].as_py(), "part": table.column("part")[0].as_py(), "n": len(raw), "vs": v[by].tobytes(), "counts": n[by].tobytes(), "raw": x[order].astype(np.float64 if wide else np.float32).tobytes(), "wide": wide, "centre": u[order][nodes[0, 0]].tobytes(), "radius": float(radii[0]), "nodes": nodes.tobytes(), "radii": radii.tobytes()}
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
    return pa.table({k: pa.array([c], t) for (k, c), t in zip(row.items(), kinds, strict=True)})


def bundles(sizes: dict[int, int], centre: Callable[[int], np.ndarray], room: int) -> dict[int, tuple[int, int]]:
    """For each unit the number it goes by, and its parts: small ones go together with those whose centres are closest, until a block is full; others stay alone."""
    out = {u: (u, -(-n // room)) for u, n in sizes.items() if 2 * n > room}
    left = sorted(u for u in sizes if u not in out)
    while left:
        x = centre(left[0])
        near = sorted(left, key=lambda u: (float(((centre(u) - x) ** 2).sum()), u))
        held = 0
        chosen = []
        for u in near:
            if held + sizes[u] > room:
                break
            chosen.append(u)
            held += sizes[u]
        out |= {u: (BALLS + CELLS + chosen[0], 1) for u in chosen}
        left = [u for u in left if u not in out]
    return out


class Tree:
    def __init__(self, nodes: np.ndarray, radii: np.ndarray, x: np.ndarray) -> None:
        self.rows, self.radii, self.centres = nodes.tolist(), radii.tolist(), x[nodes[:, 0]]

    def which(self, k: int) -> np.ndarray:
        return np.arange(self.rows[k][1], self.rows[k][2])

    def children(self, k: int) -> range:
        return range(self.rows[k][3], self.rows[k][3] + self.rows[k][4])


class Pairs:
    """Links between two blocks, or inside one: their numbers for each vector, and edges that span them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]], t: float, same: bool) -> None:
        self.raw, self.t, self.r, self.same = (a, b), t, math.sqrt(2 - 2 * t), same
        self.x = units(a), units(b)
        self.many = many_a, many_b
        self.links = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.parent = list(range(len(a) + (0 if same else len(b))))
        self.edges: list[tuple[int, int]] = []
        self.trees = [Tree(*tree, x) for tree, x in zip(trees, self.x, strict=True)]
        self.follow()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def span(self, i: int, j: int) -> None:
        j += 0 if self.same else len(self.x[0])
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def follow(self) -> None:
        first, second = self.trees
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            ra, rb = first.radii[a], second.radii[b]
            if a == b and self.same:
                below = first.children(a)
                if 2 * ra <= self.r - SLACK:
                    self.all_linked(first.which(a), None)
                elif below:
                    todo += [(p, q) for p in below for q in range(p, below.stop)]
                else:
                    self.compare(first.which(a), None)
                continue
            gap = float(np.sqrt(((first.centres[a] - second.centres[b]) ** 2).sum()))
            if gap > ra + rb + self.r + SLACK:
                continue
            if gap + ra + rb <= self.r - SLACK:
                self.all_linked(first.which(a), second.which(b))
            elif first.children(a) and (ra >= rb or not second.children(b)):
                todo += [(c, b) for c in first.children(a)]
            elif second.children(b):
                todo += [(a, c) for c in second.children(b)]
            else:
                self.compare(first.which(a), second.which(b))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between vectors i of the first block and j of the second (each once)."""
        np.add.at(self.links[0], i, self.many[1][j])
        np.add.at(self.links[0 if self.same else 1], j, self.many[0][i])

    def all_linked(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All of a link with all of b, or (without b) with each other."""
        if b is None:
            self.links[0][a] += self.many[0][a].sum() - self.many[0][a]
            b = a
        else:
            self.links[0][a] += self.many[1][b].sum()
            self.links[0 if self.same else 1][b] += self.many[0][a].sum()
        for i in a.tolist():
            self.span(i, int(b[0]))
        for j in b.tolist():
            self.span(int(a[0]), j)

    def compare(self, a: np.ndarray, b: np.ndarray | None) -> None:
        inner = b is None
        b = a if inner else b
        for k in range(0, len(a), 512):
            rows = a[k : k + 512]
            cosine = self.x[0][rows] @ self.x[1][b].T
            i, j = np.nonzero(cosine >= self.t - SLACK)
            sure = cosine[i, j] > self.t + SLACK
            p, q = rows[i], b[j]
            if inner:
                once = p < q
                p, q, sure = p[once], q[once], sure[once]
            if not sure.all():
                unsure = np.flatnonzero(~sure)
                for m in unsure.tolist():
                    y, z = self.raw[0][p[m]], self.raw[1][q[m]]
                    sure[m] = float(y @ z) / (math.sqrt(float(y @ y)) * math.sqrt(float(z @ z))) >= self.t
                p, q = p[sure], q[sure]
            self.add(p, q)
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                self.span(x, y)


def _linked(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows (v, other, n): an edge, or with no other a number of links."""
    for batch in batches:
        for row in batch.to_pylist():
            same = (row["unit_a"], row["part_a"]) == (row["unit_b"], row["part_b"])
            vs, many, raw = ([np.frombuffer(row[f"{c}_{s}"], np.int64) for s in "ab"] for c in ("vs", "counts", "raw"))
            raw = [np.frombuffer(row[f"raw_{s}"], np.float64 if row[f"wide_{s}"] else np.float32).astype(np.float64).reshape(-1, row["dim"]) for s in "ab"]
            trees = [(np.frombuffer(row[f"nodes_{s}"], np.int64).reshape(-1, 5), np.frombuffer(row[f"radii_{s}"])) for s in "ab"]
            found = Pairs(raw[0], raw[1], many[0], many[1], trees, t, same)
            names = vs[0] if same else np.concatenate(vs)
            links = found.links[0] if same else np.concatenate(found.links)
            hit = np.flatnonzero(links)
            edges = np.array(found.edges, np.int64).reshape(-1, 2)
            v, other = np.concatenate((names[hit], names[edges[:, 0]])), np.concatenate((names[hit], names[edges[:, 1]]))
            n = np.concatenate((links[hit], np.zeros(len(edges), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(other), pa.array(n)], ["v", "other", "n"])


def _near(batches: Iterator[pa.RecordBatch], r: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that may hold a link, by their centres and covering radii."""
    for batch in batches:
        a, b = (np.array([np.frombuffer(x, np.float64) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()], dtype=object) for c in ("centre_a", "centre_b"))
        ra, rb = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("radius_a", "radius_b"))
        keep_row = [math.sqrt(float(((x - y) ** 2).sum())) <= p + q + r + SLACK for x, y, p, q in zip(a, b, ra, rb, strict=True)]
        yield batch.filter(pa.array(keep_row, pa.bool_())).select(["dim", "unit_a", "part_a", "unit_b", "part_b"])


def near_duplicates(df: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (vec_id = component_id)."""
    spark, r = df.sparkSession, math.sqrt(2 - 2 * threshold)
    source = df.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = keep(source.mapInArrow(_parsed, "vec_id long, v long, dim int, raw binary"), "ct-rows")
    distinct = keep(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("dim").alias("dim"), F.max("raw").alias("raw")), "ct-distinct")
    tops: dict[int, Top] = {}
    for dim, in distinct.select("dim").distinct().collect():  # dimensions are few
        most = max(64, min(sample, SAMPLE_BYTES // (8 * dim)))
        chosen = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").limit(most).select("raw").collect()
        tops[dim] = Top(units(numbers([x[0] for x in chosen], dim)), r)
    placed = keep(distinct.select("v", "dim", "raw", "n").mapInArrow(partial(_assigned, tops=tops), "v long, dim int, raw binary, n long, unit long, far double"), "ct-placed")
    # at most BALLS + CELLS units for each dimension
    told = placed.groupBy("dim", "unit").agg(F.count("*").alias("vectors"), F.max("far").alias("far"), F.sum("n").alias("all_n"), F.min("v").alias("low_v")).collect()
    groups = {d: bundles({u.unit: u.vectors for u in told if u.dim == d}, top.centre, max(1, min(block, BLOCK_BYTES // (4 * d)))) for d, top in tops.items()}
    whole = {(u.dim, u.unit) for u in told if u.unit < BALLS and groups[u.dim][u.unit][0] == u.unit}
    pairs = {(a.dim, *sorted((groups[a.dim][a.unit][0], groups[a.dim][b.unit][0]))) for a in told for b in told if a.dim == b.dim and a.unit <= b.unit and not (a.unit == b.unit and (a.dim, a.unit) in whole)
             and float(np.sqrt(((tops[a.dim].centre(a.unit) - tops[a.dim].centre(b.unit)) ** 2).sum())) <= a.far + b.far + r + SLACK}
    facts = spark.createDataFrame([(d, u, *group) for d, of in groups.items() for u, group in of.items()], "dim int, unit long, block long, parts long")
    dealt = placed.join(F.broadcast(facts), ["dim", "unit"]).select("v", "dim", "raw", "n", F.col("block").alias("unit"), F.pmod(F.xxhash64("v"), "parts").alias("part"))
    blocks = keep(dealt.groupBy("dim", "unit", "part").applyInArrow(lambda rows: _blocked(rows, r), BLOCKS), "ct-blocks")
    sides = [blocks.select("dim", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "part", "centre", "radius")]) for s in "ab"]
    near = spark.createDataFrame(sorted(pairs), "dim int, unit_a long, unit_b long").join(sides[0], ["dim", "unit_a"]).join(sides[1], ["dim", "unit_b"]).where("unit_a < unit_b or part_a <= part_b")
    near = near.mapInArrow(partial(_near, r=r), "dim int, unit_a long, part_a long, unit_b long, part_b long")
    # a block hosts about half of its pairs: only the other block's vectors move to each
    turned = F.pmod(F.xxhash64("unit_a", "part_a", "unit_b", "part_b"), F.lit(2)) == 1
    near = keep(near.select("dim", *[F.when(turned, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s, t in ("ab", "ba") for c in ("unit", "part")]), "ct-pairs")
    full = [blocks.select("dim", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "part", "vs", "counts", "raw", "wide", "nodes", "radii")]) for s in "ab"]
    met = near.hint("merge").join(full[0].hint("merge"), ["dim", "unit_a", "part_a"]).hint("merge").join(full[1].hint("merge"), ["dim", "unit_b", "part_b"])
    found = keep(met.mapInArrow(partial(_linked, t=threshold), "v long, other long, n long"), "ct-links")
    # members of one ball are linked with all of it
    balls = spark.createDataFrame([(u.dim, u.unit, u.low_v, u.all_n) for u in told if (u.dim, u.unit) in whole], "dim int, unit long, low_v long, all_n long")
    inside = placed.select("v", "dim", "unit", "n").join(F.broadcast(balls), ["dim", "unit"])
    counts = found.select("v", "n").unionByName(inside.select("v", (F.col("all_n") - F.col("n")).alias("n"))).groupBy("v").agg(F.sum("n").alias("links"))
    edges = found.where("v <> other").select(F.col("v").alias("a"), F.col("other").alias("b")).unionByName(inside.where("v <> low_v").select(F.col("v").alias("a"), F.col("low_v").alias("b")))
    labels = components(edges, "ct-components")
    named = keep(distinct.select("v", "n", "first_id").join(labels, "v", "left").select("v", "n", "first_id", F.coalesce("label", "v").alias("label")), "ct-labels")
    smallest = keep(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "ct-smallest")
    facts = keep(named.join(smallest, "label").join(counts, "v", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "ct-facts")
    out = rows.select("vec_id", "v").join(facts, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
