"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors are dealt to cells, the nodes nearest a bounded sample of centres,
and every cell is cut into blocks.  Each block gets a cover tree: nested levels
of nodes whose radii halve, each with its true covering radius, down to single
vectors.  Pairs of blocks whose covering radii keep them apart are never formed;
in the others both trees are walked together, level by level.  A pair of nodes
is dropped when their distance less both radii is beyond the threshold, taken
whole when their distance plus both radii is within it, and opened otherwise;
vectors are compared in double precision.  Equal vectors are one leaf.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow, join_anew, settle, unit_hash
from siltstone.llm.graph import components
from siltstone.llm.near_dup import _forest


@dataclass(frozen=True)
class VectorDupParams:
    cosine: float = 0.9
    #: Blocks of a side of a tile, of which a task holds two sides.
    tile: int = 6
    #: Vectors of a block, and bounds of the centres and the blocks, both of which every task holds.
    block: int = 4096
    most_centres: int = 1024
    most_blocks: int = 20_000
    radii: tuple[float, ...] = (0.5, 0.25, 0.125)
    seed: int = 5

    @property
    def reach(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)


_EPS = 1e-9


def _unit(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    """Rows at length one; first each is divided by its largest component, so that no square underflows or overflows."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net: for each row the number of its centre's node; centres are more than `radius` apart, rows within it."""
    centres = np.empty((len(x), x.shape[1]))
    n, node = 0, np.full(len(x), -1)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        if n:
            d = part @ centres[:n].T
            best = d.argmax(1)
            near = _distance(d[np.arange(len(part)), best]) <= radius
            node[lo : lo + 256][near] = best[near]
        todo = np.flatnonzero(node[lo : lo + 256] < 0)
        own = part[todo] @ part[todo].T
        open_ = np.ones(len(todo), bool)
        for k in range(len(todo)):
            if open_[k]:
                mine = open_ & (_distance(own[k]) <= radius)
                mine[k] = True
                node[lo + todo[mine]] = n
                open_[mine] = False
                centres[n] = part[todo[k]]
                n += 1
    return node


class CoverTree:
    """Vectors in tree order; for each level the nodes' first and last rows, centre row, covering radius and first child."""

    def __init__(self, ids: np.ndarray, mult: np.ndarray, given: np.ndarray, radii: tuple[float, ...]):
        x = _unit(given)
        order, edges = np.arange(len(x)), np.array([0, len(x)])
        starts = []
        for radius in radii:
            label = np.zeros(len(x), np.int64)
            base = 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo == 1:
                    label[lo] = base
                    base += 1
                    continue
                node = _net(x[order[lo:hi]], radius)
                label[lo:hi] = base + node
                base += int(node.max()) + 1
            inner = np.argsort(label, kind="stable")
            order = order[inner]
            edges = np.append(np.searchsorted(label[inner], np.arange(base)), len(x))
            starts = [*starts, edges]
        self.ids, self.mult, self.given, self.x = ids[order], mult[order], given[order], x[order]
        self.levels = []
        for edges in [*starts, np.arange(len(x) + 1)]:
            first = edges[:-1]
            owner = np.repeat(np.arange(len(first)), np.diff(edges))
            far = _distance((self.x * self.x[first][owner]).sum(1))
            far[first] = 0.0
            self.levels.append((edges, np.maximum.reduceat(far, first)))

    def dump(self) -> bytes:
        with np.errstate(over="ignore"):
            kind = "<f4" if (self.given.astype("<f4") == self.given).all() else "<f8"  # half the bytes where nothing is lost
        head = struct.pack("<IIII", len(self.ids), self.x.shape[1], len(self.levels), int(kind[-1]))
        body = [head, self.ids.astype("<i8").tobytes(), self.mult.astype("<i8").tobytes(), self.given.astype(kind).tobytes()]
        for edges, radius in self.levels:
            body += [struct.pack("<I", len(radius)), edges.astype("<i8").tobytes(), radius.astype("<f8").tobytes()]
        return b"".join(body)

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        n, dim, levels, each = struct.unpack_from("<IIII", raw)
        at = 16
        tree.ids, tree.mult = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n)
        tree.given = np.frombuffer(raw, f"<f{each}", n * dim, at + 16 * n).reshape(n, dim)
        tree.x = _unit(tree.given)
        at += 16 * n + each * n * dim
        tree.levels = []
        for _ in range(levels):
            (k,) = struct.unpack_from("<I", raw, at)
            tree.levels.append((np.frombuffer(raw, "<i8", k + 1, at + 4), np.frombuffer(raw, "<f8", k, at + 12 + 8 * k)))
            at += 12 + 16 * k
        return tree


def _children(edges: np.ndarray, below: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of nodes, one level down."""
    lo, hi = np.searchsorted(below, edges[node]), np.searchsorted(below, edges[node + 1])
    return lo, hi - lo


def _meeting(one: CoverTree, two: CoverTree, reach: float, tight: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of top nodes that their radii don't keep apart.

    Most nodes of scattered vectors are tight, so for those one bound serves
    all; single precision with some slack does here, as the pairs are judged
    again further down.
    """
    (ea, ra), (eb, rb) = one.levels[0], two.levels[0]
    xa, xb = one.x[ea[:-1]].astype(np.float32), two.x[eb[:-1]].astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for tight_a in (True, False):
        for tight_b in (True, False):
            rows, columns = np.flatnonzero((ra <= tight) == tight_a), np.flatnonzero((rb <= tight) == tight_b)
            other = np.ascontiguousarray(xb[columns].T)
            for lo in range(0, len(rows) if len(columns) else 0, 512):
                part = rows[lo : lo + 512]
                spread = 2 * tight if tight_a and tight_b else ra[part, None] + rb[None, columns]
                bound = np.float32(1 - (spread + reach) ** 2 / 2 - 1e-4) if np.isscalar(spread) else (1 - (spread + reach) ** 2 / 2 - 1e-4).astype(np.float32)
                i, j = np.nonzero(xa[part] @ other >= bound)
                found.append((part[i], columns[j]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def dual(one: CoverTree, two: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of both trees with the other's vectors (counting copies), and a spanning forest of the links."""
    reach = math.sqrt(2 - 2 * cosine)
    same = one is two
    count_a, count_b = np.zeros(len(one.ids) + 1, np.int64), np.zeros(len(two.ids) + 1, np.int64)
    sum_a, sum_b = (np.concatenate(([0], np.cumsum(t.mult))) for t in (one, two))
    itself = np.zeros(len(one.ids) + 1, np.int64)
    pairs_a: list[np.ndarray] = []
    pairs_b: list[np.ndarray] = []
    last = len(one.levels) - 1
    a, b = _meeting(one, two, reach)
    for level in range(last + 1):
        (ea, ra), (eb, rb) = one.levels[level], two.levels[level]
        if not len(a):
            break
        keep, whole = [], []
        for lo in range(0, len(a), 65536):
            p, q = a[lo : lo + 65536], b[lo : lo + 65536]
            dots = np.einsum("ij,ij->i", one.x[ea[p]], two.x[eb[q]])
            if level == last:
                keep.append(dots >= cosine)
                continue
            d, spread = _distance(dots), ra[p] + rb[q]
            whole.append(d + spread < reach - _EPS)
            keep.append((d <= spread + reach + _EPS) & ~whole[-1])
        keep = np.concatenate(keep)
        done = keep if level == last else np.concatenate(whole)
        p, q = a[done], b[done]
        if level == last and same:
            p, q = p[p != q], q[p != q]
        if same:
            np.add.at(itself, ea[p[p == q]], 1)
            np.add.at(itself, ea[p[p == q] + 1], -1)
        np.add.at(count_a, ea[p], sum_b[eb[q + 1]] - sum_b[eb[q]])
        np.add.at(count_a, ea[p + 1], sum_b[eb[q]] - sum_b[eb[q + 1]])
        np.add.at(count_b, eb[q], sum_a[ea[p + 1]] - sum_a[ea[p]])
        np.add.at(count_b, eb[q + 1], sum_a[ea[p]] - sum_a[ea[p + 1]])
        for (own, other), (x, y), flip in (((ea, eb), (p, q), False), ((eb, ea), (q, p), True)):
            # every row of one node is linked with the first row of the other
            length = own[x + 1] - own[x]
            rows = np.repeat(own[x] - np.concatenate(([0], np.cumsum(length)[:-1])) if len(x) else own[x], length) + np.arange(length.sum())
            firsts = np.repeat(other[y], length)
            pairs_a.append(firsts if flip else rows)
            pairs_b.append(rows if flip else firsts)
        if level == last:
            break
        a, b = a[keep], b[keep]
        (la, na), (lb, nb) = _children(ea, one.levels[level + 1][0], a), _children(eb, two.levels[level + 1][0], b)
        each = na * nb
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        width = np.repeat(nb, each)
        a, b = np.repeat(la, each) + k // np.maximum(width, 1), np.repeat(lb, each) + k % np.maximum(width, 1)
    left, right = np.cumsum(count_a)[:-1], np.cumsum(count_b)[:-1]
    if same:  # a node that met itself and was taken whole has counted each row with itself
        left = left - one.mult * np.cumsum(itself)[:-1]
    none = np.empty(0, np.int64)
    p, q = np.concatenate([none, *pairs_a]), np.concatenate([none, *pairs_b]) + (0 if same else len(one.ids))
    ids = one.ids if same else np.concatenate((one.ids, two.ids))
    differ = p != q
    p, q = p[differ], q[differ]
    keep_edges = _forest(len(ids), p, q)
    return left, right, [(int(ids[p[k]]), int(ids[q[k]])) for k in keep_edges]


def near_vectors(vectors: DataFrame, params: VectorDupParams = VectorDupParams()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; so do vectors of different lengths with one another.
    Rows that repeat a vector link with each other.  A row with a null vec_id
    counts as a link but has a null component and is kept.  Whole tables are
    read and components compared as doubles; labels and other columns are
    ignored, and an empty table gives an empty result.  Directions count and
    lengths don't, also of components too small or too large to be squared.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("e", lambda v: v != 0), F.lit(False))
    read = settle(rows.withColumn("e", F.when(usable, F.col("e"))))
    classes = settle(read.filter("e IS NOT NULL").groupBy("e").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("mult")))
    n = classes.count()
    block = max(params.block, -(-n // params.most_blocks))
    centres = min(params.most_centres, max(1, n // params.block))
    sample = classes.select("id", "e").orderBy(unit_hash("id", params.seed), "id").limit(centres).collect()
    by_size: dict[int, np.ndarray] = {}
    for size in {len(r["e"]) for r in sample}:
        by_size[size] = _unit([r["e"] for r in sample if len(r["e"]) == size])

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            cell = []
            for lo in range(0, b.num_rows, 1024):
                part = b.column(0).slice(lo, 1024).to_pylist()
                size = np.array([len(v) for v in part])
                where = np.zeros(len(part), np.int64)
                for s in np.unique(size):
                    if s in by_size:
                        own = np.flatnonzero(size == s)
                        where[own] = (_unit([part[k] for k in own]) @ by_size[s].T).argmax(1)
                cell.append(where)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell) if cell else [], pa.int64()), *b.columns], ["cell", "e", "id", "mult"])

    placed = in_arrow(classes, assign, "cell long, e array<double>, id long, mult long").withColumn("size", F.size("e"))
    placed = settle(placed)
    loads = placed.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = placed.join(loads, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def plant(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def grown() -> pa.RecordBatch:
            ids, mult = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            tree = CoverTree(ids, mult, np.array([h[2] for h in held], np.float64), params.radii)
            centre = tree.x.mean(0)
            centre = centre / max(float(np.linalg.norm(centre)), 1e-12)
            radius = float(_distance(tree.x @ centre).max())
            return pa.RecordBatch.from_arrays([pa.array([unit[0]], pa.int32()), pa.array([unit[1]], pa.int64()), pa.array([int(ids.min())]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([tree.dump()], pa.binary())], ["size", "cell", "node", "centre", "radius", "tree"])

        for b in source:
            for size, cell, at, i, m, e in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (size, cell, at) != unit:
                    if held:
                        yield grown()
                    unit, held = (size, cell, at), []
                held.append((i, m, e))
        if held:
            yield grown()

    units = dealt.select("size", "cell", "block", "id", "mult", "e").repartition("size", "cell", "block").sortWithinPartitions("size", "cell", "block", "id")
    trees = settle(in_arrow(units, plant, "size int, cell long, node long, centre array<double>, radius double, tree binary"))
    tops = trees.select("size", "cell", "node", "centre", "radius").orderBy("size", "cell", "node").collect()  # at most about most_blocks + most_centres rows
    band = {t["node"]: k // params.tile for k, t in enumerate(tops)}  # blocks of one cell stand together
    sizes, nodes = np.array([t["size"] for t in tops]), np.array([t["node"] for t in tops], np.int64)
    balls = {int(s): (np.array([t["centre"] for t in tops if t["size"] == s]), np.array([t["radius"] for t in tops if t["size"] == s])) for s in np.unique(sizes)}
    reach, cosine = params.reach, params.cosine

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for size, node, centre, radius in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                xs, rs = balls[size]
                near = (_distance(xs @ np.array(centre)) <= rs + radius + reach + _EPS) & (nodes[sizes == size] >= node)
                other = nodes[sizes == size][near]
                one, two = np.full(len(other), band[node], np.int64), np.array([band[x] for x in other.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array([node] * len(other), pa.int64()), pa.array(other)], ["i", "j", "a", "b"])

    def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees of a tile come before its pairs."""
        unit, grove = None, {}
        for b in source:
            for k in range(b.num_rows):
                i, j, node, other = (b.column(c)[k].as_py() for c in range(4))
                if (i, j) != unit:
                    unit, grove = (i, j), {}
                if other is None:
                    grove[node] = CoverTree.load(b.column(4)[k].as_py())
                    continue
                one, two = grove[node], grove[other]
                left, right, edges = dual(one, two, cosine)
                for ids, count in [(one.ids, left)] if two is one else [(one.ids, left), (two.ids, right)]:
                    has = count > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.nulls(int(has.sum()), pa.int64()), pa.array(count[has])], ["a", "b", "n"])
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64()), pa.nulls(len(edges), pa.int64())], ["a", "b", "n"])

    # pairs of blocks are walked tile by tile, so that a tree is sent once a tile, not once a pair
    pairs = settle(in_arrow(trees.select("size", "node", "centre", "radius").repartition("node"), meet, "i long, j long, a long, b long"))
    asked = pairs.select("i", "j", F.col("a").alias("node")).union(pairs.select("i", "j", F.col("b").alias("node"))).distinct()
    sent = asked.join(trees.select("node", "tree"), "node").select("i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "tree")
    dealt = sent.union(pairs.select("i", "j", "a", "b", F.lit(None).cast("binary").alias("tree")))
    met = dealt.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull(), "a", "b")
    walked = settle(in_arrow(met, walk, "a long, b long, n long"))
    counts = walked.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("id"), "n")
    found = components(walked.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "component")
    judged = classes.join(counts, "id", "left").join(found, "id", "left").select("e", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    some = settle(join_anew(read.filter("e IS NOT NULL"), judged, "e").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component"))
    low = some.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = join_anew(some, low, "component").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = read.filter("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
