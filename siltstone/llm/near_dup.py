"""Near-duplicate documents by b-bit MinHash.

Each document's shingle set gives minima under many hash functions.  Groups of
minima (bands) name buckets in which candidates meet; the low bits of all minima
are packed into a few longs, and for a candidate pair the share of equal low
bits, corrected for chance collisions, estimates the similarity by bit counts.
Pairs whose estimate is within reach of the threshold are confirmed on full
sets, and links give components.

Documents with equal sets are one class from the start.  A bucket yields only a
spanning forest of its candidate pairs, never the pairs themselves; the forests'
components are families, and no link leaves a family.  Families are compared on
full sets, block by block, and again yield spanning forests, now of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow, join_anew, settle
from siltstone.llm.graph import components
from siltstone.llm.words import batches, hash_words, mix


@dataclass(frozen=True)
class NearDupParams:
    #: Words of a shingle, and the threshold on intersection / union in hundredths.
    shingle: int = 5
    percent: int = 80
    #: bands * rows minima; a pair of similarity 0.8 shares a band with probability 1 - 5e-8.
    bands: int = 32
    rows: int = 4
    #: Low bits kept of each minimum.
    bits: int = 4
    #: Standard deviations of the estimate by which a pair may fall short before it is dropped unconfirmed.
    slack: float = 4.0
    #: Rows of a block when a large bucket is compared block by block.
    block: int = 512

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return self.minima * self.bits // 64

    @property
    def most_unequal(self) -> int:
        """Unequal minima, of their low bits, up to which a pair is confirmed."""
        chance, want = 2.0**-self.bits, self.percent / 100
        equal = chance + (1 - chance) * want
        return int(self.minima * (1 - equal) + self.slack * (self.minima * equal * (1 - equal)) ** 0.5)


_RNG = np.random.default_rng(987654321)
_ODD = (_RNG.integers(0, 2**32, 1024, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_STEP = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z in lower case, a short text whole, none for no words."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in batches(raw):
        words, _, cut, _ = hash_words(raw[lo:hi])
        runs = mix(reduce(np.add, (words[j : len(words) - width + 1 + j] * _STEP[j] for j in range(width)))) if len(words) >= width else words[:0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(words[:0])
    return out


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of the set under each of n hash functions."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 1024):
        x, y = low[lo : lo + 1024], high[lo : lo + 1024]
        np.minimum(best, ((x[None, :] * _ODD[:n, None]) ^ y[None, :]).min(1), out=best)
    return best


def sketch(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set; null if empty), bands, bits."""
    n, rows, per_long = params.minima, params.rows, 64 // params.bits
    places = (np.arange(per_long, dtype=np.uint64) * np.uint64(params.bits))[None, :]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                size, key, bands, bits = [], [], [], []
                for s in shingle_sets(part.column(2).to_pylist(), params.shingle):
                    size.append(len(s))
                    if not len(s):
                        key.append(None)
                        bands.append([])
                        bits.append([])
                        continue
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    low = minima(s, n)
                    group = mix((low.reshape(-1, rows).astype(np.uint64) * _STEP[:rows]).sum(1) + np.arange(len(low) // rows, dtype=np.uint64))
                    bands.append(group.view(np.int64))
                    bits.append(((low.astype(np.uint64) & np.uint64((1 << params.bits) - 1)).reshape(-1, per_long) << places).sum(1).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)], ["doc_id", "text_key", "n_shingles", "set_key", "bands", "bits"])

    return in_arrow(docs.select("doc_id", "text_key", "text"), run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def _placed(members: DataFrame, unit: str, block: int, weight: str = "") -> DataFrame:
    """Rows of each unit that has two rows or more, with a block of their own of `blocks`.

    A block has about `block` rows, and about a million of `weight` if that is given.
    """
    load = F.sum(weight) if weight else F.lit(0)
    sizes = members.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), load.alias("load")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("load") / 1e6)).cast("int")
    return join_anew(members, sizes.select(unit, blocks.alias("blocks")), unit).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _linked(members: DataFrame, unit: str, columns: tuple[str, ...], block: int, weight: str, near: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Edges (a, b) that connect what the pairs within each unit connect; `near` says which rows of two sides are pairs.

    Each block is compared with itself first, and its rows are named after the
    smallest id they reach in it.  Blocks then meet in pairs, which yield a
    forest of those names: where a block hangs together, a single edge, so that
    edges don't multiply with the blocks of a large unit.
    """

    def inside(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_unit(source):
            rows = np.arange(own.num_rows)
            ids, many = own.column("id").to_numpy(), own.column("blocks").to_numpy() > 1
            i, j = np.nonzero(near(own, rows, rows) & ~np.tri(len(rows), dtype=bool)) if len(rows) > 1 else (rows[:0], rows[:0])
            label = _labels(ids, i, j)
            keep = np.flatnonzero(many | (label != ids))
            if len(keep):
                yield pa.RecordBatch.from_arrays([own.column("unit").combine_chunks().take(pa.array(keep)), pa.array(ids[keep]), pa.array(label[keep]), *(pa.array(own.column(c).to_numpy()[keep]) for c in ("block", "blocks"))], ["unit", "id", "label", "block", "blocks"])

    def across(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, both in _by_unit(source):
            block = both.column("block").to_numpy()
            one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
            if not len(two):
                continue
            names, at = np.unique(both.column("label").to_numpy(), return_inverse=True)
            i, j = np.nonzero(near(both, one, two))
            a, b = at[one[i]], at[two[j]]
            keep = _forest(len(names), a, b)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(names[a[keep]]), pa.array(names[b[keep]])], ["a", "b"])

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("unit", "i", "j", "block", "id", *more, *columns).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")

    own = _placed(members, unit, block, weight).withColumns({"unit": F.col(unit), "i": F.col("block"), "j": F.col("block")})
    named = settle(in_arrow(dealt(own, "blocks"), inside, "unit long, id long, label long, block int, blocks int"))
    edges = named.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    large = named.filter("blocks > 1")
    if large.isEmpty():
        return edges.distinct()
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> block)"))
    pairs = members.withColumnRenamed(unit, "unit").join(large, ["unit", "id"]).withColumn("other", other)
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return edges.union(in_arrow(dealt(pairs, "label"), across, "a long, b long")).distinct()


def _by_unit(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Tables of one unit each, from rows sorted by unit, i, j; and whether it pairs two blocks."""
    rest: pa.Table | None = None
    for b in _with_end(source):
        whole = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if whole is None or not whole.num_rows:
            continue
        unit = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("unit", "i", "j")], 1)
        cuts = np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), *([len(unit)] if b is None else [])]
        rest = None if b is None else whole.slice(edges[-1])
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield bool(unit[lo, 1] != unit[lo, 2]), whole.slice(lo, hi - lo)


def _with_end(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from source
    yield None


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of pairs (a, b) that make a spanning forest of n nodes."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep, left = [], n
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            keep.append(k)
            left -= 1
            if left == 1:
                break
    return keep


def _labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over pairs (a, b) of rows."""
    label = ids.copy()
    keep = _forest(len(ids), a, b)
    a, b = a[keep], b[keep]
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    return label


def likely(members: DataFrame, params: NearDupParams) -> DataFrame:
    """Edges (a, b) that connect each bucket's pairs whose estimated similarity is within reach.

    `members` has bucket, id, bits (the packed signature).  The estimate is the
    share of equal low bits, corrected for chance, and so a bound on the count
    of unequal ones.  A task holds two blocks of a bucket at most.
    """
    limit, bits = params.most_unequal, params.bits
    ones = np.uint64(sum(1 << i for i in range(0, 64, bits)))

    def near(unit: pa.Table, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        sig = np.array(unit.column("bits").combine_chunks().flatten()).astype(np.int64).view(np.uint64).reshape(-1, params.longs)
        unequal = np.zeros((len(one), len(two)), np.int32)
        for i in range(params.longs):
            z = sig[one, None, i] ^ sig[None, two, i]
            k = 1
            while k < bits:
                z |= z >> np.uint64(k)
                k *= 2
            unequal += np.bitwise_count(z & ones)
        return unequal <= limit

    return _linked(members, "bucket", ("bits",), params.block, "", near)


def confirmed(families: DataFrame, params: NearDupParams) -> DataFrame:
    """Edges (a, b) that connect each family's links, judged on full sets.

    `families` has family, id, n_shingles, shingles.  The intersections of one row with all
    of the other block come from that block's postings at once.
    """

    def near(unit: pa.Table, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in unit.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        everything = np.concatenate([sets[k] for k in two])
        order = np.argsort(everything, kind="stable")
        values, owner = everything[order], np.repeat(np.arange(len(two)), size[two])[order]
        linked = np.zeros((len(one), len(two)), bool)
        for r, k in enumerate(one):
            lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
            run_length = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(run_length)[:-1])), run_length) + np.arange(run_length.sum())
            both = np.bincount(owner[at], minlength=len(two))
            linked[r] = 100 * both >= params.percent * (size[k] + size[two] - both)
        return linked

    return _linked(families, "family", ("shingles",), params.block, "n_shingles", near)


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept marks it.
    Null, empty and wordless texts have no shingles, no links, and stay alone.
    Rows that repeat a doc_id or a text fall into one component, also where one
    doc_id has several texts.  Rows with a null doc_id link with nothing and are
    kept, with a null component.  Whole texts of any length are read.  An empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    drawn = settle(sketch(docs, params))
    usable = drawn.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # a class is one set, by a number of its own; one of its rows lends it a text
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "row.doc_id", "row.text_key", "bands", "bits"))

    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("bucket")
    members = settle(join_anew(rows, shared, "bucket").join(classes.select("id", "bits"), "id"))
    families = components(likely(members, params)).select(F.col("node").alias("id"), F.col("component").alias("family"))
    lent = families.join(classes.select("id", "doc_id", "text_key"), "id")

    def collect(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column(2).to_pylist(), params.shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "family", "n_shingles", "shingles"])

    texts = docs.join(lent, ["doc_id", "text_key"]).select("id", "family", "text").distinct()
    sets = settle(in_arrow(texts, collect, "id long, family long, n_shingles long, shingles binary"))
    several = usable.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).filter("least <> most").select("doc_id")
    held = usable.select("doc_id", "set_key").join(several, "doc_id").distinct().join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    same_id = join_anew(held, held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    found = components(confirmed(sets, params).union(same_id).filter("a <> b").distinct())
    joined = settle(classes.select("id", "doc_id", "set_key").join(found.select(F.col("node").alias("id"), "component"), "id", "left"))
    linked = joined.filter("component IS NOT NULL")
    named = join_anew(linked, linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("set_key", "component_id")
    of_class = named.union(joined.filter("component IS NULL").select("set_key", F.col("doc_id").alias("component_id")))
    out = join_anew(usable.select("doc_id", "n_shingles", "set_key"), of_class, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = drawn.filter("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
