"""Whitened embeddings from a bit-sliced scatter.

Entries become integers.  A task packs each dimension's bits, less the block's
smallest value, across rows into words, one bit plane a power of two; the
cross-product of two dimensions is then the sum of the popcounts of ANDed
planes, weighted by their powers, and is exact.  The tasks' cross-products are
summed as decimals, centred as integers on the driver, and only then made
doubles for `eigh`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow, settle

_EXACT = pa.decimal128(38, 0)
_LARGEST = 10**38


@dataclass(frozen=True)
class WhitenParams:
    components: int = 8
    #: An entry c becomes floor(scale * c) + shift; scaled entries beyond `most` count as `most`.
    scale: int = 1024
    shift: int = 100_000
    most: int = 1 << 40
    #: Rows whose bit planes are packed together, and dimensions that are met at a time.
    block: int = 8192
    tile: int = 64


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, sums of each dimension, the largest eigenvalues (falling) with their unit vectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        """Components whose variance is not rounding error."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0) if len(self.values) else self.values > 0


def quantised(vectors: DataFrame, params: WhitenParams) -> DataFrame:
    """vec_id and x (array of long) of vectors that are not null and hold neither null nor non-finite entries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    most = float(params.most)
    whole = lambda c: F.floor(F.greatest(F.least(c * params.scale, F.lit(most)), F.lit(-most))).cast("long") + params.shift
    return rows.filter(finite & (F.size("e") > 0)).select("vec_id", F.transform("e", whole).alias("x"))


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (a row of words each), and the dimension and power of each, of a matrix of integers from 0 up."""
    rows, words = len(y), -(-len(y) // 64)
    planes, owner, power = [], [], []
    for i in range(y.shape[1]):
        column = y[:, i].astype(np.uint64)
        for p in range(int(column.max()).bit_length()):
            bits = np.zeros(words * 64, np.uint8)
            bits[:rows] = (column >> np.uint64(p)) & np.uint64(1)
            planes.append(np.packbits(bits).view(np.uint64))
            owner.append(i)
            power.append(p)
    return np.array(planes, np.uint64).reshape(-1, words), np.array(owner, np.int64), np.array(power, np.int64)


def scatter(x: np.ndarray, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d x d) of the columns of an integer matrix, as Python integers."""
    n, d = x.shape
    low = [int(v) for v in x.min(0)]
    planes, owner, power = bit_planes(x - x.min(0))
    small = 2 * int(power.max(initial=0)) + 2 + n.bit_length() < 62
    weight = np.left_shift(np.int64(1), power) if small else np.array([1 << int(p) for p in power], object)
    kind = np.int64 if small else object
    crossed = np.zeros((d, d), kind)
    starts = np.searchsorted(owner, np.arange(0, d + tile, tile))
    for a in range(len(starts) - 1):
        for b in range(a, len(starts) - 1):
            one, two = slice(starts[a], starts[a + 1]), slice(starts[b], starts[b + 1])
            if one.start == one.stop or two.start == two.stop:
                continue
            counts = np.stack([np.bitwise_count(plane & planes[two]).sum(1, dtype=np.int64) for plane in planes[one]])
            weighed = counts.astype(kind) * weight[one, None] * weight[None, two]
            (mine, at), (theirs, to) = np.unique(owner[one], return_index=True), np.unique(owner[two], return_index=True)
            summed = np.add.reduceat(np.add.reduceat(weighed, at, axis=0), to, axis=1)
            crossed[np.ix_(mine, theirs)] = summed
            crossed[np.ix_(theirs, mine)] = summed.T
    moved = np.zeros(d, object)
    ones = np.bitwise_count(planes).sum(1, dtype=np.int64)
    for i, p, c in zip(owner.tolist(), power.tolist(), ones.tolist(), strict=True):
        moved[i] += c << p
    low = np.array(low, object)
    return moved + n * low, crossed.astype(object) + np.multiply.outer(low, moved) + np.multiply.outer(moved, low) + n * np.multiply.outer(low, low)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of each length of an array of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        yield own, flat[edges[own][:, None] + np.arange(d)]


def fit(vectors: DataFrame, params: WhitenParams = WhitenParams()) -> dict[int, Whitening]:
    """A fit for each length of vector.

    (d + 1)(d + 2) / 2 exact figures of each length come to the driver, which
    needs d * d doubles for `eigh` anyway; lengths are few, as each stands for a
    model.  Vectors never do.
    """

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in source:
            for _, x in _by_length(b.column(0)):
                for lo in range(0, len(x), params.block):
                    s, q = scatter(x[lo : lo + params.block], params.tile)
                    own = total.setdefault(x.shape[1], [0, 0, 0])
                    own[0] += min(params.block, len(x) - lo)
                    own[1], own[2] = own[1] + s, own[2] + q
        for d, (n, s, q) in total.items():
            i, j = np.triu_indices(d)
            values = [n, *s.tolist(), *q[i, j].tolist()]
            columns = [np.full(len(values), d), np.concatenate(([-1], np.arange(d), i)), np.concatenate((np.full(d + 1, -1), j))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([Decimal(v) for v in values], _EXACT)], ["size", "i", "j", "value"])

    parts = in_arrow(quantised(vectors, params).select("x"), part, "size int, i int, j int, value decimal(38,0)")
    found: dict[int, dict] = {}
    for r in parts.groupBy("size", "i", "j").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["value"])
    return {d: _solved(d, moments, params) for d, moments in found.items()}


def _solved(d: int, moments: dict[tuple[int, int], int], params: WhitenParams) -> Whitening:
    n, sums = moments[-1, -1], [moments[i, -1] for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * moments[i, j] - sums[i] * sums[j]) / (n * n)  # integers to the last step
    values, vectors = np.linalg.eigh(v)
    k = min(params.components, d)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    trace = sum(n * moments[i, i] - sums[i] * sums[i] for i in range(d)) / (n * n)
    return Whitening(n, sums, values, vectors * np.where(signs == 0, 1.0, signs), trace)


def project(x: np.ndarray, model: Whitening) -> tuple[list[int], np.ndarray]:
    """Exact squared deviations, times n squared, and whitened components of the rows of an integer matrix."""
    n, d = model.n, x.shape[1]
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    moved = n * x.astype(np.int64 if most < 1 << 62 else object) - np.array(model.sums, np.int64 if most < 1 << 62 else object)
    widest = int(np.abs(moved).max(initial=0))
    squared = moved if widest * widest * d < 1 << 62 else moved.astype(object)
    spread = np.where(model.alive, np.sqrt(np.where(model.alive, model.values, 1.0)), np.nan)
    return (squared * squared).sum(1).tolist(), (moved.astype(float) / n) @ model.vectors / spread


def whiten(vectors: DataFrame, models: dict[int, Whitening], params: WhitenParams = WhitenParams()) -> DataFrame:
    """vec_id, size, deviation and w (the whitened components) of every usable vector that has a fit of its length."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for own, x in _by_length(b.column(1)):
                if x.shape[1] not in models:
                    continue
                model = models[x.shape[1]]
                far, w = project(x, model)
                exact = pa.array([Decimal(v) if v < _LARGEST else None for v in far], _EXACT)
                flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # no variance: null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.full(len(x), x.shape[1]), pa.int32()), exact, lists], ["vec_id", "size", "deviation", "w"])

    return in_arrow(quantised(vectors, params), run, "vec_id long, size int, deviation decimal(38,0), w array<double>")


def identity_errors(whitened: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """For each length the largest absolute entry of the whitened rows' covariance less the identity; None without a component of any variance."""
    k = max((len(m.values) for m in models.values()), default=0)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    if not pairs:
        return {}
    at = lambda a: F.get("w", F.lit(a))
    aggregates = [F.abs(F.covar_pop(at(a), at(b)) - float(a == b)).alias(f"e{a}_{b}") for a, b in pairs]
    rows = whitened.groupBy("size").agg(*aggregates).collect()
    alive = {d: m.alive for d, m in models.items()}
    return {r["size"]: max((r[f"e{a}_{b}"] for a, b in pairs if b < len(alive[r["size"]]) and alive[r["size"]][a] and alive[r["size"]][b]), default=None) for r in rows}


def whitened_vectors(vectors: DataFrame, params: WhitenParams = WhitenParams()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each usable vector of `vectors` (vec_id, embedding) and component.

    Null vectors and those with a null or non-finite entry are dropped, and
    empty ones have no component.  Vectors of each length are a fit of their own.  Scaled
    entries beyond 2^40 count as 2^40.  A component without variance (one
    vector, equal vectors, or fewer than components) has whitened null and
    explained 0; identity_error covers the others.  Repeated rows count each
    and give equal rows, rows without a vec_id keep their null, equal
    eigenvalues share their space in an order that is the same for all rows;
    labels and other columns are ignored, and an empty table gives an empty
    result.  `deviation` is a decimal, null only from 10^38 on.
    """
    models = fit(vectors, params)
    rows = settle(whiten(vectors, models, params))
    errors = identity_errors(rows, models)
    told = [(d, m.n, [float(v / m.trace) if a else 0.0 for v, a in zip(m.values, m.alive, strict=True)], errors.get(d)) for d, m in models.items()]
    fits = vectors.sparkSession.createDataFrame(told, "size int, n long, share array<double>, identity_error double")
    each = rows.join(F.broadcast(fits), "size")  # a row for each length, of which the driver holds a fit
    flat = each.select("vec_id", "n", "deviation", "share", "identity_error", F.posexplode("w").alias("k", "whitened"))
    return flat.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("share", F.col("k")).alias("explained"), "identity_error")
