"""Vector columns, and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _scaled(a: Column) -> Column:
    """Divided by the largest component, so that no square underflows or overflows; zero stays zero."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.transform(a, lambda x: F.when(most > 0, x / most).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|), whatever the lengths; null for a zero vector."""
    a, b = _scaled(a), _scaled(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def usable(c: Column) -> Column:
    """Neither null, nor empty, nor zero, nor with null or non-finite components."""
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (id, vector) packed, `size` or so to a row, as ids and unit vectors in bytes."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            by_dim: dict[int, list[int]] = {}
            vectors = b.column(1).to_pylist()
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            ids = b.column(0).to_numpy()
            for dim, own in by_dim.items():
                for lo in range(0, len(own), size):
                    part = own[lo : lo + size]
                    x = np.array([vectors[k] for k in part], np.float64)
                    x /= np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components are lost
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["dim", f"{prefix}_ids", f"{prefix}_x"])

    return rows.mapInArrow(pack, f"dim int, {prefix}_ids binary, {prefix}_x binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = False, places: int = 9) -> DataFrame:
    """qid, rank, id and distance of the k nearest `vectors` (id, vector) to each of `queries` (qid, vector).

    Exact: blocks of queries meet blocks of vectors in one matrix product each,
    keep k a query and block, and a window keeps k of those.  Vector blocks are
    dealt over as many parts as a shuffle has, and query blocks copied to each,
    so that no part holds all vectors, broadcast or not.  Distances are
    rounded to `places` before ranking, ties go to the smaller id, so a rank
    does not depend on the order of a sum.
    """

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for dim, qi, qx, vi, vx in zip(*(b.column(c).to_pylist() for c in ("dim", "q_ids", "q_x", "v_ids", "v_x")), strict=True):
                qid, vid = np.frombuffer(qi, "<i8"), np.frombuffer(vi, "<i8")
                d = np.round(1 - np.frombuffer(qx, "<f8").reshape(-1, dim) @ np.frombuffer(vx, "<f8").reshape(-1, dim).T, places)
                if skip_self:
                    d[qid[:, None] == vid[None]] = np.inf
                n = min(k, len(vid))
                bar = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                r, c = np.nonzero((d <= bar) & np.isfinite(d))
                order = np.lexsort((vid[c], d[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(vid[c]), pa.array(d[r, c])], ["qid", "id", "distance"])

    q = _blocks(queries.select(F.col("qid").cast("long"), "vector").filter(usable(F.col("vector"))), 512, "q")
    v = _blocks(vectors.select(F.col("id").cast("long"), "vector").filter(usable(F.col("vector"))), 4096, "v")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = v.withColumn("part", F.pmod(F.xxhash64("v_ids"), F.lit(parts)).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = v.join(q, ["dim", "part"]).mapInArrow(search, "qid long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")
