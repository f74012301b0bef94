"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.arrow import small_batches
from siltstone.sources.io import forget, mark, passing, settle, shared_dir

__all__ = ["bounded_sample", "fold", "forget", "fresh", "in_arrow", "join_anew", "mark", "passing", "settle", "shared_dir", "table", "tidy", "unit_hash"]


def tidy() -> None:
    """Hand memory that Arrow's pool and the allocator hold back to the system, for workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """mapInArrow in batches of 8 MB, where the session has not set another size, and with memory given back after each partition."""

    def whole(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(source)
        tidy()

    small_batches(df.sparkSession)
    return df.mapInArrow(whole, schema)


def join_anew(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that shuffles both sides for itself, also where one is an aggregate by the same keys and so lies there already.

    Only then can a hot key's rows be split over tasks.  A hash of the keys as one
    more key is what has Spark deal both sides anew.
    """
    deal = F.xxhash64(*keys)
    return left.withColumn("_deal", deal).join(right.withColumn("_deal", deal), [*keys, "_deal"]).drop("_deal")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def unit_hash(column: str, seed: int):
    """A value in [0, 1) that depends on the id alone."""
    return (F.xxhash64(F.col(column), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def bounded_sample(df: DataFrame, key: str, label: str, per_label: int, seed: int) -> DataFrame:
    """About `per_label` rows of each label, chosen by a hash of the key.

    Labels are counted first (one small aggregate); each label then keeps the
    share of its rows that gives `per_label` on average.  The label set must be
    small: the counts are a per-label table, not a per-row one.
    """
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("_n") * unit_hash(key, seed) < per_label
    return df.join(F.broadcast(counts), F.col(label) == F.col("_label")).filter(keep).drop("_label", "_n")
