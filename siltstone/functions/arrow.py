"""Column functions over pandas series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_DEFAULT_BYTES = 64 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Have Python workers get batches of 8 MB, where the session has not set another size.

    What a worker makes of a batch is a small multiple of it, so its memory
    doesn't grow with partitions that hold more than that.
    """
    conf = (spark or SparkSession.active()).conf
    if conf.get(_BATCH, str(_DEFAULT_BYTES)).rstrip("b") == str(_DEFAULT_BYTES):
        conf.set(_BATCH, str(_BATCH_BYTES))


def series(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function of series a function of columns; the UDF is made when it is used, as a session is needed for that."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def column(*columns: Column | str) -> Column:
            small_batches()
            return F.pandas_udf(f, kind)(*columns)

        column.__doc__ = f.__doc__
        return column

    return wrap
