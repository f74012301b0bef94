"""The incremental jobs as batches and streams; the streaming forms are extensions, as the batch forms suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.models import OFFLINE, Models, embed
from siltstone.sources.schemas import SCHEMAS
from siltstone.sources.snapshots import Snapshot, SnapshotTable


def embed_missing(rows: DataFrame, vectors: str, models: Models = OFFLINE, batch: str | None = None) -> Snapshot:
    """Embed `rows` (id, text) that have no vector yet; each id gets one, whatever runs at once or again.

    Rows that could not be embedded are left for the next run.
    """
    table = SnapshotTable(rows.sparkSession, vectors)
    return table.append_once(lambda todo: embed(todo.select("id", "text"), models).filter("error IS NULL").select("id", "vector"), rows, "id", batch)


def embedded(spark: SparkSession, vectors: str) -> DataFrame:
    """id and vector of what has been embedded."""
    return SnapshotTable(spark, vectors).read()


def embed_arrivals(spark: SparkSession, chunks: str, vectors: str, checkpoint: str, models: Models = OFFLINE) -> StreamingQuery:
    """Embed chunk files that have come since the last run, then stop; chunks with a vector are left out."""
    source = spark.readStream.schema(SCHEMAS["chunks"]).parquet(chunks)
    store = lambda rows, number: embed_missing(rows, vectors, models, f"{checkpoint}#{number}")
    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(store).start()


def one_feedback_each(feedback: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first feedback of each conversation within the watermark."""
    return feedback.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["conversation_id"])


def turn_rates(turns: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns, cost and latency by event-time window."""
    windows = turns.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.avg("response_time").alias("latency")).select("w.start", "w.end", "n", "cost", "latency")
