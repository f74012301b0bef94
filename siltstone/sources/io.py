"""Readers and writers: immutable snapshots where the original system updates rows in place."""

from __future__ import annotations

import tempfile
import threading
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVALUATION = "top_k int, n_questions int, results array<struct<strategy:string,method:string,hit_rate:double,mrr:double>>"
FACTSHEETS = "array<struct<slug:string,link:string,title:struct<rendered:string>,content:struct<rendered:string>>>"
UPDATED = ("title", "author", "raw_text", "fetched_at")


_own_dir: str | None = None
_of_thread = threading.local()


def _made() -> list[str]:
    """Folders that this thread has made: a query that runs in another thread is none of its business."""
    if not hasattr(_of_thread, "made"):
        _of_thread.made = []
    return _of_thread.made


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder.

    The folder is read from `spark.checkpoint.dir`.  Without that setting a
    session on one machine (tests) gets a temporary folder, any other an error:
    executors don't see each other's disks.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        base = _own_dir
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder that now exists deleted when the application ends, or by `forget`."""
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    _made().append(path)


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame, *by: str) -> DataFrame:
    """Write a table into the shared folder, in a folder for each value of the columns `by`, and read it back.

    Cuts the lineage, so that a lost executor never sends work back past this
    point, and lets several readers share what was computed once.
    """
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in this thread's time, for `forget`."""
    return len(_made())


def forget(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the folders this thread made since `since`, but for the last `keep`; only for tables that nothing will read again."""
    made = _made()
    for path in made[since : len(made) - keep]:
        folder, fs = _folder(spark, path)
        fs.delete(folder, True)
    del made[since : len(made) - keep]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out anew if it has fewer partitions than there are cores (a file of one row group is one task).

    For plain reads: their partitions are known without running anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row for each whole text file: source_ref, raw_text; line ends are left as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_ref"), F.col("value").alias("raw_text"))


def read_factsheets(spark: SparkSession, path: str) -> DataFrame:
    """Payloads are arrays of posts, of which the first counts; a file without one gives no row."""
    posts = spark.read.text(path, wholetext=True).select(F.get(F.from_json("value", FACTSHEETS), F.lit(0)).alias("p")).filter("p IS NOT NULL")
    return posts.select(F.col("p.slug").alias("slug"), F.col("p.link").alias("source_ref"), F.col("p.title.rendered").alias("title"), F.col("p.content.rendered").alias("html"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", updated: tuple[str, ...] = UPDATED) -> DataFrame:
    """Rows of both; where a key is in both, only `updated` columns come from `incoming`."""
    new = incoming.select(*(F.col(c).alias(f"_new_{c}") for c in incoming.columns))
    both = existing.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    fresh = F.col(f"_new_{key}").isNotNull()
    take = lambda c: fresh if c in updated else F.col("_old").isNull()
    return both.select(*(F.when(take(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in incoming.columns else F.col(c) for c in existing.columns))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet: a second run over finished work has none."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that `df` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dense_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Ids 1, 2, ... in key order, without one task for all rows: sorted parts, then an offset for each part.

    The keys must be unique.  They alone are dealt into parts, numbered within
    each and written once, so that the parts' sizes and the rows' numbers come
    from the same parts; the other columns join the ids by key.
    """
    keys = df.select(*order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = settle(keys.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    counts = placed.groupBy("_part").agg(F.max("_place").cast("long").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ids = placed.join(F.broadcast(before), "_part").select(*(F.col(c).alias(f"_key_{c}") for c in order), (F.col("_place") + F.col("_before")).alias(name))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in order))
    return df.join(ids, same).drop(*(f"_key_{c}" for c in order))


def next_ids(existing: DataFrame, incoming: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """`incoming` with ids that go on after the largest of `existing`, in the given order.

    For one writer at a time; several reserve theirs by SnapshotTable.append_with_ids.
    """
    last = existing.agg(F.coalesce(F.max(name), F.lit(0)).cast("long")).first()[0]
    return dense_ids(incoming.drop(name), *order, name=name).withColumn(name, F.col(name) + last)


def write_evaluation(results: DataFrame, top_k: int, n_questions: int, path: str) -> None:
    """The evaluation as one JSON object, figures to four places, best first."""
    row = F.struct("strategy", "method", F.bround("hit_rate", 4).alias("hit_rate"), F.bround("mrr", 4).alias("mrr"))
    packed = results.agg(F.sort_array(F.collect_list(F.struct(F.col("mrr").alias("k"), F.col("hit_rate").alias("h"), row.alias("r"))), False).alias("x"))
    packed.select(F.lit(top_k).alias("top_k"), F.lit(n_questions).alias("n_questions"), F.transform("x", lambda v: v["r"]).alias("results")).coalesce(1).write.mode("overwrite").json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written evaluation; none if there is no file.  Anything else that is wrong with it is an error."""
    try:
        found = spark.read.schema(EVALUATION).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], EVALUATION)
    return found.select(F.explode("results").alias("r")).select("r.*")


def source_list(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list of sources to fetch, such as book numbers with titles, or page slugs."""
    return spark.createDataFrame(rows, schema)


def write_comparison(records: DataFrame, summaries: DataFrame, seed: int, winner: str, path: str) -> None:
    """Answer comparison as one JSON object: seed, sample_size, winner, and by configuration its summary and its judged records.

    The records are the fixed-size sample that was judged, so one row holds them.
    """
    rest = lambda df: [c for c in df.columns if c != "config"]
    sums = summaries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", F.struct(*rest(summaries)).alias("s"))))).alias("configs"), F.max("sample_size").alias("sample_size"))
    each = records.groupBy("config").agg(F.sort_array(F.collect_list(F.struct(*rest(records)))).alias("r"))
    rows = each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", "r")))).alias("records"))
    both = sums.select(F.lit(seed).alias("seed"), "sample_size", F.lit(winner).alias("winner"), "configs", F.lit(1).alias("one")).join(rows.withColumn("one", F.lit(1)), "one", "left")
    both.drop("one").coalesce(1).write.mode("overwrite").json(path)
