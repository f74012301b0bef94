"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, join_anew, mark, settle


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of `edges` (a, b: long).

    Alternates the large-star and small-star steps of Kiveris et al. until the
    edges are stars around their smallest nodes.  A node's neighbours are never
    gathered: each step is a minimum by key, which combines before the shuffle,
    and a join that can split a node of very many edges.  Every round is written
    out, so lineage stays short and a lost executor repeats one round at most.
    """
    spark = edges.sparkSession
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        since = mark() - 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_anew(both.filter("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = join_anew(large, down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(moved.union(down.select("a", F.col("m").alias("b"))).distinct())
        forget(spark, since, keep=1)
        # done when no node is both a centre and a leaf, and no leaf has two centres
        tops = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        centres = after.select(F.col("b").alias("a")).distinct()
        if tops.filter("n > 1").isEmpty() and tops.join(centres, "a", "left_semi").isEmpty():
            leaf = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaf.union(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = after
