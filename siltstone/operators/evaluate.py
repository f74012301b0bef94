"""Retrieval and answer quality."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.models import UNPARSEABLE, VERDICTS
from siltstone.operators.search import POOL, TOP_K, best, rrf, terms, vector
from siltstone.operators.textindex import index_of, with_postings
from siltstone.sources.io import settle

SAMPLE, SEED = 150, 42


def reciprocal_ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """qid and 1 / rank of the first hit whose target is the question's; 0 without one, also for questions without hits."""
    first = hits.join(questions.select("qid", F.col("target").alias("_target")), "qid").filter(F.col("target") == F.col("_target")).groupBy("qid").agg(F.min("rank").alias("first"))
    return questions.select("qid").join(first, "qid", "left").select("qid", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def hit_rate_mrr(ranks: DataFrame, *by: str) -> DataFrame:
    return ranks.groupBy(*by).agg(F.avg((F.col("rr") > 0).cast("double")).alias("hit_rate"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n_questions"))


def timed(make: Callable[[], DataFrame], *by: str) -> tuple[DataFrame, float]:
    """A table, written out (see `settle`), and the seconds that took."""
    began = time.perf_counter()
    return settle(make(), *by), time.perf_counter() - began


def evaluate(chunks: DataFrame, questions: DataFrame, strategies: tuple[str, ...], methods: tuple[str, ...] = ("keyword", "vector", "hybrid"), k: int = TOP_K) -> DataFrame:
    """strategy, method, hit_rate, mrr, n_questions and seconds for every combination, all questions at once; a hit is the question's section.

    Both rankers' pools are made once a strategy: their first k are the keyword
    and the vector results, and the fusion of both is the hybrid one.  `seconds`
    is the time from start to end of a combination's own searches; those that
    the hybrid ones share with the rankers count with the rankers, so that all
    seconds together are within the time of the whole.  The chunks of all
    strategies are made in one pass, and the questions' lexemes looked up in
    them there; what is written of a chunk is its vector and their positions,
    not its text.  Each strategy's keyword search counts an equal part of that.
    """
    parts = []
    questions = settle(questions)
    each = terms(questions)
    cut, pass_seconds = timed(lambda: with_postings(chunks.filter(F.col("strategy").isin(*strategies)).select("id", "strategy", "section_id", "vector", "text"), each), "strategy")
    for strategy in strategies:
        own = cut.filter(F.col("strategy") == strategy)
        search = {"keyword": lambda own=own: best(questions, each, index_of(own, each), POOL), "vector": lambda own=own: vector(own, questions.select("qid", "vector"), POOL)}
        pools = {m: timed(f) for m, f in search.items() if m in methods or "hybrid" in methods}
        pools = {m: (found, seconds + (pass_seconds / len(strategies) if m == "keyword" else 0)) for m, (found, seconds) in pools.items()}
        ids = reduce(DataFrame.union, (found.select("id") for found, _ in pools.values())).distinct()
        targets = settle(own.select("id", F.col("section_id").alias("target")).join(settle(ids), "id", "left_semi"))
        for method in methods:
            if method == "hybrid":
                found, seconds = timed(lambda pools=pools: rrf(pools["keyword"][0], pools["vector"][0], k))
            else:
                found, seconds = pools[method][0].filter(F.col("rank") <= k), pools[method][1]
            hits = found.select("qid", "rank", "id").join(targets, "id")
            parts.append(reciprocal_ranks(questions, hits).select(F.lit(strategy).alias("strategy"), F.lit(method).alias("method"), F.lit(seconds).alias("seconds"), "rr"))
    return hit_rate_mrr(reduce(DataFrame.unionByName, parts), "strategy", "method", "seconds").select("strategy", "method", "hit_rate", "mrr", "n_questions", "seconds")


def best_first(results: DataFrame) -> DataFrame:
    """Combinations by quality, with the label that names each."""
    named = results.withColumn("label", F.concat_ws(" · ", "strategy", "method"))
    return named.orderBy(F.desc("mrr"), F.desc("hit_rate"), "strategy", "method")


def summarise(records: DataFrame) -> DataFrame:
    """Counts by verdict (zeros too), rates and means of judged `records` (config, relevance, answer_tokens, latency_seconds)."""
    count = lambda v: F.count_if(F.col("relevance") == v)
    share = lambda v: F.coalesce(F.try_divide(count(v).cast("double"), F.count(F.lit(1))), F.lit(0.0))
    counts = [count(v).alias(v.lower()) for v in (*VERDICTS, UNPARSEABLE)]
    return records.groupBy("config").agg(F.count(F.lit(1)).alias("sample_size"), *counts, share("NON_RELEVANT").alias("bad_rate"), share("RELEVANT").alias("relevant_rate"), F.bround(F.avg("answer_tokens"), 1).alias("avg_answer_tokens"), F.bround(F.avg("latency_seconds"), 2).alias("avg_latency_seconds"))


def winner(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("relevant_rate"), "bad_rate", "config").limit(1)


def fixed_sample(rows: DataFrame, key: Column, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """n rows, the same for every run and partitioning: those whose keyed digest is smallest."""
    return rows.withColumn("_order", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))).orderBy("_order", key).limit(n).drop("_order")
