"""Figures over logged turns and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.models import PRICES, VERDICTS


def price_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, input_per_1m double, output_per_1m double")


def with_cost(turns: DataFrame) -> DataFrame:
    """Cost of each turn's own call; unknown models cost nothing.  The price list is a fixed table of four rows."""
    prices = F.broadcast(price_table(turns.sparkSession))
    cost = (F.col("prompt_tokens") * F.col("input_per_1m") + F.col("completion_tokens") * F.col("output_per_1m")) / F.lit(1e6)
    return turns.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("input_per_1m", "output_per_1m")


def overview(turns: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    means = {"avg_latency": "response_time", "avg_tokens": "total_tokens", "avg_prompt_tokens": "prompt_tokens", "avg_completion_tokens": "completion_tokens"}
    return turns.agg(F.count(F.lit(1)).alias("n_conversations"), zero(F.sum("cost")).alias("total_cost"), *(zero(F.avg(c)).alias(n) for n, c in means.items()))


def timeseries(turns: DataFrame) -> DataFrame:
    """A row for each turn, in order of insertion, which is that of the ids."""
    return turns.orderBy("id").select("id", "timestamp", F.col("cost").cast("double"), F.col("response_time").cast("double"), "total_tokens", "prompt_tokens", "completion_tokens")


def judge_distribution(feedback: DataFrame) -> DataFrame:
    """Counts of the verdicts that were given, every class in its fixed order, zero where none was."""
    given = feedback.filter((F.col("source") == "judge") & F.col("relevance").isNotNull()).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))
    classes = feedback.sparkSession.createDataFrame([(k, v) for k, v in enumerate(reversed(VERDICTS))], "place int, relevance string")
    return classes.join(given, "relevance", "left").select("place", "relevance", F.coalesce("n", F.lit(0)).alias("n"))


def thumb(score: Column) -> Column:
    return F.when(score > 0, "up").when(score < 0, "down").otherwise("neutral")


def sign(thumb_up: Column) -> Column:
    """Score of a thumb: 1 for one up (true), -1 for any other."""
    return F.when(thumb_up, 1).otherwise(-1)


def percent(share: Column) -> Column:
    """A share as a percentage of one place, such as 81.3%."""
    return F.format_string("%.1f%%", share * 100)


def user_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("source") == "user").groupBy(thumb(F.col("score")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def long_tokens(turns: DataFrame, key: str = "id") -> DataFrame:
    return turns.select(key, "prompt_tokens", "completion_tokens").unpivot([key], ["prompt_tokens", "completion_tokens"], "kind", "tokens")


def new_feedback(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """One row for each conversation that has none yet: the earliest."""
    first = incoming.groupBy("conversation_id").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "conversation_id"]), F.struct("timestamp", "id")).alias("f"))
    return first.select("conversation_id", "f.*").join(saved.select("conversation_id").distinct(), "conversation_id", "left_anti")


def caption(model: Column, tokens: Column, seconds: Column, cost: Column) -> Column:
    return F.format_string("%s · %d tokens · %.1fs · $%.5f", model, tokens.cast("long"), seconds, cost)
