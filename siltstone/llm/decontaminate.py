"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of consecutive words.  For full containment the
necessary prefix of a window, its words ordered by rarity in the corpus, is its
rarest word alone; documents meet windows on that word only.  The word's place
in the window fixes where the window would start, which must lie within the
document (length and position bounds), and the words there must be the window's
(exact containment).  Everything is built-in functions.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 10
    #: Windows up to which the benchmark's side is broadcast (about 300 bytes each); beyond, it is shuffled.
    broadcast_windows: int = 100_000


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    ascii_only = F.lower(text)
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(ascii_only)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """win (words) and items (sorted distinct item ids as text) of every distinct window of `items` (item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def prefixes(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """key (rarest word), place (0-based, of its first occurrence), win, items; rarity over all words of `docs` (w)."""
    vocabulary = windows.select(F.explode("win").alias("key")).distinct()
    counted = docs.select(F.explode("w").alias("key")).join(_side(vocabulary, small), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("win", "items", F.posexplode("win").alias("place", "key"))
    ranked = placed.join(_side(counted, small), "key", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("key"), F.col("place"))).alias("best"), F.first("items").alias("items"))
    return ranked.select(F.col("best.key").alias("key"), F.col("best.place").alias("place"), "win", "items")


def _hits(docs: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """row, start, len and items of every occurrence of a window."""
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.slice("w", start + 1, F.size("win")) == F.col("win")
    if small:  # the words stay in the scanned row: no candidate is copied or shuffled before it is verified
        found = docs.select("row", "n_words", "w", F.posexplode("w").alias("pos", "key")).join(F.broadcast(prefix), "key").filter(fits & same)
    else:
        met = docs.select("row", "n_words", F.posexplode("w").alias("pos", "key")).join(prefix, "key").filter(fits).drop("n_words", "key")
        found = met.join(docs.select("row", "w"), "row").filter(same)
    return found.select("row", start.alias("start"), F.size("win").alias("len"), "items")


def contamination(docs: DataFrame, items: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of `docs` (doc_id, text).

    `items` has item_id, text.  Null and wordless texts have no words and no
    hits; null and wordless items have no windows.  An item without an id hits
    words like any other, but is neither counted nor named.  Repeated rows are judged
    each for itself, whatever their ids; other columns are ignored.  An empty
    benchmark hits nothing, an empty table gives an empty result, and texts of
    any length are read whole.
    """
    drawn = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    read = settle(drawn.withColumn("n_words", F.size("w").cast("long")))
    windows = settle(item_windows(items, params.window))
    small = windows.count() <= params.broadcast_windows
    prefix = settle(prefixes(windows, read, small))
    hits = _hits(read, prefix, small)
    spread = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    by_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("items").alias("items"))
    by_row = by_row.select("row", F.size(F.array_distinct(spread)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("found"))
    out = read.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
