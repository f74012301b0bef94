"""Sections to chunks, by three strategies."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import bpe
from siltstone.functions.arrow import series
from siltstone.functions.text import tokens
from siltstone.operators.sections import packed

# Sizes of the strategies, in tokens or characters.
WINDOW, OVERLAP = 250, 50
STRUCTURE_CHARS, TINY_CHARS = 1200, 50
RECURSIVE_CHARS, RECURSIVE_OVERLAP, SEPARATORS = 1000, 100, ("\n\n", "\n", " ", "")
STRATEGIES = ("fixed", "structure", "recursive")


def merge_tiny(chunks: list[str]) -> list[str]:
    """Chunks under 50 characters join the one before; a tiny first one takes in the next."""
    out: list[str] = []
    for c in chunks:
        if out and (len(c) < TINY_CHARS or len(out) == 1 and len(out[0]) < TINY_CHARS):
            out[-1] = f"{out[-1]}\n\n{c}"
        else:
            out.append(c)
    return out


def structure(text: str | None) -> list[str]:
    if not (text or "").strip():
        return []
    if len(text) <= STRUCTURE_CHARS:
        return [text]
    return merge_tiny(packed(text, STRUCTURE_CHARS, before=True, oversized=STRUCTURE_CHARS))


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that begin with the separator, but for the first; characters when there is none."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _regroup(pieces: list[str]) -> list[str]:
    """Runs of pieces up to the size; the next run starts with the last pieces that fit the overlap."""
    out: list[str] = []
    lo = total = 0
    for i, p in enumerate(pieces):
        if total + len(p) > RECURSIVE_CHARS and i > lo:
            out.append("".join(pieces[lo:i]))
            while lo < i and (total > RECURSIVE_OVERLAP or total + len(p) > RECURSIVE_CHARS):
                total -= len(pieces[lo])
                lo += 1
        total += len(p)
    if lo < len(pieces):
        out.append("".join(pieces[lo:]))
    return [s for c in out if (s := c.strip())]


def _recurse(text: str, separators: tuple[str, ...]) -> list[str]:
    at = next(k for k, s in enumerate(separators) if s in text)
    out: list[str] = []
    short: list[str] = []
    for p in _cut(text, separators[at]):
        if len(p) < RECURSIVE_CHARS:
            short.append(p)
            continue
        out += _regroup(short)
        short = []
        out += _recurse(p, separators[at + 1 :]) if at + 1 < len(separators) else [p]
    return out + _regroup(short)


def recursive(text: str | None) -> list[str]:
    return merge_tiny(_recurse(text, SEPARATORS)) if (text or "").strip() else []


@series("array<string>")
def _structure(texts: pd.Series) -> pd.Series:
    return texts.map(structure)


@series("array<string>")
def _recursive(texts: pd.Series) -> pd.Series:
    return texts.map(recursive)


def fixed(t: Column) -> Column:
    """Windows of 250 of the tokens `t`, each 200 on from the last, until one reaches the end; all in built-in functions.

    `t` should be a column of its own: made here, it would be made for each window.
    """
    step, n = WINDOW - OVERLAP, F.size(t)
    count = F.when(n == 0, 0).when(n <= WINDOW, 1).otherwise(F.ceil((n - WINDOW) / step).cast("int") + 1)
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(t, i * step + 1, WINDOW), "")))


def merge_tiny_column(chunks: Column) -> Column:
    """merge_tiny as one fold, for chunks made by built-in functions."""
    last = lambda a: F.element_at(a, -1)
    absorb = lambda a, c: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), F.lit("\n\n"), c)))
    tiny = lambda a, c: (F.size(a) > 0) & ((F.length(c) < TINY_CHARS) | (F.size(a) == 1) & (F.length(F.get(a, F.lit(0))) < TINY_CHARS))
    return F.aggregate(chunks, F.array().cast("array<string>"), lambda a, c: F.when(tiny(a, c), absorb(a, c)).otherwise(F.concat(a, F.array(c))))


SPLIT = {"fixed": lambda c: merge_tiny_column(c), "structure": _structure, "recursive": _recursive}


def chunk(sections: DataFrame, strategy: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Chunk rows of `sections` (id, document_id, raw_text), numbered within each section; none spans two.

    Tokens are those of `vocabulary` (the path of its rank file, which workers
    read too, and its pattern); without one, runs of non-space.
    """
    source = F.col("raw_text")
    if vocabulary is not None:
        split = merge_tiny_column(bpe.token_windows(source, *vocabulary, WINDOW, WINDOW - OVERLAP)) if strategy == "fixed" else SPLIT[strategy](source)
        cut = sections.select("document_id", F.col("id").alias("section_id"), F.posexplode(split).alias("chunk_index", "text"))
        return cut.select("document_id", "section_id", F.lit(strategy).alias("strategy"), "chunk_index", "text", bpe.token_count("text", *vocabulary).alias("token_count"))
    if strategy == "fixed":  # generators keep the tokens, and then the windows, from being inlined
        cut = sections.select("document_id", "id", F.explode(F.array(F.coalesce(tokens(source), F.array().cast("array<string>")))).alias("t"))
        sections = cut.select("document_id", "id", F.explode(F.array(fixed(F.col("t")))).alias("raw_text"))
        source = F.col("raw_text")
    split = SPLIT[strategy](source)
    rows = sections.select("document_id", F.col("id").alias("section_id"), F.posexplode(split).alias("chunk_index", "text"))
    return rows.select("document_id", "section_id", F.lit(strategy).alias("strategy"), "chunk_index", "text", F.size(tokens(F.col("text"))).alias("token_count"))


def chunk_all(sections: DataFrame, vocabulary: tuple[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows of all strategies; without a vocabulary in one pass, a section's of one strategy after another, with its columns `keep`."""
    if vocabulary is not None:
        return reduce(DataFrame.unionByName, (chunk(sections, s, vocabulary) for s in STRATEGIES))
    one = lambda c: F.explode(F.array(c))  # noqa: E731  keeps what is used again from being inlined
    cut = sections.select("document_id", "id", *keep, "raw_text", one(F.coalesce(tokens(F.col("raw_text")), F.array().cast("array<string>"))).alias("t"))
    cut = cut.select("document_id", "id", *keep, "raw_text", one(fixed(F.col("t"))).alias("windows"))
    source = {s: F.col("windows" if s == "fixed" else "raw_text") for s in STRATEGIES}
    each = F.array(*(F.struct(F.lit(s).alias("strategy"), SPLIT[s](source[s]).alias("chunks")) for s in STRATEGIES))
    split = cut.select("document_id", "id", *keep, F.explode(each).alias("c"))
    rows = split.select("document_id", F.col("id").alias("section_id"), F.col("c.strategy").alias("strategy"), F.posexplode("c.chunks").alias("chunk_index", "text"), *keep)
    return rows.select("document_id", "section_id", "strategy", "chunk_index", "text", F.size(tokens(F.col("text"))).alias("token_count"), *keep)
