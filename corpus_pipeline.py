"""The corpus pipeline: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language_id, near_dup, piece_codec, repeats
from siltstone.llm.common import fold, forget, fresh, mark, settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go, and no others.

    Those are the texts of score 0.  No other score and no predicted language
    rejects a text; without labels to learn from there are no scores, and the
    rule is read off the text.  Rows are judged each for itself, repeated or
    not; other columns stay, whatever their names, and an empty table stays so.
    """
    net = language_id.train(docs.filter(fold("doc_id", 4) != 2))
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    label, score = fresh(docs, "language", "language_score")
    found = language_id.identify(docs, net, label, score)
    return found.filter(F.col(score) > 0).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate component (five-word shingles, similarity 0.8).

    Rows that repeat a doc_id are one document and stay or go together; of those
    with equal texts the one of smallest hash stays.  Null and wordless texts are
    alone and stay, as do rows without an id.  Other columns stay, and an empty
    table stays empty.
    """
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return named.distinct().unionByName(docs.filter("doc_id IS NULL"))
    hashed = [c for c, kind in docs.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
    (row,) = fresh(docs, "row")
    one = named.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.xxhash64(*hashed)).alias(row))
    return one.select("doc_id", "text", f"{row}.*").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents.

    A changed text is its kept words joined by one space, with n_chars (if there
    is one) to match; an unchanged one stays as it is.  Rows of which nothing is
    left go.  Each row is judged for itself, also where a doc_id repeats; null
    and empty texts stay, other columns stay, and an empty table stays empty.
    """
    cut = repeats.remove_repeats(docs, carry=True).filter("n_removed = 0 OR kept <> ''")
    changed = F.col("n_removed") > 0
    own = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("kept")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(own[c].alias(c) for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words.

    One contaminated row takes all rows of its doc_id, null included, with it.
    Null, empty and wordless texts stay; other columns stay, and an empty table
    or benchmark takes nothing.
    """
    (name,) = fresh(docs, "gone")
    gone = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left, a row for each; null and empty texts have none, and an empty table has no rows."""
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("substring", substring),
    ("benchmark", benchmark),
    ("pieces", pieces),
]

#: Training, sketches and piece lattices have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        forget(spark, since, keep=1)  # what the stage read and made on its way
    return STAGES[-1][1](spark, docs, sf_dir)
