"""Explicit schemas of the retrieval tables, and checks of what they promise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


LEXEMES = T.ArrayType(_struct(("lexeme", _S, False), ("positions", T.ArrayType(_I), False)))
SCHEMAS: dict[str, T.StructType] = {
    "kb_documents": _struct(("id", _S, False), ("source_type", _S, False), ("source_ref", _S, False), ("title", _S, False), ("author", _S, True), ("license_note", _S, True), ("raw_text", _S, True), ("fetched_at", _TS, False)),
    "sections": _struct(("id", _S, False), ("document_id", _S, False), ("section_title", _S, True), ("section_order", _I, False), ("raw_text", _S, False)),
    "chunks": _struct(("id", _L, False), ("document_id", _S, False), ("section_id", _S, True), ("strategy", _S, False), ("chunk_index", _I, False), ("text", _S, False), ("token_count", _I, True), ("embedding", T.ArrayType(T.FloatType(), False), True), ("lexemes", LEXEMES, True)),
    "ground_truth": _struct(("id", _L, False), ("section_id", _S, False), ("document_id", _S, False), ("question", _S, False), ("question_embedding", T.ArrayType(T.FloatType(), False), True), ("generated_at", _TS, False)),
    "turns": _struct(("id", _I, False), ("question", _S, False), ("answer", _S, False), ("model", _S, False), ("instructions", _S, False), ("prompt", _S, False), ("search_strategy", _S, True), ("search_method", _S, True), ("prompt_tokens", _I, False), ("completion_tokens", _I, False), ("total_tokens", _I, False), ("response_time", _D, False), ("cost", _D, False), ("timestamp", _TS, False)),
    "feedback": _struct(("id", _I, False), ("conversation_id", _I, True), ("source", _S, False), ("relevance", _S, True), ("explanation", _S, True), ("score", _I, True), ("timestamp", _TS, False)),
}
ALLOWED = {
    ("kb_documents", "source_type"): ("book", "factsheet"),
    ("chunks", "strategy"): ("fixed", "structure", "recursive"),
    ("feedback", "source"): ("user", "judge"),
}


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a required or enumerated column of table `name`, with the columns at fault."""
    broken = [F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in SCHEMAS[name] if not f.nullable and f.name in df.columns]
    broken += [F.when(~F.col(c).isin(*values), F.lit(c)) for (t, c), values in ALLOWED.items() if t == name]
    return df.withColumn("broken", F.array_compact(F.array(*broken))).filter(F.size("broken") > 0)


def unknown_values(df: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """Values of an enumerated column outside `allowed`, with their counts; null counts as unknown."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent is gone; what a cascade would delete is the rest of `child`."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of table `name` in order, missing ones null: old files read under a grown schema."""
    return reduce(lambda d, f: d if f.name in d.columns else d.withColumn(f.name, F.lit(None).cast(f.dataType)), SCHEMAS[name], df).select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]))
