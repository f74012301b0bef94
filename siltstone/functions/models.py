"""Models behind one interface, with offline stand-ins that always answer alike."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import series

# Verdicts, prices per million tokens (in, out), limits and retries.
VERDICTS, UNPARSEABLE = ("NON_RELEVANT", "PARTLY_RELEVANT", "RELEVANT"), "UNPARSEABLE"
UNPARSEABLE_EXPLANATION = "Judge response could not be parsed."
PRICES = {"gpt-5.6-luna": (0.20, 1.20), "gpt-5.6-terra": (2.00, 12.00), "gpt-5.6-sol": (5.00, 30.00), "text-embedding-3-small": (0.02, 0.0)}
BATCH, QUESTIONS, PROMPT_CHARS, ATTEMPTS, BACKOFF_SECONDS = 100, 5, 3000, 5, 2.0
_WORD = re.compile(r"[^\W_]+")


class Transient(Exception):
    """A failure that another attempt may mend: a rate limit or a time-out."""


class Exhausted(Exception):
    """A failure that no attempt mends, such as a spent quota."""


@dataclass(frozen=True)
class Models:
    """What a deployment supplies; each call must be picklable."""

    embed: Callable[[list[str]], list[list[float]]]
    answer: Callable[[str], str]
    judge: Callable[[str, str], str]
    rewrite: Callable[[str], str]
    questions: Callable[[str, str, int], str]


def hash_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed word hashes, normalised."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts, strict=True):
        for w in _WORD.findall(t.lower()):
            h = xxhash.xxh3_64_intdigest(w)
            row[h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).tolist()


def _extract(prompt: str) -> str:
    found = re.search(r"^\[1\].*\n(.*)$", prompt, re.M)
    return f"{found[1]} [1]" if found else ""


def _overlap(question: str, answer: str) -> str:
    a, b = (set(_WORD.findall(x.lower())) for x in (question, answer))
    share = len(a & b) / len(a) if a else 0.0
    return json.dumps({"relevance": VERDICTS[2 if share >= 0.5 else 1 if share >= 0.2 else 0], "explanation": f"{share:.2f} of the question's words"})


def _ask(title: str, text: str, n: int) -> str:
    return json.dumps({"questions": [f"{title}: {' '.join(w)}?" for k in range(n) if (w := _WORD.findall(text)[k * 8 : k * 8 + 8])]})


OFFLINE = Models(hash_embedding, _extract, _overlap, lambda q: " ".join(w for w in _WORD.findall(q) if len(w) > 3), _ask)


def attempt(call: Callable, *args, attempts: int = ATTEMPTS, wait: float = BACKOFF_SECONDS):  # noqa: ANN002, ANN201
    """Value and error of a call: transient failures are tried again after a longer and longer wait, others not."""
    error = None
    for k in range(attempts):
        try:
            return call(*args), None
        except Exhausted:
            raise
        except Transient as e:
            error = str(e)
            if k + 1 < attempts:
                time.sleep(wait * (k + 1))
        except Exception as e:  # noqa: BLE001  one bad row must not end a job
            return None, f"{type(e).__name__}: {e}"
    return None, error


def embed(rows: DataFrame, models: Models = OFFLINE) -> DataFrame:
    """id, vector, error for `rows` (id, text), in calls of one batch; a failing batch fails its rows alone."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH]
                got, error = attempt(models.embed, part["text"].fillna("").tolist())
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": got or [None] * len(part), "error": error})

    return rows.select(F.col("id").cast("long"), "text").mapInPandas(run, "id long, vector array<float>, error string")


def _pairwise(call: Callable, kind: str):  # noqa: ANN202
    @series(kind)
    def run(*columns: pd.Series) -> pd.DataFrame:
        got = [attempt(call, *row) for row in zip(*columns, strict=True)]
        return pd.DataFrame({"value": [v for v, _ in got], "error": [e for _, e in got]})

    return run


def answer(prompt: Column, models: Models = OFFLINE) -> Column:
    return _pairwise(models.answer, "struct<value:string,error:string>")(prompt)


def raw_judgement(question: Column, reply: Column, models: Models = OFFLINE) -> Column:
    return _pairwise(models.judge, "struct<value:string,error:string>")(question, reply)


def rewrite(question: Column, models: Models = OFFLINE) -> Column:
    """The rewritten question, or the question itself when that is blank."""
    got = _pairwise(models.rewrite, "struct<value:string,error:string>")(question)["value"]
    return F.coalesce(F.nullif(F.trim(got), F.lit("")), question)


def verdict(response: Column) -> Column:
    """relevance and explanation of a judge's JSON; anything but a known label is marked as unparseable."""
    parsed = F.from_json(response, "relevance string, explanation string")
    label = F.upper(F.regexp_replace(parsed["relevance"], r"(?U)^\s+|\s+$", ""))
    known = F.coalesce(label.isin(*VERDICTS), F.lit(False))
    return F.struct(F.when(known, label).otherwise(F.lit(UNPARSEABLE)).alias("relevance"), F.when(known, F.coalesce(parsed["explanation"], F.lit(""))).otherwise(F.lit(UNPARSEABLE_EXPLANATION)).alias("explanation"))


@series("array<string>")
def question_list(responses: pd.Series) -> pd.Series:
    """Strings of the response's `questions` that are not blank, stripped; others are dropped, not converted."""

    def one(raw: str | None) -> list[str]:
        try:
            items = json.loads(raw or "{}").get("questions", [])
        except (ValueError, AttributeError):
            return []
        return [q.strip() for q in items if isinstance(q, str) and q.strip()] if isinstance(items, list) else []

    return responses.map(one)


def generate_questions(sections: DataFrame, n: int = QUESTIONS, models: Models = OFFLINE) -> DataFrame:
    """section_id, document_id, question rows for `sections`; failed sections have a row with the error alone."""
    call = _pairwise(lambda title, text: models.questions(title, text, n), "struct<value:string,error:string>")
    title = F.coalesce(F.nullif("section_title", F.lit("")), F.lit("Untitled"))
    asked = sections.select(F.col("id").alias("section_id"), "document_id", call(title, F.substring("raw_text", 1, PROMPT_CHARS)).alias("got"))
    each = asked.select("section_id", "document_id", F.slice(question_list("got.value"), 1, n).alias("q"), F.col("got.error").alias("error"))
    return each.select("section_id", "document_id", F.explode_outer("q").alias("question"), "error").filter("question IS NOT NULL OR error IS NOT NULL")
