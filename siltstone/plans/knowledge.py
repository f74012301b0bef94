"""The plans that join the operators: ingestion, answering, and comparison of configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.functions.html import html_to_text, unescape_html
from siltstone.functions.models import OFFLINE, Models
from siltstone.functions.template import compiled
from siltstone.functions.text import book_body, tokens
from siltstone.operators.chunks import chunk_all
from siltstone.operators.evaluate import summarise
from siltstone.operators.monitor import with_cost
from siltstone.operators.search import TOP_K, context, hybrid, ordered_sources, with_citations
from siltstone.operators.sections import sections

NO_RESULT = "I couldn't find anything relevant in the collection to answer that."
# What an answer must keep to, by the name of the variant.
PROMPTS = {
    "v1_grounded": "Answer from the numbered passages alone, cite them as [1] or [2], and say plainly when they don't hold the answer.",
    "v2_direct": "Answer from the numbered passages alone: the direct answer first, then supporting detail, with citations as [1] or [2]. Say briefly when the passages don't cover the question.",
}


def books(raw: DataFrame) -> DataFrame:
    """kb_documents of plain-text books (number, title, author, source_ref, text)."""
    return raw.select(F.concat(F.lit("gutenberg-"), F.col("number").cast("string")).alias("id"), F.lit("book").alias("source_type"), "source_ref", "title", "author", F.lit(None).cast("string").alias("license_note"), book_body(F.col("text")).alias("raw_text"), F.current_timestamp().alias("fetched_at"))


def factsheets(raw: DataFrame) -> DataFrame:
    """kb_documents of HTML fact sheets (slug, title, source_ref, html)."""
    return raw.select(F.concat(F.lit("sheet-"), F.col("slug")).alias("id"), F.lit("factsheet").alias("source_type"), "source_ref", unescape_html("title").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("license_note"), html_to_text("html").alias("raw_text"), F.current_timestamp().alias("fetched_at"))


def knowledge(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and chunks of all strategies; chunk ids are a hash of their key, so they need no counter."""
    split = sections(documents)
    cut = chunk_all(split)
    return split, cut.withColumn("id", F.xxhash64("strategy", "section_id", "chunk_index"))


#: Templates of the prompts: what is asked of a model about a question, an answer or a section.
TEMPLATES = {
    "answer": "Question: {question}\n\nContext passages:\n{passages}\n\nAnswer:",
    "rewrite": "Turn this gardening question into a short search query of its key terms, and return the query alone.\n\nQuestion: {question}",
    "judge": 'Say how relevant the answer is to the question: RELEVANT, PARTLY_RELEVANT or NON_RELEVANT.\n\nQuestion: {question}\nAnswer: {answer}\n\nReturn JSON: {{"relevance": "...", "explanation": "..."}}',
    "questions": 'Write {n} questions a gardener might ask that this section answers, without copying its wording.\n\nTitle: {title}\n\n{text}\n\nReturn JSON: {{"questions": ["..."]}}',
}


def prompt(question: Column, passages: Column) -> Column:
    return compiled(TEMPLATES["answer"], {"question": question, "passages": passages})


def answer(questions: DataFrame, chunks: DataFrame, documents: DataFrame, split: DataFrame, model: str, k: int = TOP_K, rewrite: bool = False, by: Models = OFFLINE, instructions: str = PROMPTS["v2_direct"]) -> DataFrame:
    """A row for each of `questions` (qid, text): answer, sources, prompt and usage.

    `chunks` has id, document_id, section_id, text, vector.  A rewritten
    question serves retrieval alone.  A question that retrieves nothing gets the
    fixed refusal with no usage.
    """
    asked = questions.select("qid", "text", (models.rewrite(F.col("text"), by) if rewrite else F.col("text")).alias("sought"))
    vectors = models.embed(asked.select(F.col("qid").alias("id"), F.col("sought").alias("text")), by).select(F.col("id").alias("qid"), "vector")
    hits = hybrid(chunks, asked.select("qid", F.col("sought").alias("text")).join(vectors, "qid"), k)
    cited = with_citations(hits, chunks, documents, split)
    met = asked.join(context(cited), "qid", "left").join(ordered_sources(cited), "qid", "left")
    full = met.withColumn("prompt", prompt(F.col("text"), F.coalesce("context", F.lit(""))))
    told = full.withColumn("got", models.answer("prompt", by))
    found = F.col("context").isNotNull()
    size = lambda c: F.when(found, F.size(tokens(c))).otherwise(0)
    done = told.select("qid", F.col("text").alias("question"), F.when(found, F.coalesce("got.value", F.lit(""))).otherwise(F.lit(NO_RESULT)).alias("answer"), F.col("got.error").alias("error"), F.lit(model).alias("model"), F.lit(instructions).alias("instructions"), "prompt", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), found.alias("found"), "context")
    counted = done.withColumns({"prompt_tokens": size(F.concat("instructions", "prompt")), "completion_tokens": size(F.col("answer"))})
    return counted.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).drop("context")


def judged(answers: DataFrame, by: Models = OFFLINE) -> DataFrame:
    raw = models.raw_judgement(F.col("question"), F.col("answer"), by)
    return answers.withColumn("_raw", raw).withColumn("_v", models.verdict(F.col("_raw.value"))).withColumns({"relevance": F.col("_v.relevance"), "explanation": F.col("_v.explanation")}).drop("_raw", "_v")


def compare(by_config: dict[str, DataFrame]) -> DataFrame:
    """Summary rows of judged answers, one for each configuration over the same questions."""
    rows = [d.select(F.lit(c).alias("config"), "relevance", F.col("completion_tokens").alias("answer_tokens"), F.lit(0.0).alias("latency_seconds")) for c, d in by_config.items()]
    return summarise(reduce(DataFrame.unionByName, rows))


def counted(df: DataFrame, failed: Column | None = None) -> tuple[DataFrame, Observation]:
    """`df`, and its row and failure counts, which are there once something has read it through: no second pass."""
    seen = Observation()
    failures = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), (failures if failed is not None else F.max(failures)).alias("failed")), seen


def chat(questions: DataFrame, chunks: DataFrame, documents: DataFrame, split: DataFrame, model: str, by: Models = OFFLINE) -> tuple[DataFrame, DataFrame]:
    """Turn rows and judge feedback rows of a batch of questions; a turn's id is its question's."""
    told = with_cost(judged(answer(questions, chunks, documents, split, model, by=by), by))
    now = F.current_timestamp().alias("timestamp")
    turns = told.select(F.col("qid").alias("id"), "question", "answer", "model", "instructions", "prompt", F.lit("structure").alias("search_strategy"), F.lit("hybrid").alias("search_method"), "prompt_tokens", "completion_tokens", "total_tokens", F.lit(0.0).alias("response_time"), "cost", now)
    feedback = told.select(F.col("qid").alias("id"), F.col("qid").alias("conversation_id"), F.lit("judge").alias("source"), "relevance", "explanation", F.lit(None).cast("int").alias("score"), now)
    return turns, feedback
