"""Batch retrieval: every search takes a table of questions and gives ranked rows for each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fts
from siltstone.functions.lexer import ENGLISH
from siltstone.functions.text import first_text, words
from siltstone.functions.vectors import nearest
from siltstone.operators.textindex import Index, TextIndex, built
from siltstone.sources.io import dense_ids, settle

# Results, candidates of each ranker, and the rank constant of the fusion.
TOP_K, POOL, RRF_K = 5, 60, 60


def ranked(scored: DataFrame, k: int, *order) -> DataFrame:  # noqa: ANN002
    """The first k of each question in the given order; the id settles ties."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order, F.col("id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _likely(wanted: DataFrame, counts: DataFrame, postings: DataFrame, *keys: str) -> DataFrame:
    """qid, id of rows that have the three rarest words (or all, if fewer) of a group of `wanted` (qid, other keys, word).

    A common word never builds a large set of candidates beside a rare one, and
    what is joined is rows of the rarest words alone.  `counts` is (word, n),
    `postings` (word, id).
    """
    own = ["qid", *keys]
    w = Window.partitionBy(*own).orderBy(F.coalesce("n", F.lit(0)), "word")
    few = wanted.join(counts, "word", "left").withColumn("k", F.row_number().over(w)).filter("k <= 3")
    few = settle(few.withColumn("most", F.max("k").over(Window.partitionBy(*own))).select(*own, "word", "most"))  # of known size, so that a few are sent to the postings
    both = few.join(postings.select("word", "id"), "word").groupBy(*own, "id", "most").agg(F.count(F.lit(1)).alias("found"))
    return both.filter("found = most").select("qid", "id")


def _free(taken: DataFrame, asked: DataFrame, ids: DataFrame, k: int, size: int = 1 << 16) -> DataFrame:
    """qid and its first k ids that are not in `taken` (qid, id), for each of `asked` (qid).

    Ids are numbered.  The taken ones are counted by stretches of `size` numbers,
    so that whole stretches are passed over, and only in the stretches where the
    first k free numbers lie the gaps between taken ones are looked for.  No
    question meets all ids.
    """
    numbered = settle(dense_ids(ids.select("id").distinct(), "id", name="at"))
    most = numbered.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    placed = settle(taken.join(numbered, "id").select("qid", "at", F.expr(f"cast((at - 1) div {size} as int)").alias("part")))
    head = asked.select("qid", F.lit(-1).alias("part"), F.lit(size).cast("long").alias("n"))
    counts = placed.groupBy("qid", "part").agg(F.count(F.lit(1)).alias("n")).unionByName(head)
    w = Window.partitionBy("qid").orderBy("part")
    gone = F.sum(F.when(F.col("part") >= 0, F.col("n")).otherwise(0)).over(w)
    first = (F.col("part").cast("long") + 1) * size + 1  # of the next stretch
    told = counts.select("qid", "part", "n", gone.alias("gone"), first.alias("next"), F.coalesce((F.lead("part").over(w)).cast("long") * size, F.lit(most)).alias("end"))
    before = lambda c: c - 1 - F.col("gone")  # noqa: E731  free numbers below c
    untouched = told.filter((before(F.col("next")) < k) & (F.col("end") >= F.col("next"))).select("qid", F.col("next").alias("low"), F.least(F.col("end"), F.col("next") + (k - before(F.col("next"))) - 1).alias("high"))
    partly = told.filter((F.col("part") >= 0) & (F.col("next") - size - 1 - (F.col("gone") - F.col("n")) < k) & (F.col("n") < size)).select("qid", "part", (F.col("gone") - F.col("n")).alias("earlier"))
    inner = placed.join(partly, ["qid", "part"])
    edge = partly.select("qid", "part", (F.col("part").cast("long") * size).alias("at"), "earlier")  # the number before the stretch
    v = Window.partitionBy("qid", "part").orderBy("at")
    stop = F.least((F.col("part").cast("long") + 1) * size, F.lit(most)) + 1
    gaps = inner.select("qid", "part", "at", "earlier").unionByName(edge).select("qid", F.col("at"), F.coalesce(F.lead("at").over(v), stop).alias("until"), (F.col("at") - F.col("earlier") - (F.row_number().over(v) - 1)).alias("free"))
    within = gaps.filter((F.col("until") - F.col("at") > 1) & (F.col("free") < k)).select("qid", (F.col("at") + 1).alias("low"), F.least(F.col("until") - 1, F.col("at") + (k - F.col("free"))).alias("high"))
    found = untouched.unionByName(within).filter("low <= high").select("qid", F.explode(F.sequence("low", "high")).alias("at"))
    return found.join(numbered, "at").select("qid", "id")


def candidates(each: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """qid, id of texts that may match, and the questions (qid) that texts without any of their lexemes match as well.

    `each` (qid, clause, negated, lexeme) are the terms of boolean questions.  An
    alternative with something to be found is driven by its three rarest
    lexemes.  One of negations alone matches what lacks them, so the texts with
    any lexeme of its question are candidates, and all others match.
    """
    open_ = each.groupBy("qid", "clause").agg(F.bool_and("negated").alias("none")).filter("none").select("qid").distinct()
    postings = index.postings.select(F.col("lexeme").alias("word"), "id")
    driven = each.filter("NOT negated").join(open_, "qid", "left_anti").select("qid", "clause", F.col("lexeme").alias("word"))
    closed = _likely(driven, index.terms.withColumnRenamed("lexeme", "word"), postings, "clause")
    loose = each.join(open_, "qid").select("qid", F.col("lexeme").alias("word")).distinct().join(postings, "word").select("qid", "id")
    return closed.union(loose).distinct(), open_


def keyword(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, stored: TextIndex | None = None, analyser: str = ENGLISH) -> DataFrame:
    """qid, rank, id, score of the k best matches by cover density; equal scores go by id.

    `questions` (qid, text) are web-style: words are joined by AND, `or` parts
    alternatives, quotes make phrases, a minus negates.  Candidates come from
    postings of the rarest lexemes of each alternative; the positions of the
    question's lexemes in them, and no text, then say whether and how well they
    match.  A question with an alternative of negations alone matches texts with
    none of its lexemes, too; those have score 0, and the first k of them by id
    follow what scores more.  Stop words alone find nothing.

    With a `stored` index, `chunks` is not read; without one the lexemes that
    the questions ask for are looked up in it.
    """
    analyser = stored.analyser if stored is not None else analyser
    each = terms(questions, analyser)
    return best(questions, each, stored.open(each, alone=True) if stored is not None else built(chunks, each, analyser), k)


def terms(questions: DataFrame, analyser: str = ENGLISH) -> DataFrame:
    """qid, clause, negated, lexeme: the terms of boolean questions (qid, text)."""
    return settle(questions.select("qid", F.explode(fts.terms("text", analyser)).alias("t")).select("qid", "t.*"))


def best(questions: DataFrame, each: DataFrame, index: Index, k: int) -> DataFrame:
    """`keyword` over an index that holds the terms `each` of the questions."""
    analyser, asked = index.analyser, questions.select("qid", F.col("text").alias("question")).filter("question IS NOT NULL")
    met, open_ = candidates(each, index)
    # of known size, so that few are sent to the texts; a text meets its questions once, whatever their number
    of_text = settle(met.join(asked, "qid").groupBy("id").agg(F.collect_list(F.struct("qid", "question")).alias("q")))
    texts = index.texts
    if texts is None:
        texts = index.postings.join(of_text.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("x"))
    found = texts.join(of_text, "id").select("id", "q", fts.ranks_of("x.lexeme", "x.positions", "q.question", analyser).alias("r"))
    rows = found.select("id", F.explode(F.transform("r", lambda r: F.struct(F.get("q", r["place"])["qid"].alias("qid"), r["score"].alias("score")))).alias("r"))
    scored = rows.groupBy("r.qid", "id").agg(F.max("r.score").alias("score"))
    if not (rest := settle(open_)).isEmpty():
        taken = each.select("qid", "lexeme").distinct().join(rest, "qid", "left_semi").join(index.postings, "lexeme").select("qid", "id").distinct()
        scored = scored.union(_free(taken, rest, index.ids, k).select("qid", "id", F.lit(0.0)))
    return ranked(scored, k, F.desc("score")).select("qid", "rank", "id", "score")


def boolean_matches(chunks: DataFrame, questions: DataFrame, stored: TextIndex | None = None, analyser: str = ENGLISH) -> DataFrame:
    """qid, id of all matches of web-style questions; those with an alternative of negations alone match as many rows as there are, so they are left to `keyword`."""
    analyser = stored.analyser if stored is not None else analyser
    asked = questions.select("qid", F.col("text").alias("question")).filter("question IS NOT NULL")
    each = terms(questions, analyser)
    index = stored.open(each, alone=True) if stored is not None else built(chunks, each, analyser)
    # dealt by id once: candidates, their questions and the positions of a text then meet without another shuffle
    index = replace(index, postings=index.postings.repartition("id"))
    met, open_ = candidates(each, index)
    closed = met.join(open_, "qid", "left_anti").join(settle(asked), "qid")
    of_text = closed.groupBy("id").agg(F.collect_list(F.struct("qid", "question")).alias("q"))
    found = index.postings.groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("x")).join(of_text, "id")
    held = found.select("id", "q", fts.which_hold("x.lexeme", "x.positions", "q.question", analyser).alias("held"))
    return held.select("id", F.explode(F.transform("held", lambda k: F.get("q", k)["qid"])).alias("qid")).select("qid", "id")


def vector(chunks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, rank, id, distance of the k nearest `chunks` (id, vector); chunks without a vector are not found."""
    return nearest(questions, chunks, k)


def rrf(keyword_hits: DataFrame, vector_hits: DataFrame, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (qid, rank, id); of equal scores the keyword ranking goes first."""
    one = keyword_hits.select("qid", "id", F.col("rank").alias("kw_rank"))
    two = vector_hits.select("qid", "id", F.col("rank").alias("vec_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    scored = one.join(two, ["qid", "id"], "full_outer").withColumn("score", part("kw_rank") + part("vec_rank"))
    fused = ranked(scored, k, F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"))
    return fused.select("qid", "rank", "id", "score", "kw_rank", "vec_rank")


def hybrid(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, pool: int = POOL) -> DataFrame:
    """Fusion over candidates of both rankers; `chunks` has id, text, vector, `questions` qid, text, vector."""
    return rrf(keyword(chunks, questions, pool), vector(chunks, questions.select("qid", "vector"), pool), k)


def search(method: str, chunks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    if method == "keyword":
        return keyword(chunks, questions, k).select("qid", "rank", "id")
    if method == "vector":
        return vector(chunks, questions.select("qid", "vector"), k).select("qid", "rank", "id")
    return hybrid(chunks, questions, k).select("qid", "rank", "id")


def containing_all(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, score of unstemmed matches: the text has every distinct word of the query, and score counts their occurrences.

    Texts become counts of the words that any query has; those meet a query on
    its words of fewest texts, and the pairs are then checked for the others.
    """
    want = queries.select("qid", F.array_distinct(words(F.col("text"))).alias("want")).filter(F.size("want") > 0)
    each = want.select("qid", F.size("want").alias("size"), F.explode("want").alias("word"))
    said = texts.select("id", F.explode(words(F.col("text"))).alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    has = settle(said.groupBy("word", "id").agg(F.count(F.lit(1)).alias("n")))
    counts = has.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    both = _likely(each.select("qid", "word"), counts, has).join(each, "qid").join(has, ["word", "id"]).groupBy("qid", "id", "size").agg(F.count(F.lit(1)).alias("found"), F.sum("n").alias("score"))
    return both.filter("found = size").select("qid", "id", "score")


def with_citations(hits: DataFrame, chunks: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Text and titles for ranked ids only: documents must exist, sections may be gone."""
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "source_type")
    s = sections.select(F.col("id").alias("section_id"), "section_title")
    return hits.select("qid", "rank", "id").join(chunks.select("id", "text", "document_id", "section_id"), "id").join(d, "document_id").join(s, "section_id", "left")


def context(cited: DataFrame) -> DataFrame:
    """qid and its numbered passages, in order of rank, blank lines between."""
    line = F.format_string("[%d] (Source: %s — %s)\n%s", "rank", first_text(F.col("document_title"), F.lit("n/a")), first_text(F.col("section_title"), F.lit("n/a")), "text")
    in_order = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return cited.groupBy("qid").agg(F.array_join(F.transform(in_order, lambda x: x["line"]), "\n\n").alias("context"))


def ordered_sources(cited: DataFrame, title: str = "document_title") -> DataFrame:
    """qid and its distinct titles, by their first rank."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", title)))
    return cited.groupBy("qid").agg(F.array_distinct(F.transform(in_order, lambda x: x[title])).alias("sources"))
