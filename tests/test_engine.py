import json
import math
import random
import time
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import models as M
from siltstone.functions.vectors import nearest
from siltstone.operators import chunks as C
from siltstone.operators import evaluate as E
from siltstone.operators import monitor as N
from siltstone.operators import search as S
from siltstone.plans import knowledge as K
from siltstone.sources import io
from siltstone.sources import schemas


def _hits(spark, lists, name="id"):
    return spark.createDataFrame([(1, r, ord(c)) for r, c in enumerate(lists, 1)], f"qid long, rank int, {name} long")


@pytest.mark.parametrize(("kw", "vec", "want"), [("a", "b", "ab"), ("ab", "bc", "bac"), ("", "xy", "xy")])
def test_rrf(spark, kw, vec, want):
    got = S.rrf(_hits(spark, kw), _hits(spark, vec)).orderBy("rank").collect()
    assert "".join(chr(r.id) for r in got) == want


def test_rrf_random(spark):
    rng = random.Random(1)
    for _ in range(5):
        kw, vec = (rng.sample(range(20), rng.randint(0, 15)) for _ in range(2))
        score: dict[int, float] = {}
        for ids in (kw, vec):
            for r, i in enumerate(ids):
                score[i] = score.get(i, 0.0) + 1.0 / (61 + r)
        want = sorted(score, key=lambda i: score[i], reverse=True)[:5]
        frames = [spark.createDataFrame([(1, r, i) for r, i in enumerate(ids, 1)], "qid long, rank int, id long") for ids in (kw, vec)]
        assert [r.id for r in S.rrf(*frames).orderBy("rank").collect()] == want


def test_keyword(spark):
    chunks = spark.createDataFrame([(1, "Watering tomato seedlings daily"), (2, "tomatoes and a long stretch of other words before any seedling"), (3, "carrots"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "tomato seedlings"), (2, "the"), (3, "tomato -daily"), (4, None), (5, "tomato or carrot")], "qid long, text string")
    got = sorted((r.qid, r["rank"], r.id) for r in S.keyword(chunks, asked).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (3, 1, 2), (5, 1, 1), (5, 2, 2), (5, 3, 3)]


def test_nearest_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0, None])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.withColumnRenamed("id", "qid").filter("qid in (1, 4)")
    assert [(r.qid, r["rank"], r.id) for r in nearest(q, v, 5).orderBy("qid", "rank").collect()] == [(1, 1, 1), (1, 2, 3), (1, 3, 2)]


def test_nearest_of_any_length(spark):
    """Vectors too short or too long to be squared have the neighbours of their directions."""
    from siltstone.functions.vectors import cosine_distance

    turns = [0.0, 0.1, 0.3, 0.6, 1.0, 1.5]
    rows = [(k, [math.cos(t) * s, math.sin(t) * s]) for k, (t, s) in enumerate(zip(turns, [1e-200, 1.0, 1e200, 1e-300, 1e307, 1e-160], strict=True))]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = nearest(v.withColumnRenamed("id", "qid"), v, 2, skip_self=True).collect()
    want = {k: sorted((round(1 - math.cos(t - u), 9), j) for j, u in enumerate(turns) if j != k)[:2] for k, t in enumerate(turns)}
    assert {(r.qid, r["rank"]): (r.distance, r.id) for r in got} == {(k, r): x for k, own in want.items() for r, x in enumerate(own, 1)}
    pair = v.filter("id = 0").select(F.col("vector").alias("a")).crossJoin(v.select("id", F.col("vector").alias("b"))).select("id", cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == pytest.approx(1 - math.cos(turns[r.id]), abs=1e-12) for r in pair)


def test_scratch_of_two_threads(spark):
    """What one thread forgets another may still read."""
    from concurrent.futures import ThreadPoolExecutor

    def run(n):
        since = io.mark()
        first = io.settle(spark.range(n))
        second = io.settle(first.withColumn("two", F.lit(2)))
        io.forget(spark, since, keep=1)
        return second.count(), io.mark() - since

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(run, [5, 6, 7, 8])) == [(5, 1), (6, 1), (7, 1), (8, 1)]


def test_partitions_do_not_matter(spark, small):
    from siltstone.plans import registry

    found = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, registry.QUERIES["hybrid_search"](spark, small).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and found[0]


def test_upsert_keeps_what_is_not_updated(spark):
    old = spark.createDataFrame([(1, "r0", "t0"), (3, "r", "t")], "id long, source_ref string, title string")
    new = spark.createDataFrame([(1, "r1", "t1"), (2, "r2", None)], "id long, source_ref string, title string")
    got = sorted(map(tuple, io.upsert(old, new, updated=("title",)).collect()))
    assert got == [(1, "r0", "t1"), (2, "r2", None), (3, "r", "t")]


def test_schemas(spark):
    bad = spark.createDataFrame([(1, None, "user"), (2, 1, "robot"), (None, 1, "judge")], "id int, conversation_id int, source string")
    assert sorted((r.id or 0, list(r.broken)) for r in schemas.violations(bad, "feedback").collect()) == [(0, ["id"]), (2, ["source"])]
    assert schemas.conform(bad, "feedback").columns == [f.name for f in schemas.SCHEMAS["feedback"]]


def test_files(spark, tmp_path):
    results = spark.createDataFrame([("a", "keyword", 0.12345, 0.1), ("b", "hybrid", 0.8, 0.7)], "strategy string, method string, hit_rate double, mrr double")
    io.write_evaluation(results, 5, 10, str(tmp_path / "e"))
    back = io.read_evaluation(spark, str(tmp_path / "e")).collect()
    assert [(r.strategy, r.hit_rate) for r in back] == [("b", 0.8), ("a", 0.1234)] or back[1].hit_rate == 0.1235
    assert io.read_evaluation(spark, str(tmp_path / "none")).count() == 0
    for s, n in (("x", 1), ("y", 2), ("x", 3)):
        io.replace_partitions(spark.createDataFrame([(n, s)], "n int, strategy string"), str(tmp_path / "c"), "strategy")
    assert sorted((r.n, r.strategy) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(2, "y"), (3, "x")]
    (tmp_path / "b.txt").write_text("one\r\ntwo")
    assert io.read_books(spark, str(tmp_path / "b.txt")).first().raw_text == "one\r\ntwo"
    (tmp_path / "s.json").write_text(json.dumps([{"slug": "s", "link": "l", "title": {"rendered": "A &amp; B"}, "content": {"rendered": "<h2>H</h2><p>x</p>"}}]))
    (tmp_path / "t.json").write_text("[]")
    sheet = K.factsheets(io.read_factsheets(spark, str(tmp_path / "*.json"))).collect()
    assert [(r.id, r.title, r.raw_text) for r in sheet] == [("sheet-s", "A & B", "## H\n\nx")]


def test_dense_ids(spark):
    d = spark.range(0, 100, numPartitions=7).withColumnRenamed("id", "k").orderBy(F.rand(3))
    assert all(r.k + 1 == r.id for r in io.dense_ids(d, "k").collect())


def test_dense_ids_of_wide_rows(spark):
    """Wide rows over many parts: none is lost, and ids have no gap."""
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    d = spark.range(0, 60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("wide"))
    got = io.dense_ids(d, "k").agg(F.count("wide"), F.min("id"), F.max("id"), F.sum((F.col("id") != F.col("k") + 1).cast("int"))).first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(got) == (60_000, 1, 60_000, 0)
    more = io.next_ids(spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([("b",), ("a",)], "name string"), "name").collect()
    assert sorted((r.id, r.name) for r in more) == [(8, "a"), (9, "b")]


def test_nearest_has_no_single_part(spark):
    """Without broadcasts the blocks are dealt by part as well."""
    v = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = nearest(v.withColumnRenamed("id", "qid"), v, 2, skip_self=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(dim" in plan and plan.count("part#") > 2 and found.count() == 80


def test_small_forms(spark):
    row = spark.createDataFrame([(True, 0.8133), (False, 0.0)], "up boolean, share double").select(N.sign(F.col("up")), N.percent(F.col("share"))).collect()
    assert [tuple(r) for r in row] == [(1, "81.3%"), (-1, "0.0%")]


def test_stream_forms(spark, tmp_path):
    """One feedback a conversation, and rates by window, over files that arrive."""
    from siltstone.streaming.live import one_feedback_each, turn_rates

    t = "timestamp'2026-01-01 00:0{}:00'"
    spark.sql(f"SELECT 1 AS conversation_id, {t.format(1)} AS timestamp, 0.5D AS cost, 1.0D AS response_time UNION ALL SELECT 1, {t.format(2)}, 1.5D, 3.0D UNION ALL SELECT 2, {t.format(7)}, 1.0D, 2.0D").write.parquet(str(tmp_path / "in"))
    for name, f in (("one", one_feedback_each), ("rates", turn_rates)):
        source = spark.readStream.schema("conversation_id int, timestamp timestamp, cost double, response_time double").parquet(str(tmp_path / "in"))
        mode = "append" if name == "one" else "complete"
        f(source).writeStream.trigger(availableNow=True).format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.conversation_id for r in spark.table("one").collect()) == [1, 2]
    assert sorted((r.n, r.cost, r.latency) for r in spark.table("rates").collect()) == [(1, 1.0, 2.0), (2, 2.0, 2.0)]


def test_costs_and_feedback(spark):
    turns = spark.createDataFrame([("gpt-5.6-luna", 1000, 500), ("other", 9, 9)], "model string, prompt_tokens int, completion_tokens int")
    assert sorted(r.cost for r in N.with_cost(turns).collect()) == [0.0, pytest.approx(0.0008)]
    fb = spark.createDataFrame([("user", 1), ("user", -1), ("user", 0), ("user", None), ("judge", 1)], "source string, score int")
    assert {r.kind: r.n for r in N.user_feedback(fb).collect()} == {"up": 1, "down": 1, "neutral": 2}
    none = spark.createDataFrame([], "cost double, response_time double, total_tokens int, prompt_tokens int, completion_tokens int")
    assert tuple(N.overview(none).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_parsing_of_replies(spark):
    raw = ['{"relevance":" relevant ","explanation":"ok"}', "not json", '{"relevance":"MAYBE"}', "[]", None]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(M.verdict(F.col("r"))["relevance"]).collect()
    assert [r[0] for r in got] == ["RELEVANT"] + ["UNPARSEABLE"] * 4
    lists = spark.createDataFrame([('{"questions":["a",1," b ",""]}',), ("x",), ('{"questions":3}',)], "r string")
    assert [r[0] for r in lists.select(M.question_list("r")).collect()] == [["a", "b"], [], []]


def test_ranks_and_winner(spark):
    q = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "qid long, target string")
    h = spark.createDataFrame([(1, 1, "x"), (1, 2, "t"), (1, 3, "t"), (2, 1, "x")], "qid long, rank int, target string")
    assert {r.qid: r.rr for r in E.reciprocal_ranks(q, h).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    rec = spark.createDataFrame([("a", v, 1, 1.0) for v in ("RELEVANT", "RELEVANT", "NON_RELEVANT", "UNPARSEABLE")], "config string, relevance string, answer_tokens int, latency_seconds double")
    s = E.summarise(rec).first()
    assert (s.relevant_rate, s.bad_rate, s.partly_relevant, s.sample_size) == (0.5, 0.25, 0, 4)


def test_attempts():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise M.Transient("slow down")
        return x

    assert M.attempt(flaky, 7, wait=0) == (7, None) and len(calls) == 3
    assert M.attempt(lambda: 1 / 0)[1].startswith("ZeroDivisionError")
    with pytest.raises(M.Exhausted):
        M.attempt(lambda: (_ for _ in ()).throw(M.Exhausted("quota")))


def test_answering(spark):
    kb = spark.createDataFrame([("d1", "book", "Soil", "clay soil holds water well in spring"), ("d2", "book", "Seeds", "seeds sprout in warm beds")], "id string, source_type string, title string, raw_text string")
    split, chunks = K.knowledge(kb)
    own = chunks.filter("strategy = 'structure'")
    own = own.join(M.embed(own.select("id", "text")).select("id", "vector"), "id")
    asked = spark.createDataFrame([(1, "clay soil water")], "qid long, text string")
    got = K.judged(K.answer(asked, own, kb, split, "gpt-5.6-luna", k=1)).first()
    assert got.answer.startswith("clay soil") and got.relevance == "RELEVANT" and list(got.sources) == ["Soil"]
    assert "[1] (Source: Soil — Part 1)\nclay" in got.prompt
    none = K.answer(asked, own.limit(0), kb, split, "m").first()
    assert none.answer == K.NO_RESULT and none.total_tokens == 0


def test_chat_and_counts(spark, tmp_path):
    kb = spark.createDataFrame([("d1", "book", "Soil", "clay soil holds water well in spring")], "id string, source_type string, title string, raw_text string")
    split, chunks = K.knowledge(kb)
    own = chunks.filter("strategy = 'structure'")
    own = own.join(M.embed(own.select("id", "text")).select("id", "vector"), "id")
    asked = spark.createDataFrame([(1, "clay soil water"), (2, "soil")], "qid long, text string")
    turns, feedback = K.chat(asked, own, kb, split, "gpt-5.6-luna")
    assert schemas.violations(schemas.conform(turns, "turns"), "turns").count() == schemas.violations(schemas.conform(feedback, "feedback"), "feedback").count() == 0
    df, seen = K.counted(feedback, F.col("relevance") == "UNPARSEABLE")
    df.write.parquet(str(tmp_path / "f"))
    assert seen.get == {"rows": 2, "failed": 0}
    rec = feedback.select(F.lit("a").alias("config"), "relevance", F.lit(1).alias("answer_tokens"), F.lit(0.0).alias("latency_seconds"))
    io.write_comparison(rec, E.summarise(rec), 42, "a", str(tmp_path / "cmp"))
    got = spark.read.json(str(tmp_path / "cmp")).collect()
    assert len(got) == 1 and (got[0].winner, got[0].seed, got[0].sample_size) == ("a", 42, 2) and got[0].configs.a.sample_size == len(got[0].records.a) == 2


def test_incremental_stream(spark, tmp_path):
    from siltstone.streaming.live import embed_arrivals, embedded

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, "d", "s", "fixed", 0, "alpha beta")], "id long, document_id string, section_id string, strategy string, chunk_index int, text string")
    schemas.conform(rows, "chunks").write.parquet(source)
    for _ in range(2):
        embed_arrivals(spark, source, out, mark).awaitTermination()
    assert embedded(spark, out).count() == 1


def test_registered_queries_match_sql(spark, small, tmp_path):
    import duckdb

    from siltstone.plans import registry

    db = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, f in registry.QUERIES.items():
        f(spark, small).write.parquet(out := str(tmp_path / name))
        if name in registry.ORACLE_SQL:
            db.execute(f"CREATE OR REPLACE TABLE r AS SELECT * FROM '{out}/*.parquet'")
            db.execute(f"CREATE OR REPLACE TABLE o AS {registry.ORACLE_SQL[name]}")
            c = ", ".join(sorted(x[0] for x in db.execute("DESCRIBE o").fetchall()))
            assert c == ", ".join(sorted(x[0] for x in db.execute("DESCRIBE r").fetchall())), name
            assert db.execute(f"SELECT (SELECT count(*) FROM (SELECT {c} FROM o EXCEPT ALL SELECT {c} FROM r)), (SELECT count(*) FROM (SELECT {c} FROM r EXCEPT ALL SELECT {c} FROM o))").fetchall() == [(0, 0)], name


def test_retrieval_evaluation_is_whole(spark, small):
    """Three strategies by three methods, all over the same questions."""
    from siltstone.plans.registry import retrieval_evaluation

    began = time.perf_counter()
    rows = retrieval_evaluation(spark, small).collect()
    assert sorted((r.strategy, r.method) for r in rows) == sorted((s, m) for s in ("fixed", "structure", "recursive") for m in ("keyword", "vector", "hybrid"))
    assert all(r.seconds > 0 for r in rows) and sum(r.seconds for r in rows) <= time.perf_counter() - began
    assert len({r.n_questions for r in rows}) == 1 and all(0 <= r.mrr <= r.hit_rate <= 1 for r in rows)


def test_evaluation_cuts_each_chunk_once(spark):
    """Chunks are made once a strategy, whatever searches and joins read them, and lie in files enough for all cores."""
    made = spark.sparkContext.accumulator(0)

    def cut(text):
        made.add(1)
        return text

    rows = [(k, s, k, f"word{k} common") for k in range(40) for s in ("a", "b")]
    texts = spark.createDataFrame(rows, "id long, strategy string, section_id long, raw string")
    chunks = texts.withColumn("text", F.udf(cut)("raw")).withColumn("vector", F.array(F.cos("id"), F.sin("id")))
    asked = spark.createDataFrame([(1, "word7", 7, [1.0, 0.0]), (2, "word9 common", 9, [1.0, 0.0])], "qid long, text string, target long, vector array<double>")
    got = {(r.strategy, r.method): (r.hit_rate, r.n_questions) for r in E.evaluate(chunks, asked, ("a", "b")).collect()}
    assert got["a", "keyword"] == got["b", "keyword"] == (1.0, 2) and len(got) == 6
    assert made.value == len(rows)


def test_evaluation_writes_positions_not_texts(spark, monkeypatch):
    """All strategies' chunks are written in one pass, without their texts."""
    wrote, settle = [], E.settle
    monkeypatch.setattr(E, "settle", lambda df, *by: wrote.append(set(df.columns)) or settle(df, *by))
    rows = [(2 * k + (s == "b"), s, k, f"word{k} common tea") for k in range(30) for s in ("a", "b")]
    chunks = spark.createDataFrame(rows, "id long, strategy string, section_id long, text string").withColumn("vector", F.array(F.cos("id"), F.sin("id")))
    asked = spark.createDataFrame([(1, "word7", 7, [1.0, 0.0]), (2, "common -word3", 0, [1.0, 0.0]), (3, "absent", 4, [1.0, 0.0])], "qid long, text string, target long, vector array<double>")
    got = {(r.strategy, r.method): round(r.mrr, 6) for r in E.evaluate(chunks, asked, ("a", "b")).collect()}
    assert got["a", "keyword"] == got["b", "keyword"] == round(2 / 3, 6)
    assert not any({"section_id", "text"} <= c for c in wrote) and sum("found" in c for c in wrote) == 1


def test_strategies_in_one_pass_are_each_ones(spark):
    texts = ["", None, " abc ", "word " * 700, "a paragraph.\n\n" * 90, "line\n" * 400, "x" * 2500, "tiny\n\n" + "long " * 300]
    rows = spark.createDataFrame([("d", f"s{k}", t, k) for k, t in enumerate(texts)], "document_id string, id string, raw_text string, kept int")
    own = reduce(DataFrame.unionByName, (C.chunk(rows, s) for s in C.STRATEGIES))
    both = C.chunk_all(rows, keep=("kept",))
    assert sorted(map(tuple, both.drop("kept").collect())) == sorted(map(tuple, own.collect())) and own.schema == both.drop("kept").schema
    assert both.filter("section_id <> concat('s', kept)").isEmpty()
