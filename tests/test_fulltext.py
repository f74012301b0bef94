"""Token classes, boolean questions and the stored index, against literal fixtures, definitions and brute force."""

import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import fts, lexer
from siltstone.operators import search as S
from siltstone.operators import textindex
from siltstone.operators.textindex import TextIndex
from siltstone.plans import registry

FIXTURES = [
    ("A state-of-the-art pump", {"state-of-the-art": [2], "state": [3], "art": [6], "pump": [7]}),
    ("up-to-date 3d-print foo-10", {"up-to-d": [1], "date": [4], "3d-print": [5], "3d": [6], "print": [7], "foo": [8], "-10": [9]}),
    ("Mail a.b+c@mail.example.com!", {"mail": [1], "a.b+c@mail.example.com": [2]}),
    ("see http://www.Example.com/a/b?q=1.", {"see": [1], "www.example.com/a/b?q=1": [2], "www.example.com": [3], "/a/b?q=1": [4]}),
    ("example.com:8080 and e.g. this", {"example.com:8080": [1], "e": [3], "g": [4]}),
    ("8-10 -3.5 1e-10 2.4.1 2nd 10%", {"8": [1], "-10": [2], "-3.5": [3], "1e-10": [4], "2.4.1": [5], "2nd": [6], "10": [7]}),
    ("and/or /usr/local/x.txt", {"and/or": [1], "/usr/local/x.txt": [2]}),
    ("<p class='a b'>bold</p> x&amp;y &#233;z", {"bold": [1], "x": [2], "y": [3], "z": [4]}),
    ("gardener's don't foo_bar", {"garden": [1], "foo": [5], "bar": [6]}),
    ("日本語 été 😀", {"日本語": [1], "été": [2]}),
    ("", {}),
    (None, {}),
]


@pytest.mark.parametrize(("text", "want"), FIXTURES)
def test_token_classes(text, want):
    assert lexer.lexemes(text) == want


@given(st.text(st.sampled_from("ab1.-/@:<>&; \n'_é+e")))
@settings(max_examples=500, deadline=None)
def test_lexer_by_stretches(text):
    """Texts are read a stretch without white space at a time; that is the same as at once where there is no tag."""
    for analyser in (lexer.ENGLISH, lexer.SIMPLE):
        whole = [x for kind, token in lexer.tokens(text) for x in lexer._expanded(kind, token, analyser == lexer.ENGLISH)]
        assert lexer.placed(text, analyser) == whole
    runs = [t for kind, t in lexer.tokens(text) if kind in ("word", "numword")]
    assert all(re.fullmatch(r"[^\W_]+", r) for r in runs)


def test_lexer_is_linear():
    import time

    for piece in ("a.", "a-", "1", "a/", "<a", "a@", "&a", "1.", "a:", "http://", "a.b/"):
        began = time.time()
        lexer.placed(piece * (200_000 // len(piece)))
        assert time.time() - began < 10, piece


def test_query_trees():
    q = lambda t: [[("-" * p.negated) + " ".join(p.lexemes) for p in c] for c in fts.parse_query(t)]
    assert q('supernovae stars -crab') == [["supernova", "star", "-crab"]]
    assert q('"sad cat" or "fat rat" mouse') == [["sad cat"], ["fat rat", "mous"]]
    assert q('signal -"segmentation fault"') == [["signal", "-segment fault"]]
    assert q("or cat or or dog or") == [["cat"], ["dog"]] and q("the or cat") == [["cat"]] and q('--cat -"the" ""') == [["cat"]]
    assert q('dog "unclosed quote') == [["dog", "unclos quot"]] and q(None) == q("") == []
    assert fts.parse_query('"cat in the hat"')[0][0].offsets == (0, 3) and fts.parse_query("e-mail")[0][0].lexemes == ("e-mail", "e", "mail")


def brute_holds(query, words, low=1, high=10**9):
    """Whether the query holds in a stretch of a text, by its definition."""
    def phrase(p):
        return any(all(low <= s + k <= high and 1 <= s + k <= len(words) and words[s + k - 1] == x for x, k in zip(p.lexemes, p.offsets, strict=True)) for s in range(low, min(high, len(words)) + 1))

    return any(all(phrase(p) != p.negated for p in clause) for clause in query)


def brute_rank(query, words):
    """Covers by trying every end upward from each lexeme, then every beginning downward."""
    if not brute_holds(query, words):
        return None
    lexemes = {x for c in query for p in c for x in p.lexemes}
    every = [k for k, w in enumerate(words, 1) if w in lexemes]
    total, i = 0.0, 0
    while i < len(every):
        end = next((e for e in every[i:] if brute_holds(query, words, every[i], e)), None)
        if end is None:
            break
        start = next(s for s in reversed(every) if every[i] <= s <= end and brute_holds(query, words, s, end))
        total += 0.1 / (1 + (end - start + 1) - sum(start <= p <= end for p in every))
        i = every.index(start) + 1
    return total


def _question(rng, vocabulary):
    out = []
    for _ in range(rng.randint(1, 4)):
        word = rng.choice(vocabulary)
        form = rng.random()
        out.append(f'"{word} {rng.choice(vocabulary)}"' if form < 0.25 else word)
        if rng.random() < 0.25:
            out[-1] = "-" + out[-1]
        if rng.random() < 0.35:
            out.append("or")
    return " ".join(out)


def test_cover_density_of_trees():
    rng = random.Random(8)
    for _ in range(1500):
        words = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        question = _question(rng, "abcd")
        query = fts.parse_query(question, "words")
        found = lexer.lexemes(" ".join(words), "words")
        got = fts.cover_density(found, query) if fts.matches(found, query) else None
        want = brute_rank(query, words)
        assert got == want if want is None else got == pytest.approx(want), (words, question)


def brute_search(texts, questions, k, analyser):
    out = []
    for qid, q in questions:
        query = fts.parse_query(q, analyser)
        hits = sorted((-round(brute_rank(query, ws), 9), i) for i, ws in texts.items() if query and brute_rank(query, ws) is not None)
        out += [(qid, r, i) for r, (_, i) in enumerate(hits[:k], 1)]
    return sorted(out)


def test_boolean_questions_are_brute_force(spark, monkeypatch):
    """OR, NOT and phrases over random texts, with ranks, and the fill-up of questions of negations alone."""
    rng = random.Random(12)
    texts = {3 * i: [rng.choice("aaabbcdefg") for _ in range(rng.randint(0, 9))] for i in range(1, 160)}
    questions = [(k, _question(rng, "abcdefgz")) for k in range(60)] + [(60, "-a"), (61, "-z"), (62, '-"a b"'), (63, "a or -a"), (64, "-a -b -c"), (65, "z"), (66, None), (67, "")]
    chunks = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, text string").repartition(3)
    asked = spark.createDataFrame(questions, "qid long, text string")
    free = S._free
    monkeypatch.setattr(S, "_free", lambda taken, asked, ids, k: free(taken, asked, ids, k, size=7))
    for few in (1000, 2):
        monkeypatch.setattr(textindex, "FEW", few)
        got = sorted((r.qid, r["rank"], r.id) for r in S.keyword(chunks, asked, 20, analyser="words").collect())
        assert got == brute_search(texts, questions, 20, "words")
    closed = [(i, q) for i, q in questions if all(any(not p.negated for p in c) for c in fts.parse_query(q, "words"))]
    got = {(r.qid, r.id) for r in S.boolean_matches(chunks, asked, analyser="words").collect()}
    assert got == {(i, t) for i, q in closed for t, w in texts.items() if fts.parse_query(q, "words") and brute_holds(fts.parse_query(q, "words"), w)}


def _far_phrases(spark):
    """A text whose phrases lie beyond the last position of the classed analysers, and questions with what they find."""
    text = "a z " + "x " * 17_000 + "b c y z"
    found = {1: '"b c"', 2: 'a z -"z y"', 3: "y -q"}
    lost = {4: '"c b"', 5: 'a z -"y z"'}
    return text, spark.createDataFrame([*found.items(), *lost.items()], "qid long, text string"), set(found)


def _boolean_tables(spark, folder):
    """Items that begin or end with the word `or`, which is an operator where it stands bare."""
    items = [(1, "or tea x ea"), (2, "tea x or ea"), (3, "tea x ea or"), (4, "tea or x ea")]
    texts = ["or tea", "tea or", "ea or", "or", "tea x ea", "or ea tea", "x ea", "x or tea ea", "tea", None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("or")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(6, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("benchmark", "documents", "labels", "embeddings"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).collect()))
    assert got and got == sorted(con.sql(registry.ORACLE_SQL[name]).fetchall())


def test_boolean_questions_with_the_word_or(spark, tmp_path):
    _boolean_tables(spark, tmp_path)
    _same_as_sql(spark, tmp_path, "boolean_match")


def test_stored_questions_with_the_word_or(spark, tmp_path):
    _boolean_tables(spark, tmp_path)
    _same_as_sql(spark, tmp_path, "boolean_match_stored")


def _odd_tables(spark, folder):
    """Labelled documents without a source or a text, labels and vectors without a key, and letters whose lower case depends on their neighbours or is two characters."""
    items = [(1, "or tea x ea"), (2, "p q web z"), (3, "ΟΔΟΣ p q İx"), (4, "p q ΟΔΟΣ z"), (5, None), (6, ""), (7, "ΟΔΟΣ p")]
    texts = ["or tea", "or tea", "web", None, None, "οδοσ p", "ΟΔΟΣ P", "ΟΔΟΣ İX", "ΟΔΟΣ", "ix", "", "or tea", "or tea"]
    sources = [None, "", "web", "web", None, "a", "a", "ΟΔΟΣ", "a", "a", "web", None, "a"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, *x) for k, x in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*((k, 0) for k in range(11)), (1, None), (5, 1), (12, 1), (99, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(12, None, 0), (12, [1.0], 0), (None, [1.0], 0), (99, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["boolean_match", "boolean_match_stored", "lexical_match"])
def test_odd_rows_are_as_in_sql(spark, tmp_path, name):
    _odd_tables(spark, tmp_path)
    _same_as_sql(spark, tmp_path, name)


def test_phrases_of_very_long_texts(spark):
    text, asked, want = _far_phrases(spark)
    chunks = spark.createDataFrame([(1, text)], "id long, text string")
    assert {r.qid for r in S.boolean_matches(chunks, asked, analyser="words").collect()} == want


def test_stored_phrases_of_very_long_texts(spark, tmp_path):
    text, asked, want = _far_phrases(spark)
    index = TextIndex(spark, str(tmp_path / "index"), analyser="words", buckets=4)
    index.upsert(spark.createDataFrame([(1, text)], "id long, text string"))
    none = spark.createDataFrame([], "id long, text string")
    assert {r.qid for r in S.boolean_matches(none, asked, index).collect()} == want


def test_index_after_upserts_is_a_rebuild(spark, tmp_path):
    """Upserts, replaced and deleted texts, merges of segments: the same postings, ids and answers as an index built at once."""
    rng = random.Random(5)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8, fan=3)
    now, n_segments = {}, []
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    for step in range(9):
        batch = {rng.randint(1, 60): " ".join(rng.choice(["tomato", "seedlings", "soil", "water", "watering-can", "the", "compost", f"only{step}"]) for _ in range(rng.randint(0, 8))) for _ in range(10)}
        index.upsert(frame(list(batch.items())))
        now |= batch
        if step == 4:
            gone = rng.sample(sorted(now), 5)
            index.delete(frame([(i, None) for i in gone]).select("id"))
            now = {i: t for i, t in now.items() if i not in gone}
        n_segments.append(sum(p["kind"] == "postings" for p in index.table.current().parts))
        if step not in (4, 8):
            continue
        stored = index.open()
        rebuilt = textindex.built(frame(list(now.items())))
        assert sorted(map(repr, stored.postings.collect())) == sorted(map(repr, rebuilt.postings.collect()))
        assert sorted(r.id for r in stored.ids.collect()) == sorted(now)
    assert max(n_segments) < 7 and index.table.current().version > 9
    asked = spark.createDataFrame([(1, "tomato or compost"), (2, "tomato soil -water"), (3, "-tomato"), (4, "only8"), (5, "watering-can"), (6, "the")], "qid long, text string")
    found = [sorted(map(tuple, S.keyword(*x, stored=y).collect())) for x, y in (((None, asked), index), ((frame(list(now.items())), asked), None))]
    assert found[0] == found[1] and {q for q, *_ in found[0]} >= {1, 2, 3, 5}
    with pytest.raises(TypeError):
        index.upsert(spark.createDataFrame([("x", "y")], "id string, text string"))


def test_search_reads_its_own_folders(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=32)
    index.upsert(spark.createDataFrame([(k, f"word{k} common") for k in range(200)], "id long, text string"))
    one = spark.createDataFrame([("word7",)], "lexeme string")
    rows = index.open(one).postings
    files = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 and rows.filter("lexeme = 'word7'").count() == 1
    assert index.open().postings.count() == 400


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    """An upsert's postings go from the texts to their folders, and a search deals those it looks up by text; no other copy of them is made."""
    index, copies, plan = TextIndex(spark, str(tmp_path / "index"), analyser="words", buckets=4), [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    settle, write = textindex.settle, index.table.write_part
    monkeypatch.setattr(textindex, "settle", lambda df: copies.append(df.columns) or settle(df))
    monkeypatch.setattr(index.table, "write_part", lambda df, *a, **marks: copies.append(df.columns) or plans.setdefault(marks["kind"], plan(df)) and write(df, *a, **marks))
    plans = {}
    index.upsert(spark.createDataFrame([(k, f"word{k} common tea" + " common" * k) for k in range(40)], "id long, text string"))
    assert sum("positions" in c for c in copies) == 1 and "Exchange" not in plans["postings"]
    found = S.boolean_matches(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "common word7"), (2, '"common common" -word3'), (3, "absent")], "qid long, text string"), index)
    assert not re.search(r"Exchange hashpartitioning\((lexeme|word)#\d+, id#", plan(found))
    assert sorted(map(tuple, found.collect())) == [(1, 7), *((2, k) for k in range(2, 40) if k != 3)]


def test_positions_are_the_lexers(spark, monkeypatch):
    """Postings are those of the lexer text by text, however many tokens are taken at a time and beyond the last position that is counted."""
    texts = ["", None, "the of", "Tea, the tea; soil", "x " * 20_000 + "soil tea", "water the tea " * 9, "tea"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for analyser in (lexer.ENGLISH, lexer.SIMPLE, lexer.WORDS):
        want = {(k, x, tuple(p)) for k, t in enumerate(texts) for x, p in lexer.lexemes(t, analyser).items()}
        for size in (5, 500_000):
            monkeypatch.setattr(textindex, "_TOKENS", size)
            assert {(r.id, r.lexeme, tuple(r.positions)) for r in textindex.postings(chunks, analyser).collect()} == want
            few = frozenset({"tea", "soil", "absent"})
            assert {(r.id, r.lexeme, tuple(r.positions)) for r in textindex.postings(chunks, analyser, few).collect()} == {x for x in want if x[1] in few}


def test_upserts_at_once(spark, tmp_path):
    """Two writers at a time: both batches are in, and a text that both hold is there once."""
    from concurrent.futures import ThreadPoolExecutor

    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    batches = [[(k, f"left{k}") for k in range(0, 12)], [(k, f"right{k}") for k in range(8, 20)]]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: TextIndex(spark, str(tmp_path / "index"), buckets=4).upsert(spark.createDataFrame(rows, "id long, text string")), batches))
    found = [(r.id, r.lexeme) for r in index.open().postings.collect()]
    assert sorted(i for i, _ in found) == list(range(20)) and len({x[:4] for i, x in found if 8 <= i < 12}) == 1
