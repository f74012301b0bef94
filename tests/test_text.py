import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.functions import fts, stemming
from siltstone.functions.html import structured_text
from siltstone.functions.text import tokens
from siltstone.operators import chunks as C
from siltstone.operators import sections as S


def test_book_body(spark):
    from pyspark.sql import functions as F

    from siltstone.functions.text import book_body

    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** END OF THIS PROJECT GUTENBERG EBOOK A ***"
    rows = [(f"x {start} body {end} y", "body"), (f"  {start} b ", f"{start} b"), (f"{end} a {start}", ""), (" plain ", "plain"), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select(book_body(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_structured_text():
    assert structured_text("<p><strong>Method:</strong> To ensure</p>") == "Method: To ensure"
    assert structured_text("<h1>z</h1><h2>A</h2><p>b</p><ul><li>c</li></ul><script>s</script>") == "## A\n\nb\n- c"
    assert structured_text("<p>a<p>b &amp; c<div class='wp-caption'>no</div>") == "a\nb & c"
    assert structured_text("<ul><li><p>x</p></ul>") == "- x\nx"
    assert structured_text(None) == ""


def test_chapters():
    text = "CHAPTER I. Soil\nCHAPTER II. Seeds\n" + "CHAPTER I\nearth " + "x" * 30 + "\nCHAPTER II\ngrain"
    assert [t for t, _ in S.split_book(text)] == ["Chapter I: Soil", "Chapter II: Seeds"]
    assert S.split_book(text)[0][1].startswith("CHAPTER I\nearth")
    assert S.by_chapter("chapter contains a brief") is None
    assert S.split_book("chapter 12a foo\nbody")[0][0] == "Chapter 1: 2a foo"
    for n, titles in ((199, ["Chapter I"]), (200, ["Front Matter", "Chapter I"])):
        assert [t for t, _ in S.split_book("f" * n + "\nCHAPTER I\nbody")] == titles


def test_capital_headers():
    gap = "\r\n\r\n"
    assert [m[1] for m in S.CAPITALS.finditer(f"{gap}AAAA{gap}BBBB{gap}CCCC{gap}")] == ["AAAA", "CCCC"]
    body = "".join(f"{gap}HEAD {c}.{gap}text of {c} " + "w " * 40 for c in "ABCDE")
    assert [t for t, _ in S.split_book(body)] == [f"HEAD {c}" for c in "ABCDE"]
    early = "".join(f"{gap}HEAD {c}{gap}x" for c in "ABCDE") + " y" * 400
    assert S.by_capitals(early) is None and S.split_book(early)[0][0] == "Part 1"


def test_long_paragraphs():
    parts = S.split_book("word " * 5000)
    assert all(len(b) < S.PART_CHARS + 6 for _, b in parts)
    long = S.split_book("CHAPTER I\n" + "word " * 5000)
    assert long[0][0] == "Chapter I (part 1)" and len(long) > 1
    assert S.split_book(None) == S.split_book(" \n") == []


def test_factsheet():
    assert S.split_factsheet("abc", "T") == [("T", "abc")]
    assert S.split_factsheet("pre\n## A\nx\n## B\n\n## C\ny", "T") == [("Introduction", "pre"), ("A", "x"), ("C", "y")]


def test_section_names(spark):
    d = spark.createDataFrame([("d", "factsheet", "T", "## A\nx\n## B\ny"), ("e", "book", "T", ""), ("f", "book", "T", None)], "id string, source_type string, title string, raw_text string")
    got = sorted(map(tuple, S.sections(d).collect()))
    assert got == [("d-s000", "d", "A", 0, "x"), ("d-s001", "d", "B", 1, "y")]


@pytest.mark.parametrize(("sizes", "want"), [([10, 60], [72]), ([60, 10, 60], [72, 60]), ([10, 10], [22]), ([10], [10]), ([], [])])
def test_merge_tiny(spark, sizes, want):
    from pyspark.sql import functions as F

    parts = ["x" * n for n in sizes]
    assert [len(c) for c in C.merge_tiny(parts)] == want
    frame = spark.createDataFrame([(parts,)], "c array<string>")
    assert frame.select(C.merge_tiny_column(F.col("c"))).first()[0] == C.merge_tiny(parts)


@pytest.mark.parametrize(("n", "windows"), [(0, 0), (1, 1), (250, 1), (251, 2), (450, 2), (451, 3)])
def test_fixed_windows(spark, n, windows):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(C.fixed(tokens(F.col("t")))).first()[0]
    assert len(got) == windows
    if n:
        rebuilt = got[0] + "".join(" ".join(w.split(" ")[50:]) for w in got[1:])
        assert rebuilt == text


def test_structure():
    assert C.structure(" abc ") == [" abc "]
    pieces = C.structure("word " * 1860)
    assert all(len(p) < 1200 + 6 + 52 for p in pieces)
    assert C.structure(None) == []
    assert C.structure("a" * 700 + "\n\n" + "b" * 700) == ["a" * 700, "b" * 700]


@given(st.lists(st.text("ab ", min_size=1, max_size=400), max_size=30))
def test_recursive_bounds(parts):
    text = "\n\n".join(parts)
    got = C._recurse(text, C.SEPARATORS) if text.strip() else []
    assert all(len(c) <= 1000 and c == c.strip() for c in got)
    assert "".join("".join(got).split()).count("a") >= text.count("a")


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "running": "run", "hopping": "hop", "hoping": "hope", "agreed": "agre", "happiness": "happi", "relational": "relat", "generously": "generous", "skies": "sky", "conditional": "condit", "adjustment": "adjust", "rolling": "roll", "controlling": "control"}
    assert {w: stemming.stem(w) for w in pairs} == pairs


def test_queries_and_covers():
    found = fts.lexemes("The quick brown fox; the lazy dogs run. Foxes ran")
    assert found["fox"] == [4, 9] and "the" not in found
    q = fts.parse_query
    assert q("the of") == () and not fts.matches(found, q("the"))
    assert fts.matches(found, q('"brown fox" dog')) and not fts.matches(found, q('"fox brown"'))
    assert fts.matches(found, q("cat or dog")) and not fts.matches(found, q("fox -dog")) and fts.matches(found, q("-cat"))
    assert fts.cover_density(fts.lexemes("apple pear"), q("apple pear")) == pytest.approx(0.1)
    assert fts.cover_density(fts.lexemes("apple x y pear"), q("apple pear")) == pytest.approx(0.1 / 3)
    assert fts.cover_density(fts.lexemes("apple pear apple"), q("apple pear")) == pytest.approx(0.2)


def test_cover_density_against_its_definition():
    """Minimal covers by trying every pair of ends."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        found = {w: sorted(rng.sample(range(1, 40), rng.randint(1, 8))) for w in "abc"}
        clauses = fts.parse_query("a b c", "words")
        spans = [(s, e) for s in range(1, 41) for e in range(s, 41) if all(any(s <= p <= e for p in found[w]) for w in "abc")]
        least = [x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans)]
        every = {p for own in found.values() for p in own}
        want = sum(0.1 / (1 + (e - s + 1) - sum(s <= p <= e for p in every)) for s, e in least)
        assert fts.cover_density(found, clauses) == pytest.approx(want)


def test_keyword_is_brute_force(spark, small):
    """Registered matches and ranks of every item over every document, from whole texts."""
    from siltstone.plans.registry import fts_english_rank

    docs = {r.doc_id: fts.lexemes(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = []
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        clauses = fts.parse_query(r.text)
        hits = sorted((-fts.cover_density(x, clauses), i) for i, x in docs.items() if fts.matches(x, clauses))
        want += [(r.item_id, k, i, round(-d, 9)) for k, (d, i) in enumerate(hits[:5], 1)]
    got = sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in fts_english_rank(spark, small).collect())
    assert got == sorted(want) and got


def test_batches_of_texts_are_small(spark):
    """A worker gets 8 MB of texts at a time, not a partition, unless the session has set another size."""
    from pyspark.sql import functions as F

    from siltstone.functions.arrow import series

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    rows = series("int")(lambda given: given.map(lambda _: len(given)))
    try:
        for size, most in ((None, 9), (4 << 20, 5)):
            spark.conf.set(name, str(size)) if size else spark.conf.unset(name)
            assert 1 < texts.select(rows("t").alias("n")).agg(F.max("n")).first()[0] <= most
    finally:
        spark.conf.unset(name)
