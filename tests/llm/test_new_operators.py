"""Whitening, chat formatting and fill-in-middle, against brute-force versions and on awkward rows."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import chat_format, fill_middle, queries, whitening

LONG = "lorem ipsum\n" * 30_000


# -- 11: whitening ----------------------------------------------------------------------


def brute_fit(rows):
    """n, exact deviations, eigenvalues and covariance of (id, vector) rows, without bit planes."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    moved = np.array([[n * r[i] - s[i] for i in range(d)] for r in x], object)
    cov = np.array((moved.T @ moved) / (n**3), float)
    return n, [int(sum(m * m)) for m in moved], np.sort(np.linalg.eigvalsh(cov))[::-1], np.trace(cov), (moved / n).astype(float)


def check_whitened(out, rows, k):
    n, far, values, trace, centred = brute_fit(rows)
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i, _ in rows} and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    w = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in rows])
    assert [by[i][1].deviation for i, _ in rows] == far and {r.n for r in out} == {n}
    assert np.allclose([by[rows[0][0]][c].explained for c in range(1, k + 1)], values[:k] / trace, rtol=1e-9)
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9 and max(r.identity_error for r in out) < 1e-9
    # each component's direction explains its eigenvalue: w = centred @ v / sqrt(e)
    v = np.linalg.lstsq(centred, w * np.sqrt(values[:k]), rcond=None)[0]
    if len(rows) > centred.shape[1]:
        assert np.allclose(v.T @ v, np.eye(k), atol=1e-7)


def test_scatter():
    rng = np.random.default_rng(3)
    for shape, low, high in (((1, 3), 0, 2), ((63, 5), -9, 9), ((64, 1), 7, 8), ((200, 9), -5_000, 101_000), ((130, 4), -(1 << 40), 1 << 40)):
        x = rng.integers(low, high, shape)
        x[:, 0] = x[0, 0]  # a dimension without a plane
        s, q = whitening.scatter(x, tile=4)
        exact = x.astype(object)
        assert s.tolist() == exact.sum(0).tolist() and q.tolist() == (exact.T @ exact).tolist()


def test_whitening_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    out = queries.op11_whitening(spark, small)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitened(out.collect(), rows, 8)


def test_whitening_awkward(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, [])]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in good + bad], "vec_id long, embedding array<double>, size string, w double").repartition(7)
    few = whitening.WhitenParams(block=16, tile=2)
    check_whitened(whitening.whitened_vectors(frame, few).collect(), good, 5)
    assert whitening.whitened_vectors(frame.limit(0)).count() == 0
    # repeated and null ids, another length, one vector alone, equal vectors, and a huge entry
    odd = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (2, [0.5]), (3, [1e300, -1e300, 1e-300])]
    out = whitening.whitened_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 3 * 2 + 1 + 3 and {r.n for r in out if r.vec_id in (1, None)} == {3}
    assert all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in out if r.vec_id in (2, 3))
    one = [r.whitened for r in out if r.vec_id == 1 and r.component == 1]
    assert one[0] == one[1] != 0 and [r.whitened for r in out if r.component == 2 and r.vec_id == 1] == [None, None]
    wide = [(i, [(-1.0) ** i * 1e9, float(i)]) for i in range(6)]
    exact = brute_fit(wide)
    got = {r.vec_id: r for r in whitening.whitened_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()}
    assert [int(got[i].deviation) for i in range(6)] == exact[1]


# -- 12: chat formatting ----------------------------------------------------------------

ODD = ["", "plain", chat_format.START, chat_format.END, "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x|> <|", "<|other|>", "a\\b\nc", "<|", "x<", "|im_end|>", "日本 😀 <|im_end|", "\\<|im_end|>", "<|im_end|><|im_start|>assistant ok", "\n", "\r\n\x00"]


def brute_parse(text):
    """Turns of a rendered conversation by a plain scan; None where it isn't one."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(chat_format.START, at):
            return None
        line = text.index("\n", at)
        end = text.index(chat_format.END + "\n", line)
        role, said = text[at + len(chat_format.START) : line], text[line + 1 : end]
        if re.search(r"<\|[A-Za-z0-9_]+\|>", role + "\n" + said):
            return None
        names = {"\\\\": "\\", "\\n": "\n", "\\|": "|"}
        turns.append((re.sub(r"\\[\\n|]", lambda m: names[m[0]], role), re.sub(r"<\\(\\*)\|", r"<\1|", said)))
        at = end + len(chat_format.END) + 1
    return turns


def test_chat_round_trip(spark):
    rng = random.Random(9)
    alphabet = ["<", "|", "\\", ">", "\n", "im_end", "im_start", chat_format.END, chat_format.START, "x", "é😀"]
    rows = [(k, 0, "user" if k % 2 else "assistant", t) for k, t in enumerate(ODD)] + [(k, 1, t, t) for k, t in enumerate(ODD)]
    for k in range(100, 260):
        for turn in range(rng.randint(1, 4)):
            rows.append((k, turn, rng.choice(["user", "assistant", "tool", "".join(rng.choices(alphabet, k=4))]), "".join(rng.choices(alphabet, k=rng.randint(0, 12)))))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chats = chat_format.format_chats(frame)
    back = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    for r in chats.collect():
        assert r.identical and brute_parse(r.formatted) == want[r.conv_id] == [tuple(t) for t in back[r.conv_id].turns]
        under = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", u) for u in under] == [t for role, t in want[r.conv_id] if role == "assistant"] == list(back[r.conv_id].loss_texts)
        # only what conflicts is escaped
        if not any("<" in t and "|" in t for x in want[r.conv_id] for t in x):
            assert r.formatted.count("\\") == sum(2 * role.count("\\") + role.count("\n") + t.count("\\") for role, t in want[r.conv_id])
    assert back[0].formatted_chars == len(brute_render(want[0]))


def brute_render(turns):
    return "".join(f"{chat_format.START}{role}\n{text}{chat_format.END}\n" for role, text in turns)


def test_chat_awkward(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 1, "user", "same"), (2, 1, "user", "same"), (None, 1, "user", "x"), (None, 1, "user", "x"), (3, 1, "assistant", LONG)]
    frame = spark.createDataFrame([(*r, "c", 0.5, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, lone double, place int")
    out = chat_format.read_back(chat_format.format_chats(frame)).collect()
    got = sorted((r.conv_id or 0, [tuple(t) for t in r.turns], list(r.loss_texts)) for r in out)
    assert got == [(0, [("user", "x")], []), (0, [("user", "x")], []), (1, [("", ""), ("user", "a"), ("assistant", "b")], ["b"]), (2, [("user", "same")] * 2, []), (3, [("assistant", LONG)], [LONG])]
    assert chat_format.format_chats(frame.limit(0)).count() == 0
    broken = ["<|im_start|>user\nx", "x", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\n<|im_start|>\n<|im_end|>\n", "<|im_start|>u\nx<|im_end|>\ny"]
    read = spark.createDataFrame([(b,) for b in ["", *broken]], "t string").select(chat_format.parse(F.col("t"))).collect()
    assert read[0][0] == [] and all(r[0] is None for r in read[1:])


def test_chat_query(spark, small):
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{small}/conversations.parquet").collect())
    rows += [(-1, 0, "user", ODD[14]), (-1, 1, "assistant", ODD[14])]
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    out = queries.op12_chat_format(spark, small)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1
    got = out.collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))


# -- 13: fill in the middle --------------------------------------------------------------


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or three % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suf}<P>{pre}<M>{mid}" if four % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if four % 100 < spm else "psm", len(pre), len(mid), out


@given(st.integers(-5, 10**12), st.text(st.sampled_from("a\n<PSM>é😀\r\x0b")))
@settings(max_examples=400, deadline=None)
def test_piece_table(doc_id, text):
    params = fill_middle.FillMiddleParams()
    n, form, prefix, middle, table, back = fill_middle.arranged(text.encode(), str(doc_id), params)
    assert (n, form, prefix, middle, table.bytes().decode()) == brute_fim(doc_id, text)
    assert back.bytes().decode() == text and back.digest() == hashlib.sha256(text.encode()).hexdigest()


def test_fill_middle(spark):
    rows = [(1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\n"), (4, "a\nb\nc\n"), (4, "other\n\ntext"), (5, "has <S> in it"), (None, "x\ny\nz"), (6, LONG), (7, "é\n日本\n😀"), (8, "\n\n\n")] + [(100 + k, f"{k}\n" * (k % 9)) for k in range(60)]
    frame = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    for params in (fill_middle.FillMiddleParams(), fill_middle.FillMiddleParams(rate=40, suffix_first=90)):
        out = fill_middle.fill_middle(frame, params)
        got = sorted((r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in out.collect())
        assert got == sorted((i or 0, f[0], f[1], f[2] or 0, f[3] or 0, f[4]) for i, t in rows for f in [brute_fim(i, t, params.rate, params.suffix_first)])
        assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in out.collect())
        assert sorted((r.doc_id or 0, r.text) for r in fill_middle.restore(out, params).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert fill_middle.fill_middle(frame.limit(0)).count() == 0
    # sentinels that run into each other and into the text: what can't be restored stays plain
    odd = fill_middle.FillMiddleParams(sentinels=("aa", "a", "aaa"))
    both = fill_middle.fill_middle(spark.createDataFrame([(k, t) for k, t in enumerate(["b\nc\n", "ba\n", "bb\nbb"] * 9)], "doc_id long, text string"), odd)
    assert all(r.text == t for r, t in zip(fill_middle.restore(both, odd).orderBy("doc_id").collect(), ["b\nc\n", "ba\n", "bb\nbb"] * 9, strict=True))
    wrong = spark.createDataFrame([(1, "psm", "no sentinel"), (2, "other", "x"), (3, "psm", None)], "doc_id long, form string, output string")
    assert [r.text for r in fill_middle.restore(wrong).collect()] == [None] * 3


def test_fill_middle_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op13_fill_middle(spark, small)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        *rest, text = brute_fim(r.doc_id, texts[r.doc_id])
        assert list(r)[1:] == [*rest, sha(text), sha(texts[r.doc_id] or "")]


def test_edges_of_a_large_family_do_not_multiply_with_its_blocks(spark):
    """A bucket of equal signatures in many blocks yields an edge a row, and one a pair of blocks, not a forest for each pair."""
    from pyspark.sql import functions as F

    from siltstone.llm.graph import components
    from siltstone.llm.near_dup import NearDupParams, likely

    params = NearDupParams(block=16)
    rows = spark.range(320).select(F.lit(7).cast("long").alias("bucket"), "id", F.array_repeat(F.lit(5).cast("long"), params.longs).alias("bits"))
    edges = likely(rows, params)
    found = components(edges)
    assert found.filter("component = 0").count() == 320
    assert edges.count() <= 320 + 20 * 19 // 2
