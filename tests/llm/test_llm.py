"""Each operator against a brute-force version, a library, or a held-out part, and on awkward rows."""

import array
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, graph, html_text, language_id, near_dup, piece_codec, queries, repeats, token_counts, token_output, toxicity, vector_dup, words

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum " * 30_000
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "ONE two"), (6, "é ß 日本 😀 \x00 x"), (7, LONG), (None, "no id at all here"), (8, "a b c d e f g h i j k"), (9, "a b c d e f g h i j k")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Awkward rows, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 1, "x", 0.5, True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, bucket string, score double, kept boolean")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# -- shared parts ---------------------------------------------------------------


def test_hash_words():
    raw = [b"one two\x0bthree", b"", b"  two  ", b"one"]
    hashes, spans, cut, _ = words.hash_words(raw)
    joined = b" ".join(raw) + b" "
    assert [joined[a:b] for a, b in spans] == [b"one", b"two", b"three", b"two", b"one"]
    assert cut.tolist() == [0, 3, 3, 4, 5]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1: language ---------------------------------------------------------------


def test_language(spark, docs, awkward, empty):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = language_id.train(docs.filter(~held_out))
    got = language_id.identify(docs.filter(held_out), net).select((F.col("lang_pred") == F.col("lang")).alias("ok")).collect()
    assert sum(r.ok for r in got) >= 0.9 * len(got)
    rows = language_id.identify(awkward, net).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and len({r.lang_pred for r in rows if r.doc_id == 4}) == 1
    assert language_id.identify(empty, net).count() == 0
    assert language_id.train(empty) is None and {r.lang_pred for r in language_id.identify(awkward, None).collect()} == {"und"}
    kept = language_id.identify(awkward, net, "_l", "_s")
    assert set(awkward.columns) < set(kept.columns) and {r.score for r in kept.collect()} == {0.5}
    net.dense[:], net.bias[:] = 0, 0  # every language is as likely
    tied = language_id.identify(awkward, net).filter(F.col("text").rlike(r"\p{L}")).collect()
    assert tied and {r.lang_pred for r in tied} == {min(net.languages)}


# -- 2: pieces -------------------------------------------------------------------


def test_pieces_match_library(texts):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceTransducer(PIECES)
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab  é日😀\nth.,▁") for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["   a  b ", "\n\n  x", "    " * 20 + "x", "<s> <0x41>"]
    odd += ["".join(rng.choice([" ", "  ", "   ", "a", "the", "ing"]) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    pieces = [p.replace("▁", " ") for p in own.piece]
    odd += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for t in [*list(texts.values())[:60], *odd]:
        ids = own.encode(t)
        assert library.encode(t) == list(array.array("I", ids))
        assert own.decode(ids) == library.decode(library.encode(t))


def test_long_runs_without_a_space():
    """Neighbours inside no piece, thousands in a row: numbers, CJK, Hangul, Thai, emoji."""
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceTransducer(PIECES)
    rng = random.Random(3)
    for lo, hi in ((0x30, 0x39), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xE01, 0xE30), (0x1F600, 0x1F64F)):
        t = "".join(chr(rng.randint(lo, hi)) for _ in range(5000))
        for text in (t, f"see {t[:2500]}, {t[2500:]}.", " " * 1500 + t, " " * 20_000):
            ids = own.encode(text)
            assert library.encode(text) == list(array.array("I", ids)) and own.decode(ids) == text
    assert sum(map(len, own.known)) < 100_000


def test_neighbours_are_those_of_merging():
    """The weight between two pieces, read off their derivations, against merging their joined text."""
    own, rng = piece_codec.PieceTransducer(PIECES), random.Random(4)
    some = list(own.piece.items())

    def merged(text):
        parts = list(text)
        while found := min(((own.cost[own.piece[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own.piece), default=None):
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    for _ in range(3000):
        (a, i), (b, k) = rng.choice(some), rng.choice(some)
        if merged(a) == [a] and merged(b) == [b]:
            assert (own._weight((i + 1) * own.size + k) == 0) == (merged(a + b) == [a, b])


def test_unigram_path_is_cheapest():
    own = piece_codec.PieceTransducer(PIECES)
    own.merging = False
    cost = {p: own.cost[i] for p, i in own.piece.items() if own.cost[i] < 1e6}

    def brute(t):
        best = [0.0] + [float("inf")] * len(t)
        for j in range(1, len(t) + 1):
            best[j] = min((best[i] + cost[t[i:j]] for i in range(j) if t[i:j] in cost), default=float("inf"))
        return best[-1]

    for t in ("▁hello", "▁tokens", "▁unrelated"):
        assert sum(own.cost[i] for i in own.shortest(t)) == pytest.approx(brute(t))


def test_piece_rows(awkward, empty):
    rows = piece_codec.encode(awkward, PIECES).collect()
    assert len(rows) == len(AWKWARD) and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (1, 2)} == {0} and piece_codec.encode(empty, PIECES).count() == 0
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(awkward.filter("doc_id > 3"), PIECES), PIECES).collect()}
    assert back == {i: t for i, t in AWKWARD if i and i > 3}


# -- 3: near duplicates -----------------------------------------------------------


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def classes(sets):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def near_copies(seed=5, groups=4, size=25):
    """Groups of edited copies, some at the threshold, one group larger than a block in the test below."""
    rng = random.Random(seed)
    out, i = {}, 1000
    for g in range(groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
        for _ in range(size * (1 + 2 * (g == 0))):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            out[i] = " ".join(w)
            i += 1
    return out


def test_near_duplicates(spark, texts):
    every = {**texts, **near_copies()}
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(5)
    for params in (near_dup.NearDupParams(), near_dup.NearDupParams(shingle=4), near_dup.NearDupParams(shingle=4, block=16)):
        sets = {i: shingles(t, params.shingle) for i, t in every.items()}
        want = classes(sets)
        got = {r.doc_id: r for r in near_dup.near_duplicates(frame, params).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_one_id_with_several_texts(spark):
    rng = random.Random(13)
    a, b, c = (" ".join(f"{k}{rng.randint(0, 10**6)}" for _ in range(120)) for k in "abc")
    for rows, want in (
        ([(1, a), (1, b), (2, b + " end"), (3, c)], {1: 1, 2: 1, 3: 3}),
        ([(1, b), (1, a), (2, a + " end"), (4, "  "), (4, c), (5, " "), (5, b + " end")], {1: 1, 2: 1, 4: 4, 5: 1}),
        ([(1, a), (3, a), (3, c), (4, c)], {1: 1, 3: 1, 4: 1}),
    ):
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDupParams(shingle=4)).filter("n_shingles > 0").collect()
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == sum(bool(t.strip()) for _, t in rows)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    p = near_dup.NearDupParams()
    for share in (0.5, 0.8, 0.95):
        both, one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
        a, b = (near_dup.minima(np.concatenate((both, x)), p.minima) & 15 for x in (one, two))
        equal = (a == b).mean()
        assert abs((equal - 1 / 16) / (15 / 16) - share) < 0.15


def test_near_duplicate_rows(awkward, empty):
    rows = near_dup.near_duplicates(awkward, near_dup.NearDupParams(shingle=4)).collect()
    assert len(rows) == len(AWKWARD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.component_id, r.kept, r.n_shingles))
    assert by[1] == {(1, True, 0)} and by[2] == {(2, True, 0)} and by[4] == {(4, True, 1)} and by[5] == {(4, False, 1)} and by[9] == {(8, False, 8)} and by[None] == {(None, True, 2)}
    assert near_dup.near_duplicates(empty).count() == 0


# -- 4: token files ---------------------------------------------------------------


def test_blocks():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (5, 2**32), (4096, 50_000), (777, 3)):
        ids = rng.integers(0, top, n).astype("<u4")
        ids[:: max(1, n // 9)] = 2**32 - 1
        got, at = token_output.unpack_block(raw := token_output.pack_block(ids))
        assert (got == ids).all() and at == len(raw)


def test_cached_encoder_is_the_library(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), token_output.CachedEncoder(WORD_BPE)
    odd = [None, "", "it's THE İ Σ ½ x<|endoftext|>y", "á ß DON'T 'll '' 's'", "\x85a\xa0b \x1cfoo", "I'M we're 12345 $$$a 1a_b", "é 日本"]
    every = [*odd, *texts.values()]
    assert own.encode(every) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in every]


def test_token_files(spark, docs, awkward, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    for frame in (docs, awkward):
        rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or ""), r) for r in frame.collect()) if frame is docs else None
        got = token_output.read_ids(token_output.write_ids(frame, WORD_BPE, 1).repartition(3)).orderBy("start").collect()
        assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
        if rows:
            want = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for (_, t), _ in rows]
            assert [(r.doc_id, bytes(r.ids), r.ids_crc32) for r in got] == [(k[0], w, zlib.crc32(w)) for (k, _), w in zip(rows, want, strict=True)]
        else:
            assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in AWKWARD) and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert token_output.read_ids(token_output.write_ids(empty, WORD_BPE, 1)).count() == 0


def test_block_width_is_the_cheapest():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 50_000, 4096), rng.zipf(1.5, 4096) % 60_000, np.zeros(4096, np.int64), np.append(rng.integers(0, 16, 4000), rng.integers(0, 2**31, 96))):
        sizes = [len(token_output.pack_block(ids.astype("<u4"), (p,))) for p in token_output.PERCENTILES]
        assert len(token_output.pack_block(ids.astype("<u4"))) == min(sizes)


def test_other_rules_go_to_the_library(tmp_path, texts):
    """A file that doesn't lower case is encoded by its own rules."""
    import json

    from tokenizers import Tokenizer

    with open(WORD_BPE, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(file))
    own, library = token_output.CachedEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    some = [*list(texts.values())[:20], "It IS", None]
    assert own.encode(some) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some] and not own.cached
    assert token_output.CachedEncoder(WORD_BPE).cached


def test_block_reader_starts_anywhere():
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    writer = token_output.BlockWriter(sink, block=8)
    ids = np.arange(100, dtype="<u4") * 7
    writer.add([5, None], [ids[:60].tobytes(), ids[60:].tobytes()])
    assert writer.close() == 100
    reader = token_output.BlockReader(pa.BufferReader(sink.getvalue()))
    assert reader.doc_ids == [5, None] and all((reader.ids(a, n) == ids[a : a + n]).all() for a in range(0, 90, 7) for n in (0, 1, 9))


# -- 5: benchmark windows ----------------------------------------------------------


def brute_windows(text, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))

    w, hit, names = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontaminate(spark, awkward, empty, bound):
    ten = "q w e r t y u i o p a s d f"
    rows = [*AWKWARD, (20, f"x {ten.upper()}, tail q w e"), (21, "Short É item, and ab's"), (22, ten + " " + ten), (22, "clean"), (23, "zz " * 200_000 + ten)]
    items = [(1, ten), (2, "short É item"), (2, "SHORT É item"), (3, None), (4, "..."), (10, "q w e r t y u i o p"), (None, "ab s")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    p = decontaminate.DecontaminateParams(broadcast_windows=bound)
    got = decontaminate.contamination(d, b, p).collect()
    named = [(i, t) for i, t in items if i is not None]
    want = sorted((i or -1, *brute_windows(t, named)) for i, t in rows)
    flat = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b.filter("item_id IS NOT NULL"), p).collect())
    assert flat == want and len(got) == len(rows)
    nameless = {r.doc_id: r for r in got}[21]
    assert nameless.n_hit > dict((w[0], w[2]) for w in want)[21] and nameless.n_items == dict((w[0], w[3]) for w in want)[21]
    assert decontaminate.contamination(empty, b, p).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0), p).collect())


# -- 6: repeated passages ------------------------------------------------------------


def brute_repeats(rows, size):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = t.encode().split()
        drop, new = bytearray(len(w)), []
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen and seen[key] < i:
                drop[k : k + size] = b"\1" * size
            new.append(key)
        for key in new:
            seen.setdefault(key, i)
        out[i] = b" ".join(x for x, d in zip(w, drop, strict=True) if not d).decode()
    return out


@pytest.mark.parametrize("params", [repeats.RepeatParams(), repeats.RepeatParams(window=12, phrase=4, shard_phrases=20, shard_words=300)])
def test_repeats(spark, texts, params):
    rng = random.Random(9)
    passages = [" ".join(f"p{rng.randint(0, 99)}" for _ in range(n)) for n in (60, 90, 51, 50, 49)]
    made = {}
    for i in range(5000, 5040):
        parts = [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
        p = rng.choice(passages).split()
        cut = rng.randint(0, 8)
        made[i] = " ".join([parts[0], *p[cut:], parts[1], *(rng.choice(passages).split() if i % 3 else []), parts[2]])
    made[5100] = made[5001]
    made[5101] = "aa bb " * 40
    made[5102] = "aa bb " * 45
    rows = list({**texts, **made}.items())
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_repeats(rows, params.window)
    got = {r.doc_id: r for r in repeats.remove_repeats(frame, params).collect()}
    assert {i: r.kept for i, r in got.items()} == want
    assert all(r.n_removed == r.n_words - len(r.kept.split()) or "\x85" in r.kept for r in got.values() if r.kept.isascii())


@pytest.mark.parametrize("load", [1_000_000, 200])
def test_repeats_within_a_document(spark, load):
    """Passages of an earlier document that a later one has several times in equal surroundings."""
    rng = random.Random(11)
    u, a, p, b, y, z = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(70)) for c in "uapbyz")
    rows = [(1, f"{u} {p} {u}"), (2, f"{a} {p} {b} {y} {a} {p} {b} {z}"), (3, f"{z} {a} {p} {b} {u} {a} {p} {b}"), (4, f"{b} {p} {b} {p} {b} {p} {y}")]
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), repeats.RepeatParams(shard_words=load)).collect()}
    assert got == brute_repeats(rows, 50)


def test_repeats_of_one_id_with_several_texts(spark):
    rng = random.Random(12)
    p, q, u, v = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(70)) for c in "pquv")
    rows = [(1, f"{p} {u}"), (1, f"{v} {q}"), (1, "few words"), (2, f"{q} x {p} y"), (2, f"y {p}"), (2, "z z"), (3, f"{v} {q}"), (3, f"{u} tail"), (4, f"w {p} w"), (4, u)]
    got = sorted((r.doc_id, r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([*rows[:3], (2, "x y"), (2, "y"), (2, "z z"), (3, ""), (3, "tail"), (4, "w w"), (4, "")])


def test_repeat_rows(awkward, empty):
    rows = repeats.remove_repeats(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.n_removed == 0 for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0} and repeats.remove_repeats(empty).count() == 0


# -- 7: pages ---------------------------------------------------------------------


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies, accept them all please</div><div class="layout"><div class="post"><h1>Title &amp; more</h1><p>First   paragraph with a
<a href=x>link</a> and enough words to count, <b>bold</b>.<p>Second &lt;one&gt;, left open<br>after the break<script>var a='</p>'</script><ul><li>item one<li>item two</ul></div>
<aside>Side</aside></div><form><input><button>Go</button></form><section class="comments"><p>Nice post, thank you very much indeed for it</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First paragraph with a link and enough words to count, bold. Second <one>, left open after the break item one item two"
    assert html_text.main_text("<p>only &eacute;") == "only é" and html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<br><img src=x>") == ""
    assert html_text.main_text("plain <text") == "plain" and "deep" in html_text.main_text("<div>" * 3000 + "deep")


def test_main_text_without_one_article():
    """Content in several subtrees, with and without tags and names that give it away."""
    body = lambda c: " ".join(f"{c}{i}" for i in range(75))
    block = lambda c, tag="div": f"<{tag}>" + "".join(f"<p>{body(c + str(i) + 'x')}</p>" for i in range(6)) + f"</{tag}>"
    want = lambda *cs: " ".join(body(c + str(i) + "x") for c in cs for i in range(6))
    links = "<div>" + "".join(f"<a href=/{i}>link {i}</a> " for i in range(9)) + "</div>"
    assert html_text.main_text(f"<body>{links}{block('a')}{block('b')}{block('c')}{links}</body>") == want("a", "b", "c")
    assert html_text.main_text(f"<body><div>{links}<div>{block('a')}<h2>Next</h2>{block('b')}</div></div></body>") == f"{want('a')} Next {want('b')}"
    assert html_text.main_text(f"<body>{links}{block('a', 'article')}{block('b', 'article')}{block('c', 'article')}</body>") == want("a", "b", "c")
    assert html_text.main_text(f"<body>{links}<div class='content no-sidebar widget'>{block('a')}{block('b')}</div><div class=cookie>We use cookies</div></body>") == want("a", "b")
    assert html_text.main_text(f"<body>{block('a')}{block('b')}<article><a href=/x>Read on</a></article></body>") == want("a", "b")


def test_comments_never_replace_an_article():
    """Comments outweigh the article in text and in density, and go all the same, whatever holds them."""
    p = lambda name, n: "".join(f"<p>{name} paragraph {k} " + "of some words, and more of them. " * 6 + "</p>" for k in range(n))
    want = html_text.main_text(f"<body><article><h1>Head</h1>{p('text', 3)}</article></body>")
    assert want.startswith("Head text paragraph 0")
    for tag in ("article", "div", "section"):
        for open_, close in (("<div id='comments'>", "</div>"), ("<section class=comments>", "</section>"), ("<ol class='comment-list'><li>", "</ol>"), ("<div id=disqus_thread-comments><div>", "</div></div>")):
            assert html_text.main_text(f"<body><{tag}><h1>Head</h1>{p('text', 3)}</{tag}>{open_}{p('reader', 6)}{close}</body>") == want
            assert html_text.main_text(f"<body><{tag}><h1>Head</h1>{p('text', 3)}{open_}{p('reader', 6)}{close}</{tag}></body>") == want
    # another aside's name on what is the article: what is left is none
    assert html_text.main_text(f"<body><p>One line.</p><div class=widget><h1>Head</h1>{p('text', 3)}</div></body>").endswith(want)
    assert html_text.main_text(f"<body><div class=comments>{p('reader', 2)}</div></body>").startswith("reader paragraph 0")


def test_parser_is_linear():
    import time

    n = 100_000
    for page in ("<b>" * n + "</i>" * n, "<div>" * n + "</b>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p><table><td>" + "<b>" * n + "<hr>" * n, "<td><div>" * (n // 4) + "<tr>" * n, "<ul><li>" * (n // 4) + "<li>" * n):
        began = time.process_time()
        html_text.parse(page)
        assert time.process_time() - began < 4, page[:20]


def test_density_alone(spark, small):
    """Most given pages come out right without any list of tags or names of asides, markup apart."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    right = 0
    for page in pages:
        want = html_text.text_of(html_text.parse("<article>" + re.search(r"<article>(.*)</article>", page, re.S)[1] + "</article>"))
        chosen = html_text.select(html_text.parse(page, names=False))
        right += " ".join(t for n in chosen if (t := html_text.text_of(n))) == want
    assert right >= 0.6 * len(pages)


def test_selected_subtrees():
    """What is selected on random trees, by the rule: the largest sum is in it, and whatever else is has a share of it and the path's density."""
    rng = random.Random(14)

    def grow(depth):
        kids = "".join(grow(depth + 1) for _ in range(rng.randint(0, 4))) if depth < 4 else ""
        tag = rng.choice(["div", "p", "section", "article", "ul"])
        link = f"<a href=/>{'link ' * rng.randint(1, 6)}</a>" if rng.random() < 0.3 else ""
        return f"<{tag}>{'word ' * rng.choice([0, 1, 20, 60])}{link}{kids}</{tag}>"

    for _ in range(300):
        root = html_text.parse(f"<body x=y>{''.join(grow(0) for _ in range(rng.randint(1, 4)))}</body>")
        chosen = html_text.select(root)
        every = [n for n in html_text.density(root) if n.chars]
        if not every:
            continue
        best = max(every, key=html_text._rank)
        path = list(html_text._ancestors(best))
        floor = min(n.density for n in path if not n.inline)
        assert any(n in path or any(x is best for x in html_text._ancestors(n)) for n in chosen)
        for n in chosen:
            up = list(html_text._ancestors(n))
            assert not any(x in chosen for x in up[1:])
            assert n in path or any(x.density >= floor for x in up) and (max(n.total, n.density) >= html_text.SHARE * best.total or n.tag in html_text.HEADINGS or any(x is best or x.parent in path for x in up))


def test_names_of_asides():
    keep = "post comments-on", "content-header", "no-sidebar", "adrift", "article-footer", "main", ""
    drop = "ad", "Sidebar", "cookie-notice", "comment-list", "site_footer", "main-nav", "widget related-posts"
    assert not any(map(html_text._names_aside, keep)) and all(map(html_text._names_aside, drop))
    page = "<body><div class='{}'><h2>Head</h2><p>" + "words of the text " * 20 + "</p></div><div class='{}'>Buy this and that now, it is cheap</div></body>"
    for one in ("post comments-on", "left-sidebar"):
        assert html_text.main_text(page.format(one, "ad")) == "Head " + ("words of the text " * 20).strip()
    assert html_text.main_text("<div class=ad>all there is</div>") == "all there is"


def test_captions_and_open_quotes():
    p = "<p>" + "some of the words " * 12 + "</p>"
    assert "A caption here" in html_text.main_text(f"<body><div>{p}<figure><img src=x><figcaption>A caption here</figcaption></figure>{p}</div></body>")
    assert html_text.main_text('hello <a href="x>y z') == "hello y z" and html_text.main_text("<p title='it>one</p><p>two</p>" * 1) == "one two"


def test_density_of_small_trees():
    """Densities and sums against their definition on a tree without formatting."""
    import math

    root = html_text.parse("<body x=y><div><p>twelve chars</p><p>and more of <a href=/>it</a> here</p></div><ul><li><a href=/>link</a></li><li><a href=/>next</a></li></ul></body>")

    def count(n):
        own = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        kids = [(k, count(k)) for k in n.kids if not isinstance(k, str)]
        c, t = own + sum(x[0] for _, x in kids), sum(x[1] + 1 for _, x in kids)
        return c, t, c if n.tag == "a" else sum(x[2] for _, x in kids), sum(x[3] + (k.tag == "a") for k, x in kids)

    every = html_text.density(root)
    all_c, _, all_l, _ = count(root)
    for n in every:
        c, t, lc, lt = count(n)
        want = c and c / max(t, 1) * math.log(c / max(lc, 1) * (max(t, 1) / max(lt, 1)), c / max(c - lc, 1) * lc + all_l / all_c * c + math.e)
        assert n.density == pytest.approx(max(want, 0.0), abs=1e-4)
        assert n.total == pytest.approx(sum(k.density for k in n.kids if not isinstance(k, str)))


def test_threshold_prunes():
    """A list of links beside the article is below the least density on the body's path."""
    text = "".join(f"<p>{'word after word in a long enough line ' * 4}</p>" for _ in range(5))
    links = "<div>" + "".join(f"<p><a href=/{i}>read {i}</a> on</p>" for i in range(12)) + "</div>"
    root = html_text.parse(f"<body><div>{text}</div>{links}</body>")
    chosen = html_text.select(root)
    best = max(html_text.density(root), key=html_text._rank)
    floor = min(n.density for n in html_text._ancestors(best))
    assert chosen == [best] and all(n.density < floor for n in html_text.density(root) if n.tag == "div" and n is not best)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_pages(spark, small, tag):
    """With and without the tag that names the article."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", f"<$1{tag}>"))).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", raw[r.page_id], re.S)[1]
        import html

        assert r.text.split() == html.unescape(re.sub(r"<[^>]*>?", " ", article)).split() and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, "<p>x" * 20_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(odd).collect()) == [0, 0, 39_999]


# -- 8: toxicity --------------------------------------------------------------------


def _by_enumeration(e, step):
    """Marginals of label 1, log of the sum over all labellings over that of no label 1, and expected transitions."""
    n, total, mass, two = len(e), np.zeros(len(e)), 0.0, np.zeros((2, 2))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(sum(e[k] * y[k] for k in range(n)) + sum(step[y[k], y[k + 1]] for k in range(n - 1)))
        mass += w
        total += w * np.array(y)
        for k in range(n - 1):
            two[y[k], y[k + 1]] += w
    return total / mass, np.log(mass) - step[0, 0] * (n - 1), two / mass


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(8)
    chain = toxicity.Chain(["a", "b"], np.array([1.0, 2.0]))
    chain.weights[:] = rng.normal(0, 1, len(chain.weights))
    step = chain.step.reshape(2, 2)
    texts = ["a", "b C aaa x1 b", "", "zz A b", "a b a b Q q a"]
    value, edge = chain.emissions(texts)
    first = np.zeros(len(value), bool)
    first[[0, 1, 6, 9]] = True
    got = chain.marginals(value, first)
    x, size = np.zeros((len(texts), 7, 6), int), np.diff(edge)
    for i, t in enumerate(texts):
        f = [chain.features(w) for w in t.split()]
        for k, (word, *rest) in enumerate(f):
            x[i, k] = [word, f[k - 1][0] if k else 0, f[k + 1][0] if k + 1 < len(f) else 0, *rest]
    z, p, joint = chain._pass(x, size)
    assert np.allclose(chain.emission(x)[1, :5], value[1:6])
    for i in range(len(texts)):
        own = slice(edge[i], edge[i + 1])
        want, load, two = _by_enumeration(value[own], step)
        assert np.allclose(got[own], want) and np.allclose(p[i, : size[i]], want)
        if size[i]:
            two[0, 0] -= size[i] - 1
            assert np.allclose(z[i], load) and np.allclose(joint[i], two)


def test_tags_are_no_word_list():
    """The same word is tagged in one neighbourhood and not in another."""
    chain = toxicity.Chain(["rot", "apple", "you"], np.array([3.0, 0.0, 0.0]))
    chain.before[chain.index["you"]], chain.after[chain.index["apple"]] = 3.0, -3.0
    _, _, spans = chain.score(["you rot now", "rot apple pie"], spans=True)
    assert spans == [[(4, 7)], []]


def test_toxicity(spark, awkward, empty):
    rng = random.Random(6)
    bad, rows, labels = ["vile", "scum", "rot"], [], []
    for i in range(600):
        w = [f"n{rng.randint(0, 400)}" for _ in range(rng.randint(10, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.train(d, lab.filter("doc_id IS NULL OR doc_id < 400"))
    got = {r.doc_id: r for r in toxicity.score(d.filter("doc_id >= 400"), chain).collect()}
    truth, text = dict(labels), dict(rows)
    assert sum((r.score >= 0.7) == bool(truth[i]) for i, r in got.items()) >= 0.97 * len(got)
    spans = [text[i][s.start : s.end] for i, r in got.items() for s in r.spans]
    assert spans and sum(s in bad for s in spans) >= 0.95 * len(spans)
    out = toxicity.score(awkward, chain).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, chain).count() == 0 and toxicity.train(d, lab.limit(0)) == 0.0
    assert {r.score for r in toxicity.score(awkward, 0.0).collect()} == {0.0}


def test_spans_of_offending_words(spark):
    """Of documents with one to four of six offending words, in no order, nearly all are tagged in documents not learnt from, and hardly another word."""
    rng = random.Random(31)
    bad, plain = ["scumbag", "moronic", "vile", "Trashy", "idiocy", "loathsome"], [f"w{rng.randint(0, 10**5)}" for _ in range(400)]
    rows = []
    for k in range(900):
        words_ = rng.choices(plain, k=rng.randint(15, 80))
        if k % 3 == 0:
            for w in rng.sample(bad, rng.randint(1, 4)):
                words_.insert(rng.randint(0, len(words_)), w)
        rows.append((k, " ".join(words_), int(k % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(frame.select("doc_id", "text"), frame.filter("doc_id < 600").select("doc_id", "toxic"))
    hit = of = other = 0
    for r in toxicity.score(frame.select("doc_id", "text"), chain).filter("doc_id >= 600").collect():
        text = rows[r.doc_id][1]
        tagged = [text[s.start : s.end] for s in r.spans]
        hit, of = hit + sum(w in bad for w in tagged), of + sum(w in bad for w in text.split())
        other += sum(w not in bad for w in tagged)
        assert (r.score >= 0.7) == (rows[r.doc_id][2] == 1)
    assert hit >= 0.95 * of and other <= 0.05 * of


# -- 9: vectors -----------------------------------------------------------------------


@pytest.mark.parametrize("params", [vector_dup.VectorDupParams(), vector_dup.VectorDupParams(block=20, tile=2)])
def test_vectors(spark, params):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[k] + rng.normal(size=(m, 16)) * s for k, m, s in ((0, 90, 0.01), (1, 60, 0.25), (2, 30, 0.35), (3, 8, 0.0))])
    x = np.concatenate((base, near)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 4), (904, [1.0, None] * 8), (905, [float("inf")] * 16), (906, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= params.cosine
    want_n = linked.sum(1) - 1
    label = np.arange(len(x))
    while (new := np.array([label[linked[i]].min() for i in range(len(x))])).tolist() != label.tolist():
        label = new
    got = {r.vec_id: r for r in vector_dup.near_vectors(frame, params).collect()}
    assert [got[i].n_links for i in range(len(x))] == want_n.tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd) and len(got) == len(rows) + len(odd)
    assert vector_dup.near_vectors(frame.limit(0), params).count() == 0


def test_vectors_of_any_length(spark):
    """Components too small or too large to be squared: the same links as of the vectors at length one."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(90, 6))
    base[30:60] = base[:30] + rng.normal(size=(30, 6)) * 0.1
    scale = np.array([1e-200, 1.0, 1e200, 1e-300, 1e150, 1e307])[np.arange(90) % 6]
    x = base / np.abs(base).max(1, keepdims=True) * scale[:, None]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(1) - 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [1e-200] * 6), (91, [0.0] * 6)]
    extra = (unit @ (np.ones(6) / np.sqrt(6))) >= 0.9
    got = {r.vec_id: r.n_links for r in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vector_dup.VectorDupParams(block=16, tile=2)).collect()}
    assert [got[i] for i in range(90)] == (want + extra).tolist() and got[90] == extra.sum() and got[91] == 0


def test_vectors_are_compared_as_doubles(spark):
    """Two pairs around the threshold that single precision can't tell apart."""
    import math

    turn = math.acos(0.9)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(turn - 1e-9), math.sin(turn - 1e-9)]), (3, [0.0, 1.0]), (4, [-math.sin(turn + 1e-9), math.cos(turn + 1e-9)])]
    got = {r.vec_id: r.n_links for r in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


# -- 10: token counts -------------------------------------------------------------------


def test_token_counts(spark, texts, awkward, empty):
    encoder = token_counts.SpanEncoder(BYTE_BPE, public_tokenizers.PATTERN)
    rows = token_counts.token_counts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE_BPE, public_tokenizers.PATTERN).collect()
    for r in rows[:80]:
        t = texts[r.doc_id]
        lines, counts = t.splitlines(keepends=True) if "\r" not in t and "\x0b" not in t else [], collections.Counter()
        start, end = encoder.spans(t)
        assert r.n_tokens == len(encoder.encoding.encode_ordinary(t)) == sum(r.section_tokens) == sum(r.field_tokens)
        if t.isascii() and lines and len(lines) == r.n_sections:
            edges = np.cumsum([0, *map(len, lines)])
            for s, e in zip(start, end, strict=True):
                held = [min(e, b) - max(s, a) for a, b in zip(edges, edges[1:], strict=False)]
                counts[int(np.argmax(held))] += 1
            assert [counts[k] for k in range(len(lines))] == list(r.section_tokens)
    out = token_counts.token_counts(awkward, BYTE_BPE, public_tokenizers.PATTERN, fields=("lang", "text")).collect()
    assert len(out) == len(AWKWARD) and all(sum(r.field_tokens) + r.n_outside == r.n_tokens for r in out) and token_counts.token_counts(empty, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_crossing_rule():
    one = lambda s, e: token_counts.attribute(np.array([s]), np.array([e]), np.array([0, 4, 10]), np.array([4, 8, 12]))
    assert one(0, 3) == (np.array([0]), 0) and one(3, 6)[0][0] == 1 and one(2, 6)[0][0] == 0 and one(8, 10)[0][0] == -1 and one(3, 6)[1] == 1


# -- registry and pipeline ----------------------------------------------------------------


def test_oracle(spark, small, tmp_path):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        queries.QUERIES[name](spark, small).write.parquet(out := str(tmp_path / name))
        db.execute(f"CREATE OR REPLACE TABLE o AS {sql}")
        db.execute(f"CREATE OR REPLACE TABLE r AS SELECT * FROM '{out}/*.parquet'")
        c = ", ".join(sorted(x[0] for x in db.execute("DESCRIBE o").fetchall()))
        assert sorted(x[:2] for x in db.execute("DESCRIBE o").fetchall()) == sorted(x[:2] for x in db.execute("DESCRIBE r").fetchall()), name
        for a, b in (("o", "r"), ("r", "o")):
            assert db.execute(f"SELECT count(*) FROM (SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b})").fetchall() == [(0,)], name


def test_pipeline(spark, small, texts, docs):
    """Every stage against a brute-force version on its own input."""
    import corpus_pipeline as P
    import sentencepiece

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(9000, "123 ...", "en", "s", 7), (9001, None, "en", "s", None), (9002, items[0][1], "en", "s", 1), (9003, next(t for t in texts.values() if len(t.split()) > 60) + " more", "en", "s", 1)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in P.STAGES:
        rows = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, small)
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "language":
            assert set(got) == {i for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "near_duplicate":
            assert set(got) == set(classes({i: shingles(t, 5) for i, t in rows.items()}).values())
        elif name == "substring":
            want = brute_repeats(list(rows.items()), 50)
            kept = {i: t if want[i].split() == t.split() else want[i] for i, t in rows.items() if want[i] or not t.split()}
            assert {i: r.text for i, r in got.items()} == kept
        elif name == "benchmark":
            assert set(got) == {i for i, t in rows.items() if not brute_windows(t, items)[-1]}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
            assert {i: list(array.array("I", bytes(r.piece_ids))) for i, r in got.items()} == {i: library.encode(t) for i, t in rows.items()}
            break
        assert out.columns == docs.columns
        now = spark.createDataFrame([tuple(r) for r in got.values()], docs.schema)


@pytest.mark.parametrize("label", [None, language_id.UNDETERMINED])
def test_pipeline_language_labels(spark, small, label):
    """No labels, or one that reads undetermined: texts with a letter stay."""
    import corpus_pipeline as P

    texts = ["some words here", "日本", "123 ...", "", None, "more of the words"]
    frame = spark.createDataFrame([(i, t, label) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = P.language(spark, frame, small)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [0, 1, 5]


def test_stages_keep_other_columns(spark, small):
    """Clashing names, repeated ids with different texts, null ids and empty tables, stage by stage."""
    import corpus_pipeline as P

    rng = random.Random(21)
    p, q = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(60)) for c in "pq")
    rows = [(1, p), (2, f"x {p} y"), (2, q), (3, None), (None, "no id"), (4, ""), (4, "some words")]
    names = ("_kept", "_gone", "language", "language_score", "row", "kept", "n_words", "gone", "_deal", "text_key")
    frame = spark.createDataFrame([(i, t, "en", 7, *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"{n} int" for n in names))
    for name, stage in P.STAGES[:-1]:
        out, none = stage(spark, frame, small), stage(spark, frame.limit(0), small)
        assert out.dtypes == frame.dtypes and none.columns == frame.columns and none.count() == 0, name
        got = out.collect()
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in got)
        if name == "substring":
            assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in got) == sorted((i or 0, "x y" if t and t.startswith("x ") else t or "", 3 if t and t.startswith("x ") else 7) for i, t in rows)
        elif name == "near_duplicate":
            assert sorted((r.doc_id or 0, r.text) for r in got if r.doc_id != 3) == [(0, "no id"), (1, p), (4, ""), (4, "some words")]  # one text of 2 is near that of 1, so 2 goes
