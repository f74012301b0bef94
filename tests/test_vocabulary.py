"""Byte-pair tokens against the public library, and templates against the language's own."""

import random
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import bpe, template
from siltstone.operators import chunks as C

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
OWN = bpe.Vocabulary(FILE, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_encode(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and OWN.decode(ids) == text


def test_encode_hard_pieces(small, spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r.text]
    texts += ["a" * 5000, "1" * 3000, "日本語" * 900, "😀👩‍👩‍👧" * 300, "".join(rng.choices("abcdefgh", k=20_000)), " \n\t" * 2000, "é́" * 500, "don't we'll I'M"]
    for t in texts:
        assert OWN.encode(t) == LIBRARY.encode_ordinary(t)
    long = "".join(rng.choices("abcdefgh", k=400_000))
    assert OWN.decode(OWN.encode(long)) == long


def _library_windows(text):
    ids, out = LIBRARY.encode_ordinary(text), []
    for lo in range(0, len(ids), 200):
        out.append(LIBRARY.decode(ids[lo : lo + 250]))
        if lo + 250 >= len(ids):
            break
    return out


def test_windows(spark, small):
    """Fixed chunks equal the library's windows, broken characters and the merge of tiny ones included."""
    rng = random.Random(6)
    texts = [None, "", "short", "日本語😀" * 400, "".join(rng.choices("日本😀é a\n", k=3000)), *(r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect())]
    frame = spark.createDataFrame([(str(k), str(k), t) for k, t in enumerate(texts)], "id string, document_id string, raw_text string")
    got = {}
    for r in C.chunk(frame, "fixed", (FILE, PATTERN)).orderBy("chunk_index").collect():
        got.setdefault(int(r.section_id), []).append((r.text, r.token_count))
    want = {k: C.merge_tiny(_library_windows(t)) for k, t in enumerate(texts) if t}
    assert {k: [t for t, _ in v] for k, v in got.items()} == want
    assert all(n == len(LIBRARY.encode_ordinary(t)) for v in got.values() for t, n in v)
    assert "�" in "".join(want[3] + want[4])
    counts = C.chunk(frame, "recursive", (FILE, PATTERN)).select("text", "token_count").collect()
    assert all(r.token_count == len(LIBRARY.encode_ordinary(r.text)) for r in counts)
    for t in texts[3:20]:
        ids = OWN.encode(t)
        assert "".join(OWN.windows(ids, 50, 50, whole=True)) == t and "�" not in "".join(OWN.windows(ids, 50, 40, whole=True)).replace("�" if "�" in t else "\0", "")
    row = frame.filter("id = '4'").select(bpe.text_of(bpe.token_ids("raw_text", FILE, PATTERN), FILE, PATTERN).alias("t"), "raw_text").first()
    assert row.t == row.raw_text


# -- templates -------------------------------------------------------------------------


@given(st.lists(st.one_of(st.sampled_from(["{a}", "{b}", "{{", "}}", "{", "}", "{a!r}", "{a:>3}", "{}", "{0}"]), st.text("xy {}\n", max_size=5)), max_size=8).map("".join))
@settings(max_examples=500, deadline=None)
def test_template_is_format(text):
    values = {"a": "ay", "b": "{b}"}
    try:
        cut = list(template.parts(text))
    except template.TemplateError:
        try:
            text.format_map(values)
        except (ValueError, KeyError, IndexError, AttributeError):
            return
        assert re.search(r"\{[^{}]*[^\w{}][^{}]*\}|\{\d*\}", text)  # a conversion, a width, an attribute or no name: not offered
        return
    if set(template.names(text)) <= values.keys():
        assert "".join(values[t] if is_name else t for is_name, t in cut) == text.format_map(values)
    else:
        with pytest.raises(template.TemplateError, match="no value"):
            template.compiled(text, dict.fromkeys(values.keys() & set(template.names(text)), "x"))


def test_template_columns(spark):
    row = spark.createDataFrame([("q", None, 3)], "question string, other string, n int")
    got = row.select(template.compiled('{n} {question}{other} {{"k": "{question}"}}', {"n": "n", "question": F.upper("question"), "other": "other"})).first()[0]
    assert got == '3 Q {"k": "Q"}' and row.select(template.compiled("", {})).first()[0] == ""
    for text, values, why in (("{a}", {}, "no value for a"), ("x", {"a": "n"}, "no place for a"), ("}", {}, "single"), ("{a", {"a": "n"}, "expected"), ("{a.b}", {}, "expected"), ("{}", {}, "expected")):
        with pytest.raises(template.TemplateError, match=why):
            template.compiled(text, values)
