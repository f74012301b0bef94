"""The registered queries as queries: columns, folds, ranges, and each row against a library or the text itself."""

import struct
import zlib

import public_tokenizers
import pytest
import tokenizers

from siltstone.llm import queries


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def _fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_query(spark, small, texts):
    out = queries.op1_language_id(spark, small)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    rows = out.collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    learnt = {r.lang for r in docs if _fold(r.doc_id, 4) != 2 and r.lang is not None}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (_fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in learnt if letters else r.lang_pred == "und"


def test_piece_query(spark, small, texts):
    """The registered digest of ids is that of the library's, and every text comes back."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op2_piece_codec(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(struct.pack(f"={len(ids)}I", *ids)), True)


def test_token_output_query(spark, small, texts):
    out = queries.op4_token_output(spark, small)
    assert [c for c, _ in out.dtypes][:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(out.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_html_query(spark, small):
    out = queries.op7_html_text(spark, small)
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split(" ")).strip() for r in out.collect())


def test_toxicity_query(spark, small, texts):
    out = queries.op8_toxicity(spark, small)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_spans": "int"}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (_fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_token_count_query(spark, small, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op10_token_counts(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id] or "")) == sum(r.section_tokens) for r in rows)
