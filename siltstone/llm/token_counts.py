"""Token counts of a document's fields and sections, from one encoding of the whole document.

The fields of a row are joined into one text, which is encoded once.  The
character spans of its tokens are then joined with the spans of the sections
(each field's lines, with their line feed).  Rule for a token that crosses a
boundary: it counts wholly for the section that holds most of its characters,
for the earlier one when they hold equally many.  A token that only touches the
separator between two fields counts as outside.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow


class SpanEncoder:
    """A byte-level vocabulary whose tokens are the text's bytes in order, so spans follow from token lengths."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a token that holds a part of a character spans all of it."""
        size = self.length[np.array(self.encoding.encode_ordinary(text), np.int64)]
        end = np.cumsum(size)
        start = end - size
        if text.isascii():
            return start, end
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[start], char[end - 1] + 1


@lru_cache(maxsize=2)
def span_encoder(path: str, pattern: str) -> SpanEncoder:
    return SpanEncoder(path, pattern)


def attribute(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, int]:
    """Join token spans with sorted, disjoint section spans: the section of each token (-1: none), and how many tokens crossed."""
    if not len(lo):
        return np.full(len(start), -1), 0
    first, last = np.searchsorted(hi, start, "right"), np.searchsorted(lo, end, "left") - 1
    section = np.where(first > last, -1, first)
    crossing = np.flatnonzero(last > first)
    for t in crossing:
        k = np.arange(first[t], last[t] + 1)
        section[t] = k[np.argmax(np.minimum(end[t], hi[k]) - np.maximum(start[t], lo[k]))]
    return section, len(crossing)


def sections(parts: list[str], separator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Field, start and end of each line of each field, in the joined text; an empty field has no section."""
    field, edges, at = [], [], 0
    for i, part in enumerate(parts):
        ends = [at]
        here = part.find("\n")
        while here >= 0:
            ends.append(at + here + 1)
            here = part.find("\n", here + 1)
        if ends[-1] < at + len(part):
            ends.append(at + len(part))
        edges += list(zip(ends, ends[1:], strict=False))
        field += [i] * (len(ends) - 1)
        at += len(part) + separator
    span = np.array(edges, np.int64).reshape(-1, 2)
    return np.array(field, np.int64), span[:, 0], span[:, 1]


SCHEMA = "n_tokens long, n_sections long, n_crossing long, n_outside long, field_tokens array<long>, section_tokens array<long>"


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, fields: tuple[str, ...] = ("text",), separator: str = "\n\n") -> DataFrame:
    """One row for each row of `docs`: doc_id, the counts, and the counts by field and by section in order.

    Null fields count as empty; a row without text has no tokens and no
    sections.  Whole texts are encoded, each once, whatever their length.
    Repeated rows repeat; other columns are ignored; an empty table gives an
    empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(vocabulary, pattern)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in zip(*(b.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                parts = [x or "" for x in row]
                field, lo, hi = sections(parts, len(separator))
                start, end = encoder.spans(separator.join(parts)) if any(parts) else (np.empty(0, np.int64),) * 2
                section, crossing = attribute(start, end, lo, hi)
                inside = section[section >= 0]
                counts = np.bincount(inside, minlength=len(lo))
                by_field = np.bincount(field, weights=counts, minlength=len(parts)).astype(np.int64)
                for column, value in zip(out, (len(start), len(lo), crossing, len(start) - len(inside), by_field, counts), strict=True):
                    column.append(value)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, long) for x in out[:4]), *(pa.array(x, pa.list_(long)) for x in out[4:])], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)))
    return in_arrow(picked, count, f"doc_id long, {SCHEMA}")
