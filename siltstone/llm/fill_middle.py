"""Fill-in-middle documents by piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that
never change: its own UTF-8 bytes and those of the sentinels.  Cutting splits a
descriptor, an arrangement permutes them, the inverse permutation restores the
document, and texts and digests are streamed from the descriptors in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Places of prefix, middle, suffix and the three sentinels (prefix's, suffix's, middle's: 3, 4, 5) in an output.
ORDERS = {PSM: (3, 0, 4, 2, 5, 1), SPM: (4, 2, 3, 0, 5, 1)}
_NEWLINE = ord("\n")


@dataclass(frozen=True)
class FillMiddleParams:
    #: Sentinels of prefix, suffix and middle, and what is put before an id to draw its numbers.
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: str = "7:"
    #: Of a hundred documents those that are arranged, and of a hundred of these those with the suffix first.
    rate: int = 100
    suffix_first: int = 50


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, *buffers: bytes | memoryview):
        self.buffers = tuple(memoryview(b) for b in buffers)
        self.pieces = [(k, 0, len(b)) for k, b in enumerate(self.buffers)]

    def cut(self, piece: int, *at: int) -> None:
        """Split a descriptor at ascending offsets into it; parts may be empty."""
        buffer, start, length = self.pieces[piece]
        edges = [0, *at, length]
        self.pieces[piece : piece + 1] = [(buffer, start + a, b - a) for a, b in zip(edges, edges[1:], strict=False)]

    def arrange(self, order: Sequence[int]) -> None:
        self.pieces = [self.pieces[k] for k in order]

    def restore(self, order: Sequence[int]) -> None:
        """Undo `arrange(order)`."""
        back = [0] * len(order)
        for place, k in enumerate(order):
            back[k] = place
        self.arrange(back)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def unit_edges(text: bytes | memoryview) -> np.ndarray:
    """0 and the end of every unit: a line with its newline, or what follows the last one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == _NEWLINE) + 1
    tail = [len(text)] if len(text) and (not len(ends) or ends[-1] != len(text)) else []
    return np.concatenate(([0], ends, tail)).astype(np.int64)


def code_points(part: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def restored(output: bytes | memoryview, form: str, sentinels: Sequence[bytes]) -> PieceTable | None:
    """The document's table from an output and its form alone; None where the output has not that form."""
    table = PieceTable(output)
    if form == PLAIN:
        return table
    whole, edges, at = bytes(output), [], 0
    for k in (x for x in ORDERS[form] if x > 2):
        at = whole.find(sentinels[k - 3], at)
        if at < 0:
            return None
        edges += [at, at + len(sentinels[k - 3])]
        at = edges[-1]
    if edges[0] != 0:
        return None
    table.cut(0, *edges[1:])
    table.restore(ORDERS[form])
    del table.pieces[3:]
    return table


def arranged(text: bytes | memoryview, doc_id: str, params: FillMiddleParams) -> tuple[int, str, int | None, int | None, PieceTable, PieceTable]:
    """Units, form, code points of prefix and middle, the output's table, and the table restored from the output."""
    sentinels = [s.encode() for s in params.sentinels]
    edges = unit_edges(text)
    n = len(edges) - 1
    seen = hashlib.sha256((params.seed + doc_id).encode()).hexdigest()
    one, two, three, four = (int(seen[8 * k : 8 * k + 8], 16) for k in range(4))
    raw = bytes(text)
    if n and not any(s in raw for s in sentinels) and three % 100 < params.rate:
        low, high = sorted((one % (n + 1), two % (n + 1)))
        form = SPM if four % 100 < params.suffix_first else PSM
        table = PieceTable(text, b"".join(sentinels))
        table.cut(1, *np.cumsum([len(s) for s in sentinels])[:-1].tolist())
        table.cut(0, int(edges[low]), int(edges[high]))
        prefix, middle = (code_points(part) for part in list(table.stream())[:2])
        table.arrange(ORDERS[form])
        back = restored(table.bytes(), form, sentinels)
        if back is not None and back.bytes() == raw:
            return n, form, prefix, middle, table, back
    table = PieceTable(text)
    return n, PLAIN, None, None, table, restored(table.bytes(), PLAIN, sentinels)


def fill_middle(docs: DataFrame, params: FillMiddleParams = FillMiddleParams(), texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with `texts`, output, for every row of `docs` (doc_id, text).

    A null text is empty; an empty text, one that holds a sentinel, and one that
    its output would not give back (with sentinels that run into each other) are
    plain, with null lengths.  A null doc_id draws its numbers from the seed
    alone.  Rows are arranged each for itself, so repeated ones give equal rows;
    other columns are ignored, long texts are taken whole, and an empty table
    gives an empty result.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = []
            for key, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                n, form, prefix, middle, table, back = arranged(text.as_buffer() or b"", key or "", params)
                rows.append((n, form, prefix, middle, table.digest(), back.digest(), table.bytes() if texts else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [*names, "raw"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("text"))
    out = in_arrow(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, raw binary")
    return out.select(*names, *([F.col("raw").cast("string").alias("output")] if texts else []))


def restore(outputs: DataFrame, params: FillMiddleParams = FillMiddleParams()) -> DataFrame:
    """doc_id and text of every row of `outputs` (doc_id, form, output): the documents before they were arranged.

    The text is null where the output is null or has not the form it claims.
    """
    sentinels = [s.encode() for s in params.sentinels]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            back = [restored(o, f, sentinels) if o is not None and (f == PLAIN or f in ORDERS) else None for f, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.bytes() if t else None for t in back], pa.binary())], ["doc_id", "text"])

    rows = outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "form", F.col("output").cast("binary").alias("output"))
    return in_arrow(rows, run, "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))
