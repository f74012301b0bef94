"""SentencePiece encoding and decoding as weighted finite-state transduction.

Four machines are compiled from a model file:

* the normaliser rewrites symbols (a space becomes its visible mark) and emits
  the mark in front when it leaves its start state;
* the pieces, a trie as one transition table: a state is the string read so far,
  its entry the piece it accepts, if any;
* byte fallback reads a symbol that is no piece and emits its bytes' pieces, at a
  weight no path of pieces comes near;
* for a merge (BPE) model the neighbours, an acceptor whose states are pieces and
  whose weight between two is 0 or infinite.

A text is run through the normaliser and composed with the rest: a state of the
composition is a place in the text with the piece that ends there.  Its shortest
path in the tropical semiring (least sum of weights) is the encoding.

The arc weights are the negative scores for a unigram model.  In a merge model
the scores are an order of merging, not costs, so pieces weigh nothing and the
neighbours decide: a sequence of pieces is what merging gives exactly when every
two neighbours are what merging gives for their joined text.  Whether they are
is read off their derivations.  At the joint a piece shows a growing string, its
own last (or first) symbol, then what that was merged into, and so on, each from
a certain step of the order on; two neighbours stay apart if at no time the two
strings then at the joint are a piece that comes before either's next growth.
Pieces of equal score (those of marks alone) merge from the left.

No piece spans a space that follows another character, so texts are cut there
and each distinct cut is solved once per worker, in a bounded cache; in a merge
model so is each part of it between neighbours that no piece holds together.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow

MARK = "▁"
_CHUNK = re.compile(rf"{MARK}*[^{MARK}]*")
_CACHE_ENTRIES, _PAIR_ENTRIES = 200_000, 400_000  # some 40 MB each
_CACHED_CHARS = 100  # longer chunks seldom recur
_NORMAL, _BYTE, _UNKNOWN, _UNIGRAM = 1, 6, 2, 1  # fixed values of the model format
_FALLBACK = 1e6  # weight of byte fallback, beyond any path of pieces through one symbol


class Normaliser:
    """A transducer of two states: the start emits `prefix`, and then each symbol is read and written."""

    def __init__(self, prefix: str):
        self.prefix, self.table = prefix, {" ": MARK}

    def __call__(self, text: str) -> str:
        for read, written in self.table.items():
            text = text.replace(read, written)
        return self.prefix + text


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only identity normalisers that keep white space are compiled")
        self.normalise = Normaliser(MARK if rules.add_dummy_prefix else "")
        self.merging = model.trainer_spec.model_type != _UNIGRAM
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.piece = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.text = [p.piece for p in model.pieces]
        self.cost = [-p.score for p in model.pieces]
        byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte = [byte.get(b, self.unknown) for b in range(256)] if byte else []
        self.raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else b" \xe2\x81\x87 " if p.type == _UNKNOWN else b"" for p in model.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece spans words")
        #: The trie: a state is a table from the symbol read to the next state and the piece accepted there, or -1.
        self.trie: dict[str, list] = {}
        for p, i in self.piece.items():
            state = self.trie
            for c in p:
                arc = state.setdefault(c, [{}, -1])
                state = arc[0]
            arc[1] = i
        self.longest = max(map(len, self.piece), default=1)
        #: Neighbouring characters inside pieces; no piece, and so no merge, reaches over any other pair.
        self.bridged = {(a, b) for p in self.piece for a, b in zip(p, p[1:], strict=False)}
        self.size = len(self.text)
        self.pairs: dict[int, float] = {}
        self.known: dict[str, bytes] = {}
        self.grown: dict[int, tuple[list[tuple[float, str]], list[tuple[float, str]]] | None] = {}

    # -- the acceptor of neighbours -------------------------------------------

    def _merge(self, text: str) -> list[tuple[float, int, str]]:
        """The merges of a text in order: cost, place, and the string that comes of it; the best score first, the leftmost of equals."""
        n, left, right, symbol = len(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), list(text)
        heap: list[tuple[float, int, str]] = []
        done = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n and (joined := symbol[i] + symbol[right[i]]) in self.piece:
                heapq.heappush(heap, (self.cost[self.piece[joined]], i, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = step = heapq.heappop(heap)
            if not symbol[i] or right[i] >= n or symbol[i] + symbol[right[i]] != joined:
                continue
            done.append(step)
            gone = right[i]
            symbol[i], symbol[gone], right[i] = joined, "", right[gone]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return done

    def _growth(self, piece: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """The strings at a piece's right and left end, each with the time it appears; None for a piece that merging can't make."""
        if piece in self.grown:
            return self.grown[piece]
        text = self.text[piece]
        steps, time = self._merge(text), -math.inf
        last, first = [(time, text[-1])], [(time, text[0])]
        for cost, at, joined in steps:
            time = max(time, cost)  # a merge that waited for another happens right after it
            if at + len(joined) == len(text):
                last.append((time, joined))
            if at == 0:
                first.append((time, joined))
        found = (last, first) if last[-1][1] == text else None
        self.grown[piece] = found
        return found

    def _weight(self, key: int) -> float:
        """0 if merging leaves this pair of pieces (or this piece, at the start) as it is, else infinite."""
        before, piece = divmod(key, self.size)
        two = self._growth(piece)
        found = 0.0 if two else math.inf
        if before and two:
            ends, starts, i, j = self._growth(before - 1)[0], two[1], 0, 0
            while True:
                grow_left = ends[i + 1][0] if i + 1 < len(ends) else math.inf
                grow_right = starts[j + 1][0] if j + 1 < len(starts) else math.inf
                joined = self.piece.get(ends[i][1] + starts[j][1])
                if joined is not None and self.cost[joined] < grow_left and self.cost[joined] <= grow_right:
                    found = math.inf
                    break
                if grow_left is math.inf and grow_right is math.inf:
                    break
                if grow_left <= grow_right:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) >= _PAIR_ENTRIES:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    # -- composition and shortest path ----------------------------------------

    def shortest(self, chunk: str) -> list[int]:
        """Pieces on the shortest path through the composition of `chunk` with the machines.

        Arcs wait in order of their path's weight, of equal ones the one that
        reaches furthest first, and the first to reach a place settles it; the
        weight between two neighbours, which is 0 or infinite, is asked for only
        when an arc's turn comes.  In a unigram model the piece that ends at a
        place says nothing about what may follow; in a merge model merging a
        beginning of the text has one result, so one path of finite weight leads
        to each place.  Either way a place is one state.

        Where all arcs weigh the same the queue is a stack: arcs from the place
        just settled reach further than any that wait.
        """
        if self.merging and self.piece.keys() >= set(chunk):
            return self._furthest(chunk)
        n, size, pair, cost, merging = len(chunk), self.size, self.pairs.get, self.cost, self.merging
        last, back = [-2] * (n + 1), [0] * (n + 1)
        waiting: list[tuple[float, int, int, int]] = []
        push, pop = heapq.heappush, heapq.heappop
        here, i = 0.0, 0
        while i < n:
            j, state = i, self.trie
            while j < n:
                arc = state.get(chunk[j])
                if arc is None:
                    break
                j += 1
                state, piece = arc
                if piece >= 0 and last[j] == -2:
                    push(waiting, (here if merging else here + cost[piece], -j, i, piece))
            if chunk[i] not in self.piece:
                push(waiting, (here + _FALLBACK, -i - 1, i, -1))
            while True:
                here, j, i, piece = pop(waiting)
                if last[-j] != -2:
                    continue
                if merging and piece >= 0:
                    before = (last[i] + 1) * size if i else 0
                    weight = pair(before + piece)
                    if weight is None:
                        weight = self._weight(before + piece)
                    if weight:
                        continue
                last[-j], back[-j] = piece, i
                i = -j
                break
        path: list[int] = []
        while n:
            path += [last[n]] if last[n] >= 0 else self._bytes(chunk[back[n]])[::-1]
            n = back[n]
        return path[::-1]

    def _furthest(self, chunk: str) -> list[int]:
        """The shortest path where no arc weighs anything but the neighbours' 0 or infinity."""
        n, size, pair, trie = len(chunk), self.size, self.pairs.get, self.trie
        last, back = [-1] * (n + 1), [0] * (n + 1)
        waiting: list[tuple[int, int, int]] = []
        i = 0
        while i < n:
            j, state = i, trie
            for c in chunk[i : i + self.longest]:
                arc = state.get(c)
                if arc is None:
                    break
                j += 1
                state, piece = arc
                if piece >= 0:
                    waiting.append((j, i, piece))
            while True:
                j, i, piece = waiting.pop()
                if last[j] >= 0:
                    continue
                key = (last[i] + 1) * size + piece
                weight = pair(key)
                if (self._weight(key) if weight is None else weight) == 0:
                    last[j], back[j], i = piece, i, j
                    break
        path: list[int] = []
        while n:
            path.append(last[n])
            n = back[n]
        return path[::-1]

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def _solve(self, chunk: str) -> bytes:
        if self.merging and (len(chunk) > _CACHED_CHARS or not chunk[1:].isalpha()):
            cuts = [k for k, two in enumerate(zip(chunk, chunk[1:], strict=False), 1) if two not in self.bridged]
            if cuts:
                return self._keep(chunk, b"".join(self._segment(chunk[i:j]) for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)))
        return self._segment(chunk)

    def _segment(self, segment: str) -> bytes:
        """A part of a chunk between two pairs that no piece reaches over."""
        return self.known.get(segment) or self._keep(segment, array("I", self.shortest(segment)).tobytes())

    def _keep(self, chunk: str, raw: bytes) -> bytes:
        if len(chunk) > _CACHED_CHARS:
            return raw
        if len(self.known) >= _CACHE_ENTRIES:
            self.known.clear()
        self.known[chunk] = raw
        return raw

    def encode(self, text: str | None) -> bytes:
        """Piece ids of a whole text as native unsigned 32-bit integers."""
        if not text:
            return b""
        known, out, symbols = self.known, [], self.normalise(text)
        if MARK * 2 in symbols or not symbols.startswith(MARK):
            chunks = [c for c in _CHUNK.findall(symbols) if c]
        else:
            chunks = [MARK + c for c in symbols[1:].split(MARK)]
        for c in chunks:
            out.append(known.get(c) or self._solve(c))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The inverse machine: pieces to bytes, the mark to a space, the prefix taken off."""
        raw = b"".join(map(self.raw.__getitem__, array("I", ids)))
        if self.normalise.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encode(docs: DataFrame, model: str, keep_ids: bool = True, check: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip and, if asked for, piece_ids, for every row of `docs`.

    `round_trip` says whether decoding the ids gives the text back; it is false
    only for texts that hold the mark itself, which the normaliser makes a
    space.  Null and empty texts have no pieces and round-trip to empty.
    Repeated rows repeat; other columns are ignored; texts of any length are
    encoded whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in batches:
            docs, texts = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 256):
                part = texts.slice(lo, 256).to_pylist()
                ids = [machine.encode(t) for t in part]
                columns = [docs.slice(lo, 256), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                columns.append(pa.array([machine.decode(x) == (t or "") for t, x in zip(part, ids, strict=True)] if check else [None] * len(ids), pa.bool_()))
                if keep_ids:
                    columns.append(pa.array([x for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "round_trip", "piece_ids"][: len(columns)])

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", piece_ids binary" * keep_ids
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and piece_ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([machine.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "piece_ids"), run, "doc_id long, text string")
