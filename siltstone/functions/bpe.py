"""Byte-pair tokens by the ranks of a vocabulary file, and windows of them."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column

from siltstone.functions.arrow import series

#: Pieces up to this many bytes are remembered, as many of them as this.
_SHORT, _MOST = 64, 200_000


class Vocabulary:
    """Token ids of a rank file (a line for each: the bytes in base64, the rank) under a pattern that first cuts texts into pieces.

    Within a piece the two neighbours whose union has the lowest rank are merged,
    the left ones of equals, until no two neighbours' union has one.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            self.ranks = {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self._pattern = regex.compile(pattern)
        self._seen: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece; a queue of mergeable neighbours keeps long pieces in n log n."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbours' parts
        alive = [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(piece[i : after[j]])) is not None:
                heapq.heappush(queue, (rank, i, after[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue  # one of the two has been merged with another since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for m in self._pattern.finditer(text or ""):
            piece = m[0].encode("utf-8", "surrogatepass")
            ids = self._seen.get(piece)
            if ids is None:
                ids = self.merged(piece)
                if len(piece) <= _SHORT:
                    if len(self._seen) >= _MOST:
                        self._seen.clear()
                    self._seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no whole character become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def windows(self, ids: list[int], size: int, step: int, whole: bool = False) -> Iterator[str]:
        """Texts of windows of `size` ids, `step` apart, until one reaches the end.

        A window may begin or end within a character.  Its bytes there become
        U+FFFD, or, with `whole`, the window takes the character's other bytes
        from its neighbours at its end and leaves those at its beginning to the
        window before, so that windows without overlap join to the text.
        """
        if not whole:
            for lo in self._starts(len(ids), size, step):
                yield self.decode(ids[lo : lo + size])
            return
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        edges = [0]
        for i in ids:
            edges.append(edges[-1] + len(self.bytes_of[i]))

        def border(at: int) -> int:
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            return at

        for lo in self._starts(len(ids), size, step):
            yield raw[border(edges[lo]) : border(edges[min(lo + size, len(ids))])].decode("utf-8", "replace")

    @staticmethod
    def _starts(n: int, size: int, step: int) -> Iterator[int]:
        for lo in range(0, n, step):
            yield lo
            if lo + size >= n:
                return


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """A vocabulary, read once a worker."""
    return Vocabulary(path, pattern)


def token_ids(texts: Column | str, path: str, pattern: str) -> Column:
    return series("array<int>")(lambda given: given.map(lambda t: vocabulary(path, pattern).encode(t)))(texts)


def token_count(texts: Column | str, path: str, pattern: str) -> Column:
    return series("int")(lambda given: given.map(lambda t: len(vocabulary(path, pattern).encode(t))).astype("int32"))(texts)


def text_of(ids: Column | str, path: str, pattern: str) -> Column:
    return series("string")(lambda given: given.map(lambda x: None if x is None else vocabulary(path, pattern).decode(list(x))))(ids)


def token_windows(texts: Column | str, path: str, pattern: str, size: int, step: int, whole: bool = False) -> Column:
    """Texts of the windows of each text; none of an empty or null one."""

    def run(given: pd.Series) -> pd.Series:
        v = vocabulary(path, pattern)
        return given.map(lambda t: list(v.windows(v.encode(t), size, step, whole)))

    return series("array<string>")(run)(texts)
