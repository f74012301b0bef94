"""Words of many texts at once, as 64-bit hashes.

Words are the runs of bytes other than space and \\x09-\\x0D, hashed by a
polynomial over random byte values.  Everything is array work over a batch of
texts; no word becomes a Python object.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = 1 << 16
#: Bytes hashed at a time; only a longer word takes more.
_SEGMENT = 1 << 20


def _table(base: int) -> np.ndarray:
    """base ** 0 to base ** 65535, modulo 2 ** 64."""
    have = np.ones(1, np.uint64)
    while len(have) < _LOW:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    return have


@lru_cache(maxsize=16)
def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(base), _table(pow(base, _LOW, 1 << 64))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64, from two tables of fixed size."""
    low, high = _tables(base % (1 << 64))
    return low[:n] if n <= _LOW else np.multiply.outer(high[: -(-n // _LOW)], low).ravel()[:n]


def power_at(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** e, modulo 2 ** 64, for exponents below 2 ** 32."""
    low, high = _tables(base % (1 << 64))
    return low[exponents & (_LOW - 1)] * high[exponents >> 16]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and spans of the words of `data`, which ends in a gap."""
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * power_at(_INVERSE, start) + (end - start).astype(np.uint64)), np.stack((start, end), 1)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the words' byte spans in the joined texts, and the number of words before each text and after the last.

    A word's hash depends on its bytes alone, so long texts are hashed in
    segments that end in gaps, and memory beside the result stays bounded.
    """
    raw = b" ".join(texts) + b" "
    data = np.frombuffer(raw, np.uint8)
    hashes, spans, at = [], [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while not SPACE[data[end - 1]]:
            more = np.flatnonzero(SPACE[data[end : end + _SEGMENT]])
            end = end + int(more[0]) + 1 if len(more) else min(end + _SEGMENT, len(data))
        h, s = _hash_segment(data[at:end])
        hashes.append(h)
        spans.append(s + at)
        at = end
    spans = np.concatenate(spans)
    sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), spans, np.searchsorted(spans[:, 0], sizes), sizes


def batches(texts: list[bytes], limit: int = 1 << 20):
    """Ranges of texts of about `limit` bytes together, at least one text each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if len(texts) > lo:
        yield lo, len(texts)
