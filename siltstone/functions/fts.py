"""Web-style queries as boolean trees over lexemes, and cover-density rank."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column

from siltstone.functions.arrow import series
from siltstone.functions.lexer import ENGLISH, lexemes, placed

_QUERY = re.compile(r'(-*)(?:"([^"]*)"?|([^\s"]+))')
WEIGHT = 0.1

Positions = dict[str, list[int]]


@dataclass(frozen=True)
class Phrase:
    """Lexemes at fixed offsets from the first, of which a text must hold the sequence, or, negated, must not."""

    lexemes: tuple[str, ...]
    offsets: tuple[int, ...]
    negated: bool = False

    def starts(self, found: Positions) -> list[int]:
        at = set(found.get(self.lexemes[0], ()))
        for lexeme, k in zip(self.lexemes[1:], self.offsets[1:], strict=True):
            at &= {p - k for p in found.get(lexeme, ())}
        return sorted(at)


#: Alternatives, each a list of phrases that must all hold.
Query = tuple[tuple[Phrase, ...], ...]


@lru_cache(maxsize=10_000)
def parse_query(text: str | None, analyser: str = ENGLISH) -> Query:
    """Alternatives of a web-style query.

    Words side by side must all be there, quoted ones in sequence, `or` parts
    alternatives and binds less than that, leading minuses negate.  A word of
    several tokens (a compound, an address, `pg_class`) is a phrase of them, and
    stop words within a phrase keep their place.  Nothing is an error: an `or`
    without a neighbour is passed over, stop words drop out, and a query that
    has nothing else has no alternative and matches nothing.
    """
    clauses: list[list[Phrase]] = [[]]
    for minus, quoted, bare in _QUERY.findall(text or ""):
        if bare.lower() == "or" and not minus:
            clauses.append([])
            continue
        at = [(k, x) for k, x in enumerate(placed(quoted or bare, analyser)) if x is not None]
        if at:
            clauses[-1].append(Phrase(tuple(x for _, x in at), tuple(k - at[0][0] for k, _ in at), len(minus) % 2 == 1))
    return tuple(tuple(c) for c in clauses if c)


def possible(have: Collection[str], query: Query) -> bool:
    """Whether a text with these lexemes can match: one alternative's all must be there, but for negated ones."""
    return any(all(p.negated or all(x in have for x in p.lexemes) for p in clause) for clause in query)


def matches(found: Positions, query: Query) -> bool:
    """Whether all phrases of an alternative hold; one of negations alone holds where they are absent."""
    return any(all(bool(p.starts(found)) != p.negated for p in clause) for clause in query)


def cover_density(found: Positions, query: Query, weight: float = WEIGHT) -> float:
    """Sum over minimal covers of weight / (1 + positions of the cover that hold no lexeme of the query).

    A cover is a stretch of positions in which the query holds and no shorter
    one within it does; the search for the next begins after its first lexeme.
    Negated phrases count by stretch as well.
    """
    every = sorted({p for clause in query for phrase in clause for x in phrase.lexemes for p in found.get(x, ())})
    known = {phrase: phrase.starts(found) for clause in query for phrase in clause}
    clauses = []
    for clause in query:
        need = [(known[p], p.offsets[-1]) for p in clause if not p.negated]
        if all(own for own, _ in need):
            clauses.append((need, [(known[p], p.offsets[-1]) for p in clause if p.negated and known[p]]))

    def clear(avoid: list[tuple[list[int], int]], low: int, high: int) -> bool:
        return all(k == len(own) or own[k] + length > high for own, length in avoid for k in [bisect_left(own, low)])

    total, i = 0.0, 0
    while i < len(every):
        at, end = every[i], None
        for need, avoid in clauses:
            firsts = [(bisect_left(own, at), own, length) for own, length in need]
            if all(k < len(own) for k, own, _ in firsts):
                e = max((own[k] + length for k, own, length in firsts), default=at)
                if (end is None or e < end) and clear(avoid, at, e):
                    end = e
        if end is None:
            return total
        start = at
        for need, avoid in clauses:
            lasts = [(bisect_right(own, end - length) - 1, own) for own, length in need]
            if all(k >= 0 for k, _ in lasts):
                s = min((own[k] for k, own in lasts), default=end)
                if s > start and clear(avoid, s, end):
                    start = s
        inside = bisect_right(every, end) - bisect_left(every, start)
        total += weight / (1 + (end - start + 1 - inside))
        i = bisect_right(every, start)
    return total


def to_lexemes(texts: Column | str, analyser: str = ENGLISH) -> Column:
    """Lexemes and positions of each text, as a column."""

    def run(given: pd.Series) -> pd.Series:
        return given.map(lambda t: [{"lexeme": k, "positions": v} for k, v in sorted(lexemes(t, analyser).items())])

    return series("array<struct<lexeme:string,positions:array<int>>>")(run)(texts)


def terms(queries: Column | str, analyser: str = ENGLISH) -> Column:
    """Each lexeme of each alternative of a query: the alternative's number, whether its phrase is negated, and the lexeme."""

    def run(given: pd.Series) -> pd.Series:
        return given.map(lambda q: [{"clause": c, "negated": n, "lexeme": x} for c, clause in enumerate(parse_query(q, analyser)) for n, x in sorted({(p.negated, x) for p in clause for x in p.lexemes})])

    return series("array<struct<clause:int,negated:boolean,lexeme:string>>")(run)(queries)


def ranks_of(found: Column | str, positions: Column | str, queries: Column | str, analyser: str = ENGLISH) -> Column:
    """Places, from 0, of the queries among each text's own that it matches, and its cover-density rank for each, from the positions of their lexemes in it."""

    def run(stems: pd.Series, places: pd.Series, asked: pd.Series) -> pd.Series:
        def one(a: Sequence[str], b: Sequence[np.ndarray], own: Sequence[str]) -> list[dict]:
            have, trees = set(a), [parse_query(q, analyser) for q in own]
            likely = [(k, q) for k, q in enumerate(trees) if possible(have, q)]
            x = {s: p.tolist() for s, p in zip(a, b, strict=True)} if likely else {}
            return [{"place": k, "score": cover_density(x, q)} for k, q in likely if matches(x, q)]

        return pd.Series([one(*x) for x in zip(stems, places, asked, strict=True)], dtype=object)

    return series("array<struct<place:int,score:double>>")(run)(found, positions, queries)


def which_hold(found: Column | str, positions: Column | str, queries: Column | str, analyser: str = ENGLISH) -> Column:
    """Places, from 0, of the queries among each text's own that it matches, from the positions of their lexemes in it."""

    def run(stems: pd.Series, places: pd.Series, asked: pd.Series) -> pd.Series:
        def one(a: Sequence[str], b: Sequence[np.ndarray], own: Sequence[str]) -> list[int]:
            x = {s: p.tolist() for s, p in zip(a, b, strict=True)}
            trees = [parse_query(q, analyser) for q in own]
            return [k for k, q in enumerate(trees) if possible(x, q) and matches(x, q)]

        return pd.Series([one(*x) for x in zip(stems, places, asked, strict=True)], dtype=object)

    return series("array<int>")(run)(found, positions, queries)
