"""Tokens of a text by class: a finite-state lexer for full text.

The classes and what is indexed of each follow the public description of the
parser that the original's database comes with:

    word        letters alone                          one position, stemmed
    numword     letters and digits                     one, as it is
    compound    words joined by hyphens                the whole, then its parts
    int, float  digits, with sign and decimals         one, with the sign
    sfloat      a float with an exponent               one
    version     digits with two dots or more           one
    email       local part, @, host                    one
    host        labels with dots, a port               one
    url         host and path                          the whole, the host, the path
    file        names with slashes                     one
    tag, entity, protocol                              nothing, no position

Anything else separates.  A stop word has no lexeme but takes its position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from siltstone.functions.stemming import STOP_WORDS, stem

ENGLISH, SIMPLE, WORDS = "english", "simple", "words"
MOST_POSITION = 16383

_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_HOST = rf"(?:{_LABEL}\.){{1,20}}[^\W\d_]{{2,24}}(?![\w-])(?::\d{{1,5}}(?!\w))?"
_PART = r"(?=\d*[^\W\d_])[^\W_]+"
_NAME = r"[\w.+-]*\w"
#: Alternatives in order of preference; each is bounded or deterministic, so that a text is read in linear time.
_TOKEN = re.compile(
    rf"""
    (?P<plain>[^\W\d_]+)(?=[\s,;:!?)"]|\.(?:\s|\Z)|\Z)(?!://)
  | (?P<tag><(?:!--.{{0,4000}}?--|[/!?]?[A-Za-z][^<>]{{0,4000}})>)
  | (?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)
  | (?P<protocol>[A-Za-z][A-Za-z0-9+.-]{{1,20}}://)
  | (?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,63}}[A-Za-z0-9_%+-])?@{_HOST})
  | (?P<url>(?P<host>{_HOST})(?P<path>[/?][^\s<>"']*[^\s<>"'.,;:!?)\]])?)
  | (?P<sfloat>[-+]?\d+(?:\.\d+)?[eE][-+]?\d+(?!\w))
  | (?P<version>\d+(?:\.\d+){{2,}}(?!\w))
  | (?P<float>[-+]?\d+\.\d+(?!\w))
  | (?P<compound>{_PART}(?:-{_PART})+)
  | (?P<file>~?/{_NAME}(?:/{_NAME})*|[^\W_][\w.+-]{{0,254}}/{_NAME}(?:/{_NAME})*)
  | (?P<int>[-+]?\d+(?!\w))
  | (?P<numword>[^\W_]+)
    """,
    re.X | re.S,
)
_RUN = re.compile(r"[^\W_]+")
_CLOSING = ".,;:!?)\""
#: Lexemes of stretches without white space seen before, by analyser.
_KNOWN: dict[str, dict[str, list[str | None]]] = {ENGLISH: {}, SIMPLE: {}}


def _english(word: str) -> str | None:
    return None if word in STOP_WORDS else stem(word)


def tokens(text: str | None) -> Iterator[tuple[str, str]]:
    """Class and text of each token, in lower case."""
    for m in _TOKEN.finditer((text or "").lower()):
        kind = m.lastgroup
        if kind == "plain":
            yield "word", m[0]
        elif kind in ("host", "path", "url"):
            yield ("url" if m["path"] else "host"), m[0]
        elif kind == "numword":
            yield ("word" if m[0].isalpha() else "numword"), m[0]
        else:
            yield kind, m[0]


def _expanded(kind: str, token: str, english: bool) -> list[str | None]:
    """Lexemes of the positions that a token takes; None for a stop word's."""
    word = _english if english else str
    if kind == "word":
        return [word(token)]
    if kind == "compound":
        parts = token.split("-")
        return [word(token) if token.replace("-", "").isalpha() else token, *(word(p) if p.isalpha() else p for p in parts)]
    if kind == "url":
        cut = min(k for k in (token.find("/"), token.find("?")) if k >= 0)
        return [token, token[:cut], token[cut:]]
    return [] if kind in ("tag", "entity", "protocol") else [token]


def stretch(chunk: str, analyser: str = ENGLISH) -> list[str | None]:
    """The lexeme of each position of a stretch without white space, in lower case; `english` or `simple`."""
    english, word = analyser == ENGLISH, chunk.rstrip(_CLOSING)
    if word.isalpha():  # most of them, and the lexer would say the same
        return [_english(word) if english else word]
    return [x for kind, token in tokens(chunk) for x in _expanded(kind, token, english)]


def placed(text: str | None, analyser: str = ENGLISH) -> list[str | None]:
    """The lexeme of each position of a text, from the first; None where a stop word stands.

    `english` stems words and leaves out stop words, `simple` does neither, and
    `words` knows no class but takes runs of letters and digits as they are, in
    lower case letter by letter (see `functions.text.lower`).
    """
    if analyser == WORDS:
        return _RUN.findall((text or "").replace("İ", "i").replace("Σ", "σ").lower())
    low = (text or "").lower()
    out: list[str | None] = []
    english = analyser == ENGLISH
    if "<" in low:  # only tags can hold white space
        for kind, token in tokens(low):
            out += _expanded(kind, token, english)
        return out
    known = _KNOWN[analyser]
    for chunk in low.split():
        own = known.get(chunk)
        if own is None:
            own = stretch(chunk, analyser)
            if len(chunk) <= 64:
                if len(known) >= 200_000:
                    known.clear()
                known[chunk] = own
        out += own
    return out


def most_position(analyser: str) -> int | None:
    """The position that stands for all later ones too; `words` counts on, so that phrases hold anywhere."""
    return MOST_POSITION if analyser != WORDS else None


def lexemes(text: str | None, analyser: str = ENGLISH) -> dict[str, list[int]]:
    """Lexemes and their positions, from 1 to the last that is counted."""
    out: dict[str, list[int]] = {}
    most = most_position(analyser)
    for at, lexeme in enumerate(placed(text, analyser), 1):
        if lexeme is not None:
            own = out.setdefault(lexeme, [])
            if most is None or at <= most:
                own.append(at)
            elif not own or own[-1] != most:
                own.append(most)
    return out
