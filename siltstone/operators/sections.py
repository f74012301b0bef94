"""Documents to sections: chapters, capital headers, packed paragraphs, or marked headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import series

# The patterns and sizes that decide where sections begin.
CHAPTER = re.compile(r"^[ \t]*chapter[ \t]+([IVXLC]+|[0-9]+)(?![a-zA-Z])\.?[ \t]*([^\r\n]*)", re.IGNORECASE | re.MULTILINE)
CAPITALS = re.compile(r"\r\n\r\n([A-Z][A-Z ,.'-]{2,40})\r\n\r\n")
HEADING = re.compile(r"^## (.+)$", re.MULTILINE)
PARAGRAPH = re.compile(r"(?:\r\n){2,}|\n{2,}")
LEAST_FRONT, LEAST_HEADERS, PART_CHARS, MOST_CHARS = 200, 5, 4000, 20_000

Section = tuple[str, str]


def pieces_by_words(text: str, size: int) -> Iterator[str]:
    """Runs of space-separated words, each closed once its words, with a space apiece, reach `size`."""
    words = text.split(" ")
    lo = total = 0
    for i, w in enumerate(words):
        total += len(w) + 1
        if total >= size:
            yield " ".join(words[lo : i + 1])
            lo, total = i + 1, 0
    if lo < len(words):
        yield " ".join(words[lo:])


def paragraphs(text: str) -> list[str]:
    return [s for p in PARAGRAPH.split(text) if (s := p.strip())]


def packed(text: str, size: int, before: bool, oversized: int) -> list[str]:
    """Paragraphs packed to about `size`, joined by blank lines; longer ones are cut by words and stand alone.

    `before` closes a pack before a paragraph that would overfill it; otherwise
    a pack is closed by the paragraph that fills it.
    """
    out: list[str] = []
    pack: list[str] = []

    def close() -> None:
        if pack:
            out.append("\n\n".join(pack))
            pack.clear()

    for p in paragraphs(text):
        if len(p) > oversized:
            close()
            out.extend(pieces_by_words(p, size))
            continue
        if before and sum(map(len, pack)) + len(p) > size:
            close()
        pack.append(p)
        if not before and sum(map(len, pack)) >= size:
            close()
    close()
    return out


def _between(text: str, starts: dict[str, int], titles: dict[str, str]) -> list[Section]:
    """Sections from each start to the next, in order of place, with long front matter ahead."""
    order = sorted(starts, key=lambda k: starts[k])
    edges = [starts[k] for k in order] + [len(text)]
    out = [("Front Matter", front)] if len(front := text[: edges[0]].strip()) >= LEAST_FRONT else []
    return out + [(titles[k], body) for k, lo, hi in zip(order, edges, edges[1:], strict=False) if (body := text[lo:hi].strip())]


def by_chapter(text: str) -> list[Section] | None:
    """A numeral's last place counts (its first is the contents list), and its first title that is not empty."""
    starts: dict[str, int] = {}
    names: dict[str, str] = {}
    for m in CHAPTER.finditer(text):
        key, name = m[1].upper(), m[2].strip(" .\r\t")
        starts[key] = m.start()
        names[key] = names.get(key) or name
    return _between(text, starts, {k: f"Chapter {k}: {n}" if n else f"Chapter {k}" for k, n in names.items()}) if starts else None


def by_capitals(text: str) -> list[Section] | None:
    found = list(CAPITALS.finditer(text))
    if len(found) < LEAST_HEADERS or found[-1].start() < len(text) / 2:
        return None
    starts = {m[1].strip(" ."): m.start() for m in found}
    return _between(text, starts, {k: k for k in starts})


def by_size(text: str) -> list[Section]:
    return [(f"Part {i}", body) for i, body in enumerate(packed(text, PART_CHARS, before=False, oversized=PART_CHARS), 1)]


def split_book(text: str | None) -> list[Section]:
    if not (text or "").strip():
        return []
    found = by_chapter(text)
    if found is None:
        found = by_capitals(text)
    if found is None:
        found = by_size(text)
    out: list[Section] = []
    for title, body in found:
        out += [(title, body)] if len(body) <= MOST_CHARS else [(f"{title} (part {i})", part) for i, (_, part) in enumerate(by_size(body), 1)]
    return out


def split_factsheet(text: str | None, title: str | None) -> list[Section]:
    """Bodies without their headings; what stands before the first is the introduction."""
    if not (text or "").strip():
        return []
    marks = list(HEADING.finditer(text))
    if not marks:
        return [(title, text.strip())]
    edges = [m.start() for m in marks[1:]] + [len(text)]
    parts = [("Introduction", text[: marks[0].start()])] + [(m[1].strip(), text[m.end() : hi]) for m, hi in zip(marks, edges, strict=True)]
    return [(t, s) for t, body in parts if (s := body.strip())]


@series("array<struct<title:string,body:string>>")
def _split(kinds: pd.Series, texts: pd.Series, titles: pd.Series) -> pd.Series:
    both = zip(kinds, texts, titles, strict=True)
    return pd.Series([[{"title": t, "body": b} for t, b in (split_book(x) if k == "book" else split_factsheet(x, name))] for k, x, name in both])


def sections(documents: DataFrame) -> DataFrame:
    """Section rows of `documents` (id, source_type, title, raw_text); documents without text give none."""
    some = documents.filter(F.col("raw_text").isNotNull() & (F.col("raw_text") != ""))
    each = some.select(F.col("id").alias("document_id"), F.posexplode(_split("source_type", "raw_text", "title")).alias("section_order", "s"))
    name = F.format_string("%s-s%03d", "document_id", "section_order")
    return each.select(name.alias("id"), "document_id", F.col("s.title").alias("section_title"), "section_order", F.col("s.body").alias("raw_text"))
