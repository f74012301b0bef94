"""Columns for cleaning text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker lines around a public-domain book's own text.
BOOK_START = r"(?i)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
BOOK_END = r"(?i)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim takes spaces alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def book_body(c: Column) -> Column:
    """Text between the first start marker and the first end marker; all of it when either is missing, none when they stand the other way."""
    start, end = F.regexp_instr(c, F.lit(BOOK_START)), F.regexp_instr(c, F.lit(BOOK_END))
    begin = start + F.length(F.regexp_substr(c, F.lit(BOOK_START)))
    between = F.when(end > begin, F.substring(c, begin, end - begin)).otherwise(F.lit(""))
    return strip(F.when((start > 0) & (end > 0), between).otherwise(c))


def lower(c: Column) -> Column:
    """Lower case letter by letter, as SQL engines have it: a sigma doesn't depend on what follows, a dotted I is one letter."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Tokens whose concatenation is the text: a run of non-space with the space after it.
TOKEN = r"[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*|[ \t\n\r\f\x0B]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
