"""Texts with named places, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that can't be compiled, with the place of what is wrong."""


def parts(template: str) -> Iterator[tuple[bool, str]]:
    """(is a name, text) of each part: `{name}` is a place, `{{` and `}}` are braces."""
    at, said = 0, []
    while at < len(template):
        c = template[at]
        if c not in "{}":
            nxt = min((k for k in (template.find("{", at), template.find("}", at)) if k >= 0), default=len(template))
            said.append(template[at:nxt])
            at = nxt
        elif template[at : at + 2] == c * 2:
            said.append(c)
            at += 2
        elif c == "}":
            raise TemplateError(f"single '}}' at {at}")
        else:
            end = template.find("}", at)
            name = template[at + 1 : end] if end >= 0 else ""
            if not name.isidentifier():
                raise TemplateError(f"expected '{{name}}' at {at}")
            if said:
                yield False, "".join(said)
                said = []
            yield True, name
            at = end + 1
    if said:
        yield False, "".join(said)


def names(template: str) -> list[str]:
    """Names of a template's places, each once, in order."""
    return list(dict.fromkeys(text for is_name, text in parts(template) if is_name))


def compiled(template: str, values: Mapping[str, Column | str]) -> Column:
    """The template with a column (or its name) in each place.

    Names that `values` lacks are an error when it is compiled, not when it is
    run, and so are values that no place asks for.  Null gives an empty text.
    """
    cut = list(parts(template))
    asked = {text for is_name, text in cut if is_name}
    if missing := sorted(asked - values.keys()):
        raise TemplateError(f"no value for {', '.join(missing)}")
    if unknown := sorted(values.keys() - asked):
        raise TemplateError(f"no place for {', '.join(unknown)}")
    column = lambda v: F.col(v) if isinstance(v, str) else v
    said = [F.coalesce(column(values[text]).cast("string"), F.lit("")) if is_name else F.lit(text) for is_name, text in cut]
    return F.concat(*said) if said else F.lit("")
