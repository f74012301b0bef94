"""SQL of the splitters: what sections, chunks and marked text must be, said a second time for DuckDB.

Each function gives an expression or the text of common table expressions.
Folds over a text's own pieces are list_reduce calls.  White space is ASCII, as
in the given tables, and no word of theirs is as long as a chunk.
"""

from __future__ import annotations

_TOKEN = r"'[^ \t\n\r\f\v]+[ \t\n\r\f\v]*|[ \t\n\r\f\v]+'"
_NONE = "CAST([] AS VARCHAR[])"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


def token_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {_TOKEN})) AS INTEGER)"


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '(?:\r\n){{2,}}|\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"


def by_words(p: str, size: int) -> str:
    """Runs of words, each closed by the word that fills it."""
    step = f"""CASE WHEN a.n + length(w) + 1 >= {size} THEN {{'o': list_append(a.o, concat_ws(' ', a.c, w)), 'c': CAST(NULL AS VARCHAR), 'n': 0}}
 ELSE {{'o': a.o, 'c': concat_ws(' ', a.c, w), 'n': CAST(a.n + length(w) + 1 AS INTEGER)}} END"""
    return f"list_transform([list_reduce(string_split({p}, ' '), lambda a, w: {step}, {{'o': {_NONE}, 'c': CAST(NULL AS VARCHAR), 'n': 0}})], lambda a: CASE WHEN a.c IS NULL THEN a.o ELSE list_append(a.o, a.c) END)[1]"


def packed(x: str, size: int, before: bool) -> str:
    """Paragraphs in packs; longer ones are cut by words and stand alone."""
    close = "CASE WHEN a.c IS NULL THEN a.o ELSE list_append(a.o, a.c) END"
    alone = f"{{'o': list_concat({close}, {by_words('p', size)}), 'c': CAST(NULL AS VARCHAR), 'n': 0}}"
    joined = "concat_ws(chr(10) || chr(10), a.c, p)"
    if before:
        add = f"""CASE WHEN a.n + length(p) > {size} THEN {{'o': {close}, 'c': p, 'n': CAST(length(p) AS INTEGER)}} ELSE {{'o': a.o, 'c': {joined}, 'n': CAST(a.n + length(p) AS INTEGER)}} END"""
    else:
        add = f"""CASE WHEN a.n + length(p) >= {size} THEN {{'o': list_append(a.o, {joined}), 'c': CAST(NULL AS VARCHAR), 'n': 0}} ELSE {{'o': a.o, 'c': {joined}, 'n': CAST(a.n + length(p) AS INTEGER)}} END"""
    fold = f"list_reduce({paragraphs(x)}, lambda a, p: CASE WHEN length(p) > {size} THEN {alone} ELSE {add} END, {{'o': {_NONE}, 'c': CAST(NULL AS VARCHAR), 'n': 0}})"
    return f"list_transform([{fold}], lambda a: {close})[1]"


def merge_tiny(c: str) -> str:
    return f"""list_reduce({c}, lambda o, x: CASE WHEN len(o) > 0 AND (length(x) < 50 OR len(o) = 1 AND length(o[1]) < 50)
 THEN list_append(o[1:len(o) - 1], o[len(o)] || chr(10) || chr(10) || x) ELSE list_append(o, x) END, {_NONE})"""


def structure(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN {_NONE} WHEN length({x}) <= 1200 THEN [{x}] ELSE {merge_tiny(packed(x, 1200, before=True))} END"


def _regroup(pieces: str, separator: str) -> str:
    """Runs of pieces, each of which begins with the separator (but for the first), up to 1000 characters and with up to 100 of the last."""
    most = "least(100, 1000 - length(p))"
    tail = f"right(a.c, {most})"
    kept = f"CASE WHEN length(a.c) <= {most} THEN a.c WHEN {most} > 0 AND instr({tail}, {separator}) > 0 THEN substr({tail}, instr({tail}, {separator})) ELSE '' END"
    step = f"CASE WHEN a.c <> '' AND length(a.c) + length(p) > 1000 THEN {{'o': list_append(a.o, a.c), 'c': ({kept}) || p}} ELSE {{'o': a.o, 'c': a.c || p}} END"
    fold = f"list_reduce({pieces}, lambda a, p: {step}, {{'o': {_NONE}, 'c': ''}})"
    return f"list_filter(list_transform(list_transform([{fold}], lambda a: list_append(a.o, a.c))[1], lambda c: {strip('c')}), lambda c: c <> '')"


def _cut(x: str, separator: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {separator}), lambda w, i: CASE WHEN i = 1 THEN w ELSE {separator} || w END), lambda w: w <> '')"


def recursive(source: str, out: str) -> str:
    """Tables up to `out` (id, chunks) from `source` (id, text), whose texts have no blank lines: lines first, words of long ones then."""
    return f"""{out}_l AS (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS p, alone FROM
 (SELECT id, {_cut('text', 'chr(10)')} AS p, instr(text, chr(10)) = 0 AS alone FROM {source} WHERE {strip('text')} <> '')),
{out}_g AS (SELECT id, i, p, alone OR length(p) >= 1000 AS long, count(*) FILTER (alone OR length(p) >= 1000) OVER (PARTITION BY id ORDER BY i) AS g FROM {out}_l),
{out}_c AS (SELECT id, i, {_regroup(_cut('p', "' '"), "' '")} AS c FROM {out}_g WHERE long
 UNION ALL SELECT id, min(i), {_regroup("list(p ORDER BY i)", 'chr(10)')} FROM {out}_g WHERE NOT long GROUP BY id, g),
{out} AS (SELECT id, {merge_tiny("flatten(list(c ORDER BY i))")} AS chunks FROM {out}_c GROUP BY id)"""


def sized(x: str) -> str:
    """Bodies of about 4000 characters."""
    return packed(x, 4000, before=False)


def _capped(source: str, out: str) -> str:
    """Sections of `out` from bodies (id, place, title, body), the longest cut again."""
    return f"""{out}_p AS (SELECT id, place, title, CASE WHEN length(body) <= 20000 THEN [body] ELSE {sized('body')} END AS parts, length(body) > 20000 AS cut FROM {source} WHERE body <> ''),
{out}_u AS (SELECT id, place, title, cut, generate_subscripts(parts, 1) AS part, unnest(parts) AS body FROM {out}_p),
{out} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place, part) - 1 AS INTEGER) AS n, CASE WHEN cut THEN title || ' (part ' || part || ')' ELSE title END AS title, body FROM {out}_u)"""


def sections_by_size(source: str, out: str) -> str:
    """Tables up to `out` (id, n, title, body) from `source` (id, text), books without chapters or headers."""
    return f"""{out}_b AS (SELECT id, generate_subscripts(b, 1) AS place, unnest(b) AS body FROM (SELECT id, {sized('text')} AS b FROM {source} WHERE {strip('text')} <> '')),
{out}_t AS (SELECT id, place, 'Part ' || place AS title, body FROM {out}_b),
{_capped(f'{out}_t', out)}"""


def _between(source: str, starts: str, out: str) -> str:
    """Sections of `out` from `starts` (id, start, title): bodies from each to the next, long front matter ahead."""
    return f"""{out}_e AS (SELECT k.id, start, title, {strip('substr(text, start, coalesce(lead(start) OVER (PARTITION BY k.id ORDER BY start), length(text) + 1) - start)')} AS body FROM {starts} k JOIN {source} s ON s.id = k.id),
{out}_f AS (SELECT s.id, {strip('substr(any_value(text), 1, min(start) - 1)')} AS body FROM {starts} k JOIN {source} s ON s.id = k.id GROUP BY s.id),
{out}_s AS (SELECT id, start AS place, title, body FROM {out}_e UNION ALL SELECT id, 0, 'Front Matter', body FROM {out}_f WHERE length(body) >= 200),
{_capped(f'{out}_s', out)}"""


def sections_by_chapter(source: str, out: str) -> str:
    """Tables up to `out` from `source` (id, text), all of whose books have a chapter line."""
    number = r"'(?i)^[ \t]*chapter[ \t]+([ivxlc]+|[0-9]+)(?:[^a-z]|$)', 1"
    return rf"""{out}_l AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM {source})),
{out}_o AS (SELECT id, line, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {out}_l),
{out}_m AS (SELECT id, start, upper(regexp_extract(line, {number})) AS key, regexp_replace(regexp_extract(line, '(?i)^[ \t]*chapter[ \t]+(?:[ivxlc]+|[0-9]+)\.?[ \t]*([^\r\n]*)', 1), '^[ .\r\t]+|[ .\r\t]+$', '', 'g') AS name
 FROM {out}_o WHERE regexp_extract(line, {number}) <> ''),
{out}_k AS (SELECT id, CAST(max(start) AS BIGINT) AS start, 'Chapter ' || key || coalesce(': ' || arg_min(name, start) FILTER (name <> ''), '') AS title FROM {out}_m GROUP BY id, key),
{_between(source, f'{out}_k', out)}"""


def sections_by_capitals(source: str, out: str) -> str:
    """Tables up to `out` from `source` (id, text): books with five headers or more, the last in their second half; other books give none.

    Headers stand in blocks of their own, none next to another.
    """
    return rf"""{out}_l AS (SELECT id, generate_subscripts(l, 1) AS i, len(l) AS n, unnest(l) AS block FROM (SELECT id, string_split(text, chr(13) || chr(10) || chr(13) || chr(10)) AS l FROM {source})),
{out}_o AS (SELECT id, i, n, block, 1 + coalesce(sum(length(block) + 4) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {out}_l),
{out}_m AS (SELECT id, start - 4 AS start, regexp_replace(block, '^[ .]+|[ .]+$', '', 'g') AS key FROM {out}_o WHERE i > 1 AND i < n AND regexp_full_match(block, '[A-Z][A-Z ,.''-]{{2,40}}')),
{out}_q AS (SELECT m.id FROM {out}_m m JOIN {source} s ON s.id = m.id GROUP BY m.id HAVING count(*) >= 5 AND max(start) - 1 >= any_value(length(text)) / 2),
{out}_k AS (SELECT id, CAST(max(start) AS BIGINT) AS start, key AS title FROM {out}_m WHERE id IN (SELECT id FROM {out}_q) GROUP BY id, key),
{_between(source, f'{out}_k', out)}"""


def marked_text(x: str) -> str:
    """Headings, paragraphs and items of pages as the given ones are: blocks end at the next block's tag, and four references occur, with or without their semicolon."""
    blocks = "p|li|ul|ol|nav|div|article|section|footer|header|aside|main|h1|h2|h3|h4|title|head|body|html"
    bare = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '<!--.*?-->', '', 'gs'), '<(?:script|style)\b.*?</(?:script|style)>', '', 'gis')"
    parts = rf"string_split(regexp_replace({bare}, '(?i)(</?(?:{blocks})(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1))"
    words = r"regexp_replace(b, '<[!/a-zA-Z][^>]*>', ' ', 'g')"
    for name, mark in (("quot", "chr(34)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "chr(38)")):
        words = f"regexp_replace({words}, '&{name};?', {mark}, 'g')"
    words = rf"trim(regexp_replace({words}, '[ \t\n\r\f\v]+', ' ', 'g'))"
    line = f"""CASE WHEN {words} = '' THEN '' WHEN regexp_matches(b, '^<p[ >]') THEN {words} WHEN regexp_matches(b, '^<li[ >]') THEN '- ' || {words}
 WHEN regexp_matches(b, '^<h2[ >]') THEN chr(10) || '## ' || {words} || chr(10) WHEN regexp_matches(b, '^<h[34][ >]') THEN chr(10) || '### ' || {words} || chr(10) ELSE '' END"""
    return strip(f"array_to_string(list_filter(list_transform({parts}, lambda b: {line}), lambda b: b <> ''), chr(10))")


def sections_by_heading(source: str, out: str) -> str:
    """Table `out` (id, n, title, body) from `source` (id, title, text): one section a heading, and what stands before the first."""
    return rf"""{out}_l AS (SELECT id, title, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT id, title, string_split(text, chr(10)) AS l FROM {source} WHERE {strip('text')} <> '')),
{out}_g AS (SELECT id, title, i, line, count(*) FILTER (regexp_matches(line, '^## .')) OVER (PARTITION BY id ORDER BY i) AS g FROM {out}_l),
{out}_b AS (SELECT id, g, any_value(title) AS page, max(g) OVER (PARTITION BY id) AS heads, {strip("regexp_replace(arg_min(line, i), '^## ', '')")} AS head,
 {strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g = 0 OR NOT regexp_matches(line, '^## .')), '')")} AS body FROM {out}_g GROUP BY id, g),
{out} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY g) - 1 AS INTEGER) AS n, CASE WHEN heads = 0 THEN page WHEN g = 0 THEN 'Introduction' ELSE head END AS title, body FROM {out}_b WHERE body <> '')"""


def fixed(x: str) -> str:
    """Windows of 250 tokens, each 200 on from the last; tiny ones join."""
    t = f"regexp_extract_all({x}, {_TOKEN})"
    wins = f"list_transform([{t}], lambda t: list_transform(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 250 THEN 1 ELSE CAST(ceil((len(t) - 250) / 200.0) AS BIGINT) + 1 END), lambda i: array_to_string(t[200 * i + 1:200 * i + 250], '')))[1]"
    return merge_tiny(wins)
