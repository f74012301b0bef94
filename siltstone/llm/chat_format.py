r"""Chat texts that a grammar reads back, in DataFrame functions alone.

A conversation is rendered turn by turn as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

and the parser takes such a text apart at its control strings, `<|word|>`.  It
allows none of them within a turn and undoes the escape there: one backslash is
taken out of every `<\...\|`.  A turn is first written as it is and parsed; only
where the turn that comes back is not the one written, its text is escaped, one
backslash into every `<\...|`.  Escaping is undone exactly whatever the text
holds, and an escaped text has no control string, so that the second writing is
always identical; the whole conversation is parsed once more to say so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_END, _CONTROL = r"<\|im_end\|>", r"<\|[A-Za-z0-9_]+\|>"
_HEAD = "\n" + START


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*\|)", "<$1")


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_role(c: Column) -> Column:
    """A role is one line without a control string: backslashes doubled, newlines and `<|` spelt with one."""
    return _swap(c, ("\\", "\\\\"), ("\n", "\\n"), ("<|", "<\\|"))


def unescape_role(c: Column) -> Column:
    between = F.transform(F.split(c, r"\\\\", -1), lambda part: _swap(part, ("\\n", "\n"), ("\\|", "|")))
    return F.array_join(between, "\\")


def render(role: Column, written: Column) -> Column:
    """One turn; `written` is its text, escaped where that is needed."""
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), written, F.lit(END + "\n"))


def _pieces(c: Column) -> Column:
    """What stands before each end mark, from the newline of the turn before on; the last is what is left."""
    return F.split(F.concat(F.lit("\n"), c), _END, -1)


def parse(c: Column) -> Column:
    """Turns (role, text) of a rendered conversation; null where it isn't one."""
    pieces = _pieces(c)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rest = lambda p: F.substr(p, F.lit(len(_HEAD) + 1))
    good = F.forall(turns, lambda p: F.startswith(p, F.lit(_HEAD)) & F.contains(rest(p), F.lit("\n")) & ~rest(p).rlike(_CONTROL))
    role = lambda p: F.substring_index(rest(p), "\n", 1)
    read = F.transform(turns, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substr(rest(p), F.length(role(p)) + 2)).alias("text")))
    return F.when(good & (F.element_at(pieces, -1) == "\n"), read)


def written(role: Column, text: Column) -> Column:
    """The text as it stands in the output: itself if the turn then comes back identical, else escaped."""
    back = parse(render(role, text))
    same = (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text)
    return F.when(F.coalesce(same, F.lit(False)), text).otherwise(escape(text))


def format_chats(rows: DataFrame, learnt: Sequence[str] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans and identical for every conversation of `rows` (conv_id, turn, role, text).

    `loss_spans` is the loss mask: the code points [start, end) of the texts of
    `learnt` roles in `formatted`, with the turn that each is in and its offset
    in that turn.  `identical` says that parsing `formatted` gave the source.

    Null roles and texts are empty; turns without a number come first; turns of
    equal number go by their rendering, and repeated rows are repeated turns.
    Each row without a conv_id is a conversation by itself.  A conversation is
    one row of the result, so its turns meet in one task; there is one shuffle.
    Other columns are ignored, and an empty table gives an empty result.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), lone.alias("lone"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = said.withColumn("as", written(F.col("role"), F.col("text")))
    head = F.lit(len(START) + 1) + F.length(escape_role(F.col("role")))
    loss = F.when(F.col("role").isin(*learnt), F.struct(head.alias("offset"), F.length("as").alias("size")))
    turns = own.select("conv_id", "lone", "turn", render(F.col("role"), F.col("as")).alias("shown"), loss.alias("loss"), F.xxhash64("role", "text").alias("source"))
    w = Window.partitionBy("conv_id", "lone").orderBy("turn", "shown")
    before = F.sum(F.length("shown").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = turns.withColumns({"place": F.row_number().over(w) - 1, "start": F.coalesce(before, F.lit(0))})
    whole = placed.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(F.struct("place", "start", "shown", "loss", "source"))).alias("t"))
    spans = F.transform(
        F.filter("t", lambda x: x["loss"].isNotNull()),
        lambda x: F.struct(x["place"].alias("turn"), (x["start"] + x["loss"]["offset"]).alias("start"), (x["start"] + x["loss"]["offset"] + x["loss"]["size"]).alias("end"), x["loss"]["offset"].alias("offset")),
    )
    out = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"), spans.alias("loss_spans"), F.transform("t", lambda x: x["source"]).alias("source"))
    back = F.transform(parse(F.col("formatted")), lambda x: F.xxhash64(x["role"], x["text"]))
    return out.select("conv_id", "formatted", "loss_spans", F.coalesce(back == F.col("source"), F.lit(False)).alias("identical"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns and loss_texts of formatted conversations: what the grammar reads, and the unescaped text of each span of the mask."""
    pieces = _pieces(F.col("formatted"))  # each begins with a newline, so offsets are one more
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.get("p", s["turn"]), s["offset"] + 2, (s["end"] - s["start"]).cast("int"))))
    read = chats.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"), pieces.alias("p"))
    return read.select("conv_id", "turns", under.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
