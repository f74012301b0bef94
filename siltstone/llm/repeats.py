"""Removal of passages that an earlier document has already.

A passage is a window of so many consecutive words.  Every window has one
phrase that stands for it: the one of smallest hash among the window's phrases,
so equal windows in different documents have equal phrases.  Phrases that more
than one document has are confirmed over the whole corpus, dealt into shards
beside the documents that hold them, and compiled there into Aho-Corasick
automata, which the documents' recurring parts are streamed through.  Around
each occurrence the stretch of windows it stands for is hashed whole; only
stretches that differ between documents are looked at window by window.

Documents of one word sequence are one class: all but the smallest lose
everything that a window can cover.

A row is known by its doc_id and a hash of its text throughout, as rows may
repeat a doc_id; only the ids say which document is earlier.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import in_arrow, join_anew, settle
from siltstone.llm.words import batches, hash_words, mix, power_at, powers


@dataclass(frozen=True)
class RepeatParams:
    window: int = 50
    #: Words of a phrase; a window holds window - phrase + 1 of them.
    phrase: int = 8
    #: Phrases of an automaton, and words streamed through one copy of it.
    shard_phrases: int = 20_000
    shard_words: int = 1_000_000


_RNG = np.random.default_rng(424242)
_B1, _B2, _B3 = (int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 3))


def _span_hash(words: np.ndarray, base: int):
    """Hash of words[s:e] for arrays s, e."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)))))
    back = pow(base, -1, 1 << 64)
    return lambda s, e: mix((total[e] - total[s]) * power_at(back, s) + (e - s).astype(np.uint64))


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def runs(words: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes of a text, and its runs of windows that one phrase stands for: phrase, first window, last window."""
    at = np.arange(len(words) - p.phrase + 1)
    phrases = _span_hash(words, _B3)(at, at + p.phrase)
    low = _slide_min(phrases, p.window - p.phrase + 1)
    edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return phrases, low[edge], edge, np.append(edge[1:], len(low)) - 1


def _scan(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """doc_id, text_key, n_words, sequence (key of all words) and phrases for every row."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                raw = [(t or "").encode("utf-8", "replace") for t in part.column(2).to_pylist()]
                n, key, stand = [], [], []
                for lo, hi in batches(raw):
                    hashes, _, cut, _ = hash_words(raw[lo:hi])
                    for a, e in zip(cut[:-1], cut[1:], strict=True):
                        words = hashes[a:e]
                        n.append(len(words))
                        key.append(xxhash.xxh3_128_digest(words.tobytes()))
                        stand.append(np.unique(runs(words, p)[1]).view(np.int64) if len(words) >= p.window else [])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(stand, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_words", "sequence", "phrases"])

    return in_arrow(docs.select("doc_id", "text_key", "text"), run, "doc_id long, text_key long, n_words long, sequence binary, phrases array<long>")


_PIECES = "shard int, kind int, doc_id long, text_key long, at int, phrase long, body string, words int"


def _pieces(docs: DataFrame, routes: DataFrame, shards: int, p: RepeatParams) -> DataFrame:
    """For each row with recurring phrases: the phrases its document is the first to have (kind 0), and the parts to stream (kind 1), by shard."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out: list[tuple] = []
            for i in range(b.num_rows):
                doc, key, text = (b.column(c)[i].as_py() for c in range(3))
                found, firsts = (b.column(c)[i].values.to_numpy() for c in (3, 4))
                raw = text.encode("utf-8", "replace")
                split, words = raw.split(), hash_words([raw])[0]
                phrases, stand, lo, hi = runs(words, p)
                order = np.argsort(found)
                found, firsts = found[order], firsts[order]
                place = np.minimum(np.searchsorted(found, stand.view(np.int64)), len(found) - 1)
                own = np.flatnonzero(found[place] == stand.view(np.int64))
                parts: dict[int, list[list[int]]] = {}
                for first, s, e in zip(firsts[place[own]].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True):
                    spans = parts.setdefault(shard_of(first, shards), [])
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e + p.window)
                    else:
                        spans.append([s, e + p.window])
                mine = found[firsts == doc]
                if len(mine):  # the first place of each
                    order = np.argsort(phrases.view(np.int64), kind="stable")
                    at = order[np.searchsorted(phrases.view(np.int64)[order], mine)]
                    out += [(shard_of(doc, shards), 0, doc, key, i, v, " ".join(w.decode() for w in split[i : i + p.phrase]), p.phrase) for v, i in zip(mine.tolist(), at.tolist(), strict=True)]
                for shard, spans in parts.items():
                    out += [(shard, 1, doc, key, s, 0, b" ".join(split[s:e]).decode(), e - s) for s, e in spans]
                if len(out) > 2000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    joined = docs.join(routes, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "phrases", "firsts")
    return in_arrow(joined, run, _PIECES)


_KINDS = (("shard", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("phrase", pa.int64()), ("body", pa.string()), ("words", pa.int32()))


def _rows(out: list[tuple], kinds=_KINDS) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def shard_of(doc: int, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True)) % shards


_RUNS = "doc_id long, text_key long, first_window int, last_window int, phrase long, key1 long, key2 long, w1 array<long>, w2 array<long>"
_RUN_KINDS = (("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_window", pa.int32()), ("last_window", pa.int32()), ("phrase", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())))


def _locate(pieces: DataFrame, p: RepeatParams) -> DataFrame:
    """Stream the parts through their shard's automaton; a row for each run of windows around an occurrence.

    Rows of a shard come phrases first, then parts by ascending doc_id.  A run
    unlike an earlier one of the same phrase also brings its windows (two hashes
    each, in order), and so does that earlier one.  An equal run needs none in a
    later document, which loses it whole; in the document that brought the
    windows it brings its own.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, salted, automaton, ready = None, False, None, False
        seen: dict[int, dict[tuple[int, int], tuple[int, tuple | None]]] = {}
        for b in source:
            out: list[tuple] = []
            for shard, salt, salts, kind, doc, text_key, at, phrase, body in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (shard, salt) != unit:
                    unit, salted, automaton, ready, seen = (shard, salt), salts > 1, ahocorasick.Automaton(), False, {}
                if kind == 0:
                    automaton.add_word(f" {body} ", phrase)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                stream = f" {body} "
                ends = list(automaton.iter(stream))
                if not ends:
                    continue
                found: dict[int, list[int]] = {}
                gaps = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), "<u4") == 32)
                for i, (_, v) in zip((np.searchsorted(gaps, [e for e, _ in ends]) - p.phrase).tolist(), ends, strict=True):
                    found.setdefault(v, []).append(i)
                words = hash_words([body.encode()])[0]
                _, stand, lo, hi = runs(words, p)
                h1, h2 = _span_hash(words, _B1), _span_hash(words, _B2)
                k1, k2 = (h(lo, hi + p.window).view(np.int64).tolist() for h in (h1, h2))
                for v, s, e, a, c in zip(stand.view(np.int64).tolist(), lo.tolist(), hi.tolist(), k1, k2, strict=True):
                    places = found.get(v, ())
                    near = bisect_left(places, s)
                    if near == len(places) or places[near] > e + p.window - p.phrase:
                        continue
                    row = (doc, text_key, at + s, at + e, v, a, c)
                    known = seen.setdefault(v, {})
                    if (a, c) in known and (known[a, c][0] != doc or known[a, c][1]):  # the smallest document of a phrase loses none of it
                        out.append((*row, None, None))
                        continue
                    w = np.arange(s, e + 1)
                    own = tuple(h(w, w + p.window).view(np.int64) for h in (h1, h2))
                    if not salted and not known:
                        known[a, c] = (doc, (*row, *own))
                        out.append((*row, None, None))
                        continue
                    for other, (holder, held) in known.items():
                        if held:
                            out.append(held)
                            known[other] = (holder, None)
                    known[a, c] = (doc, None)
                    out.append((*row, *own))
                if len(out) > 2000:
                    yield _rows(out, _RUN_KINDS)
                    out = []
            yield _rows(out, _RUN_KINDS)

    load = pieces.filter("kind = 1").groupBy("shard").agg(F.sum("words").alias("load"))
    salts = load.select("shard", F.ceil(F.col("load") / p.shard_words).cast("int").alias("salts"))
    parts = pieces.filter("kind = 1").join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("salts")).cast("int"))
    keys = pieces.filter("kind = 0").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = ("shard", "salt", "salts", "kind", "doc_id", "text_key", "at", "phrase", "body")
    dealt = parts.select(*columns).union(keys.select(*columns))
    return in_arrow(dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id", "text_key", "at"), run, _RUNS)


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """The smallest doc_id (`first`) of each key that several documents have."""
    both = rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return both.filter("first < last").select(*key, "first")


def repeated_ranges(docs: DataFrame, scanned: DataFrame, p: RepeatParams) -> DataFrame:
    """doc_id, text_key and ranges (start, end: words) that windows of earlier documents cover, for the smallest row of each class."""
    least = F.min(F.struct("doc_id", "text_key"))
    classes = scanned.filter(F.col("n_words") >= p.window).groupBy("sequence").agg(least.alias("row"), F.first("phrases").alias("phrases"))
    phrases = settle(classes.select("row.doc_id", "row.text_key", F.explode("phrases").alias("phrase")))
    recurring = settle(_shared(phrases, "phrase"))
    shards = max(1, -(-recurring.count() // p.shard_phrases))
    routes = phrases.join(recurring, "phrase").groupBy("doc_id", "text_key").agg(F.collect_list("phrase").alias("phrases"), F.collect_list("first").alias("firsts"))
    found = settle(_locate(settle(_pieces(docs, routes, shards, p)), p))

    key = ["phrase", "key1", "key2"]
    spans = found.select("doc_id", "text_key", "first_window", "last_window", *key)
    spans = join_anew(spans, _shared(found, *key), *key).filter("doc_id > first")
    whole = spans.select("doc_id", "text_key", F.col("first_window").alias("start"), (F.col("last_window") + p.window).alias("end"))
    each = found.filter("w1 IS NOT NULL").select("doc_id", "text_key", "first_window", F.posexplode(F.arrays_zip("w1", "w2")).alias("k", "w"))
    each = each.select("doc_id", "text_key", (F.col("first_window") + F.col("k")).alias("start"), "w.w1", "w.w2")
    lost = join_anew(each, _shared(each, "w1", "w2"), "w1", "w2").filter("doc_id > first").select("doc_id", "text_key", "start", (F.col("start") + p.window).alias("end"))
    return whole.union(lost).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) for every row of `docs` (doc_id, text).

    A word goes if a window that covers it also starts in a document of smaller
    doc_id; windows are judged on the input.  Null, empty and short texts keep
    all they have.  Rows that repeat a doc_id are not earlier than one another
    and may have different texts; each is judged for itself, and there are as
    many rows as before.  A row with a null doc_id takes no part: it keeps its
    words and takes none from others.  Texts of any length are read whole, and
    an empty table gives an empty result.  Other columns are ignored, or, with
    `carry`, returned with the rest of the row as the struct `row`.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[whole] * carry).withColumn("text_key", F.xxhash64("text"))
    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    scanned = settle(_scan(usable, p))
    ranges = settle(repeated_ranges(usable, scanned, p))
    long = scanned.filter(F.col("n_words") >= p.window).select("doc_id", "text_key", "sequence")
    copies = join_anew(long, _shared(long, "sequence"), "sequence").filter("doc_id > first").select("doc_id", "text_key").distinct()
    # rows of one id whose texts differ in white space alone share what the smallest of them loses
    alike = long.groupBy("doc_id", "sequence").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).filter("least < most")
    twins = join_anew(long, alike, "doc_id", "sequence").filter("text_key > least").select("doc_id", "text_key", "least").distinct()
    twins = twins.join(ranges.withColumnRenamed("text_key", "least"), ["doc_id", "least"]).select("doc_id", "text_key", "ranges")
    fate = ranges.union(twins).union(copies.withColumn("ranges", F.expr("array(struct(0 AS start, 2147483647 AS end))")))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, gone, kept = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    words = (text or "").encode("utf-8", "replace").split()
                    n.append(len(words))
                    if ranges.is_valid:
                        drop, spans = np.zeros(len(words) + 1, np.int64), ranges.values
                        np.add.at(drop, spans.field("start").to_numpy(), 1)
                        np.add.at(drop, np.minimum(spans.field("end").to_numpy(), len(words)), -1)
                        words = [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                made = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "n_removed", "kept", *["row"] * carry])

    joined = docs.join(fate, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges", *["row"] * carry)
    schema = T.StructType().add("doc_id", T.LongType()).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType())
    return in_arrow(joined, cut, schema.add(joined.schema["row"]) if carry else schema)
