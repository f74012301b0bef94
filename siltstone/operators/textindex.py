"""The inverted index: built from texts for one search, or stored in segments and kept current.

A stored index is a snapshot table of segments.  An upsert writes one segment,
with its postings in folders by hash of the lexeme, its lexemes' counts and its
ids, and marks the ids it replaces dead in all earlier segments.  Segments of
like size are merged once there are several, so that an index of n texts after
any number of upserts has in the order of log n of them, and each posting is
written that often.  A search reads the folders of its own lexemes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import lexer
from siltstone.functions.arrow import small_batches
from siltstone.sources.io import settle
from siltstone.sources.snapshots import Snapshot, SnapshotTable

#: Lexemes up to this many are looked for in the tasks that read texts; more of them are joined.
FEW = 200_000
_TOKENS = 500_000
#: Stretches of text whose lexemes a task remembers.
_KEPT = 200_000
_PACKED = {"compression": "zstd"}


@dataclass(frozen=True)
class Index:
    """postings (lexeme, id, positions), terms (lexeme, n: texts or more that hold it) and ids (id) of all texts, and how they were analysed."""

    postings: DataFrame
    terms: DataFrame
    ids: DataFrame
    analyser: str = lexer.ENGLISH
    #: id and x (lexeme, positions) of each text, where they are at hand.
    texts: DataFrame | None = None


class _Lexemes(dict):
    """Numbers of stretches of text, given as they come, and what lexemes each stands for.

    A stretch is one without white space, or (as a tuple) a lexeme itself.
    Lexemes have numbers too, in the order of `names`; with `wanted` the others
    have -1, as have stop words.
    """

    def __init__(self, analyser: str, wanted: frozenset[str] | None):
        super().__init__()
        self.analyser, self.all = analyser, wanted is None
        self.names = sorted(wanted or ())
        self.known: dict[str | None, int] = {None: -1, **{x: k for k, x in enumerate(self.names)}}
        self.flat: list[int] = []
        self.starts: list[int] = []

    def __missing__(self, key: str | tuple[str | None]) -> int:
        own = key if isinstance(key, tuple) else lexer.stretch(key, self.analyser)
        self.starts.append(len(self.flat))
        for lexeme in own:
            if self.all and lexeme not in self.known:
                self.known[lexeme] = len(self.names)
                self.names.append(lexeme)
            self.flat.append(self.known.get(lexeme, -1))
        self[key] = n = len(self)
        return n

    def numbers(self, text: str | None) -> list[int]:
        low = (text or "").lower()
        if self.analyser == lexer.WORDS or "<" in low:  # only tags can hold white space
            return [self[x,] for x in lexer.placed(text, self.analyser)]
        return list(map(self.__getitem__, low.split()))

    def grouped(self, texts: list[list[int]], by_text: bool) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Of each lexeme of each text its number, the text's place and the positions, in the order of texts or of lexemes."""
        counts = [len(t) for t in texts]
        keys = np.fromiter(chain.from_iterable(texts), np.int64, sum(counts))
        starts = np.array(self.starts, np.int64)
        sizes = np.diff(starts, append=len(self.flat))[keys]
        ends = np.cumsum(sizes)
        codes = np.array(self.flat, np.int64)[np.arange(sizes.sum()) + np.repeat(starts[keys] - (ends - sizes), sizes)]
        rows = np.repeat(np.repeat(np.arange(len(texts)), counts), sizes)
        lengths = np.bincount(rows, minlength=len(texts))
        places = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        held = codes >= 0
        codes, rows, places = codes[held], rows[held], places[held]
        order = np.argsort(rows * len(self.names) + codes if by_text else codes, kind="stable")
        codes, rows, places = codes[order], rows[order], places[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        most = lexer.most_position(self.analyser)
        if most is not None and len(places) and places.max() > most:  # the last position stands for all later ones
            places = np.minimum(places, most)
            kept = new.copy()
            kept[1:] |= places[1:] != places[:-1]
            codes, rows, places, new = codes[kept], rows[kept], places[kept], new[kept]
        at = np.flatnonzero(new)
        bounds = np.append(at, len(codes)).astype(np.int32)
        return codes[at], rows[at], pa.ListArray.from_arrays(pa.array(bounds), pa.array(places.astype(np.int32)))

    def named(self, codes: np.ndarray) -> pa.Array:
        used, at = np.unique(codes, return_inverse=True)
        return pa.array([self.names[n] for n in used.tolist()], pa.string()).take(pa.array(at))


def _read(source: Iterator[pa.RecordBatch], analyser: str, wanted: frozenset[str] | None, by_text: bool, full: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, pa.ListArray]]:
    """Stretches of the batches, and of the texts in their last column the lexemes, each lexeme's text in the stretch and its positions."""
    lexemes = _Lexemes(analyser, wanted)
    for b in source:
        column, texts, first, size = b.column(b.num_columns - 1), [], 0, 0
        for k in range(b.num_rows):
            texts.append(lexemes.numbers(column[k].as_py()))
            size += len(texts[-1])
            if size > full or k == b.num_rows - 1:
                codes, rows, places = lexemes.grouped(texts, by_text)
                yield b.slice(first, len(texts)), lexemes.named(codes), rows, places
                texts, first, size = [], k + 1, 0
                if len(lexemes) > _KEPT:
                    lexemes = _Lexemes(analyser, wanted)


def postings(chunks: DataFrame, analyser: str = lexer.ENGLISH, wanted: frozenset[str] | None = None) -> DataFrame:
    """lexeme, id and positions of every lexeme of `chunks` (id, text), or of the `wanted` ones alone; no shuffle."""
    kind = T.StructType([T.StructField("lexeme", T.StringType()), chunks.schema["id"], T.StructField("positions", T.ArrayType(T.IntegerType()))])
    full = _TOKENS

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, names, rows, places in _read(source, analyser, wanted, False, full):
            yield pa.RecordBatch.from_arrays([names, b.column(0).take(pa.array(rows)), places], kind.names)

    small_batches(chunks.sparkSession)
    return chunks.select("id", "text").filter("id IS NOT NULL").mapInArrow(read, kind)


def few(lexemes: DataFrame) -> frozenset[str] | None:
    """Those `lexemes` (lexeme), if there are few enough to be looked for in the tasks that read texts."""
    found = lexemes.select("lexeme").distinct().limit(FEW + 1).collect()
    return frozenset(r["lexeme"] for r in found) if len(found) <= FEW else None


def with_postings(chunks: DataFrame, lexemes: DataFrame, analyser: str = lexer.ENGLISH) -> DataFrame:
    """`chunks` with `found`, the `lexemes` (lexeme) that a text holds and their positions, in place of the text; more than a few lexemes are all kept."""
    own, full, wanted = [c for c in chunks.columns if c != "text"], _TOKENS, few(lexemes)
    kind = T.StructType([*(chunks.schema[c] for c in own), T.StructField("found", T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])))])

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, names, rows, places in _read(source, analyser, wanted, True, full):
            each = pa.StructArray.from_arrays([names, places], ["lexeme", "positions"])
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], kind.names)

    small_batches(chunks.sparkSession)
    return chunks.select(*own, "text").mapInArrow(read, kind)


def index_of(held: DataFrame, lexemes: DataFrame, analyser: str = lexer.ENGLISH) -> Index:
    """An index of `lexemes` (lexeme) from the postings (id, found) that `with_postings` has made."""
    rows = held.filter("id IS NOT NULL").select("id", F.explode("found").alias("f")).select("f.lexeme", "id", "f.positions").join(lexemes.select("lexeme").distinct(), "lexeme", "left_semi")
    return Index(rows, rows.groupBy("lexeme").agg(F.count(F.lit(1)).alias("n")), held.select("id").filter("id IS NOT NULL"), analyser, held.select("id", F.col("found").alias("x")))


def built(chunks: DataFrame, lexemes: DataFrame | None = None, analyser: str = lexer.ENGLISH) -> Index:
    """An index of `chunks` (id, text; ids are unique), of the `lexemes` (lexeme) alone where they are given."""
    wanted, rest = None, None
    if lexemes is not None:
        wanted = few(lexemes)
        rest = lexemes.select("lexeme").distinct() if wanted is None else None
    rows = postings(chunks, analyser, wanted)
    rows = settle(rows if rest is None else rows.join(rest, "lexeme", "left_semi"))
    return Index(rows, rows.groupBy("lexeme").agg(F.count(F.lit(1)).alias("n")), chunks.select("id").filter("id IS NOT NULL"), analyser)


class TextIndex:
    """An index stored below `path`; `buckets` (folders of a segment: more for larger ones) and `analyser` are fixed by its first upsert."""

    def __init__(self, spark: SparkSession, path: str, analyser: str = lexer.ENGLISH, buckets: int = 16, fan: int = 4):
        self.table = SnapshotTable(spark, path)
        self._first = {"analyser": analyser, "buckets": buckets, "id": None}
        self.fan = fan

    def _info(self, now: Snapshot) -> dict:
        return now.info or self._first

    def _bucket(self, lexeme: Column, info: dict) -> Column:
        return F.pmod(F.xxhash64(lexeme), F.lit(info["buckets"])).cast("int")

    @property
    def analyser(self) -> str:
        return self._info(self.table.current())["analyser"]

    # -- writing --------------------------------------------------------------------

    def upsert(self, chunks: DataFrame) -> Snapshot:
        """Index `chunks` (id, text; ids are unique), in place of what was indexed of those ids."""
        now = self.table.current()
        info = {**self._info(now), "id": chunks.schema["id"].dataType.simpleString()}
        if now.info and now.info["id"] != info["id"]:
            raise TypeError(f"ids of this index are {now.info['id']}, not {info['id']}")
        ids = settle(chunks.select("id").filter("id IS NOT NULL"))
        segment = self._segment(postings(chunks, info["analyser"]), ids, info)
        self._publish(segment, ids, info)
        return self.merge()

    def delete(self, ids: DataFrame) -> Snapshot:
        """Take ids (id) out."""
        now = self.table.current()
        return self._publish([], settle(ids.select("id").distinct()), self._info(now)) if now.version else now

    def _segment(self, rows: DataFrame, ids: DataFrame, info: dict, gather: bool = False) -> list[dict]:
        """Write a segment.  Postings go to their folders from the tasks that made them, which cost no copy but the segment itself; merges `gather` a folder's in few files."""
        placed = rows.withColumn("bucket", self._bucket(F.col("lexeme"), info))
        dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "id") if gather else placed  # a bucket of a hot lexeme is split
        n = ids.count()
        part = self.table.write_part(dealt, ("bucket",), _PACKED, kind="postings", rows=n)
        written = self.table.spark.read.schema(self._schema("postings", info)).parquet(f"{self.table.path}/{part['path']}")
        counts = written.groupBy("bucket", "lexeme").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("bucket", "lexeme")
        return [part, self.table.write_part(counts, ("bucket",), kind="terms"), self.table.write_part(ids, kind="ids")]

    def _publish(self, segment: list[dict], ids: DataFrame, info: dict) -> Snapshot:
        def step(now: Snapshot) -> Snapshot:
            seq = now.version + 1
            parts = [*now.parts, *({**p, "seq": seq} for p in segment)]
            if any(p["kind"] == "ids" for p in now.parts):
                dead = ids.join(self._of(now, "ids", info).select("id").distinct(), "id", "left_semi")
                parts.append(self.table.write_part(dead, kind="dead", seq=seq))
            return self.table.publish(now, parts, info=info)

        return self.table.change(step)

    def merge(self) -> Snapshot:
        """Merge segments of like size (within a factor of `fan`) as long as there are `fan` of them."""
        while True:
            now = self.table.current()
            info, tiers = self._info(now), {}
            for p in now.parts:
                if p["kind"] == "postings":
                    tiers.setdefault(int(math.log(max(p["rows"], 1), self.fan)), []).append(p["seq"])
            full = [sorted(s) for _, s in sorted(tiers.items()) if len(s) >= self.fan]
            if not full:
                return now
            gone = set(full[0])
            rows, ids = (self._live(now, kind, info, gone) for kind in ("postings", "ids"))
            segment = [{**p, "seq": max(gone)} for p in self._segment(rows.drop("bucket"), settle(ids), info, gather=True)]

            def step(new: Snapshot, gone: set = gone, segment: list = segment, info: dict = info) -> Snapshot:
                if not gone <= {p["seq"] for p in new.parts if p["kind"] == "postings"}:
                    return new  # another writer has merged them
                kept = [p for p in new.parts if p["seq"] not in gone or p["kind"] == "dead"]
                oldest = min(p["seq"] for p in [*kept, *segment] if p["kind"] == "postings")
                return self.table.publish(new, [*(p for p in kept if p["kind"] != "dead" or p["seq"] > oldest), *segment], info=info)

            self.table.change(step)

    # -- reading --------------------------------------------------------------------

    def _schema(self, kind: str, info: dict) -> str:
        columns = {"postings": f"lexeme string, id {info['id']}, positions array<int>, bucket int", "terms": "lexeme string, n long, bucket int", "ids": f"id {info['id']}", "dead": f"id {info['id']}"}
        return columns[kind]

    def _of(self, now: Snapshot, kind: str, info: dict, only: set[int] | None = None) -> DataFrame:
        spark = self.table.spark
        own = [p for p in now.parts if p["kind"] == kind and (only is None or p["seq"] in only)]
        read = [spark.read.schema(self._schema(kind, info)).parquet(f"{self.table.path}/{p['path']}").withColumn("seq", F.lit(p["seq"])) for p in own]
        return reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], self._schema(kind, info) + ", seq int")

    def _live(self, now: Snapshot, kind: str, info: dict, only: set[int] | None = None, buckets: list[int] | None = None, lexemes: DataFrame | None = None) -> DataFrame:
        """Rows of postings or ids that no later segment or deletion has replaced; with `buckets` and `lexemes`, of those alone, which are looked up first."""
        rows = self._of(now, kind, info, only)
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        rows = rows if lexemes is None else rows.join(lexemes, "lexeme", "left_semi")
        if not any(p["kind"] == "dead" for p in now.parts):
            return rows.drop("seq")
        dead = self._of(now, "dead", info).groupBy("id").agg(F.max("seq").alias("until"))
        return rows.join(dead, "id", "left").filter("until IS NULL OR until <= seq").drop("seq", "until")

    def open(self, lexemes: DataFrame | None = None, alone: bool = False) -> Index:
        """The newest snapshot; with `lexemes` (lexeme), of their folders, or of them `alone`."""
        now = self.table.current()
        info = self._info(now)
        if info["id"] is None:
            raise FileNotFoundError(f"nothing has been indexed in {self.table.path}")
        buckets = asked = None
        if lexemes is not None:  # numbers below `buckets`, not lexemes, come to the driver
            asked = settle(lexemes.select("lexeme").distinct())  # of known size, so that a few are sent to the postings
            buckets = sorted(r["b"] for r in asked.select(self._bucket(F.col("lexeme"), info).alias("b")).distinct().collect())
        rows = self._live(now, "postings", info, buckets=buckets, lexemes=asked if alone else None).select("lexeme", "id", "positions")
        terms = self._of(now, "terms", info)
        terms = terms if buckets is None else terms.filter(F.col("bucket").isin(buckets))
        terms = terms.join(asked, "lexeme", "left_semi") if alone else terms
        return Index(rows, terms.groupBy("lexeme").agg(F.sum("n").alias("n")), self._live(now, "ids", info), info["analyser"])
