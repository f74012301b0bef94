"""Token ids written as patched frame-of-reference files, and read back.

File layout (little-endian)::

    magic "PFR2"
    blocks     each: minimum u32, width u8, ids u16, exceptions u16,
               packed ids, exception positions u16, their higher bits u16 or u32
    index      byte offset of each block, u64
    documents  ids as i64, then a null flag u8 each, then token counts u64
    footer     blocks u64, documents u64, index offset u64, block size u32, magic

A block stores each id minus the block's minimum in as many bits as one of a few
percentiles of its values needs, whichever makes the block smallest; larger
values keep their low bits in place and the rest in the exception list.  The
index lets a reader start at any block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow, passing, settle, shared_dir

MAGIC = b"PFR2"
BLOCK, HEAD, FOOT = 4096, struct.Struct("<IBHH"), struct.Struct("<QQQI4s")
PERCENTILES = (50, 75, 90, 95, 98, 99, 100)


# -- tokenizing ------------------------------------------------------------

#: Texts of these characters alone take the cached path: they have one
#: normal form, and lower-casing and splitting them is the same in Python.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The vocabulary file's own splitting rule, for plain lower-cased text.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_CACHE_ENTRIES = 800_000


#: The rules of a vocabulary file under which `_PLAIN` and `_SPLIT` hold: fixed values of the file format.
_NORMAL_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_rules(path: str) -> bool:
    """Whether the file normalises and splits by the rules that the cached path restates."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    normal, split = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    rules = [r.get("pattern", {}).get("Regex") for r in split.get("pretokenizers", ()) if r.get("type") == "Split"]
    return normal.get("normalizers") == _NORMAL_FORM and rules == [_SPLIT_RULE]


class CachedEncoder:
    """The tokenizers library, asked once for each distinct pre-token of new words.

    Ids are kept as little-endian u32 bytes, so a document is one join.  A text
    outside `_PLAIN`, or one that may hold a special token's string, goes to the
    library whole; so does every text if the file has other rules than these.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cached = _known_rules(path)
        self.known: dict[bytes, bytes] = {}

    def _parts(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of each pre-token; tokens are sent in lines and cut apart again where a word ends."""
        lines = [tokens[lo : lo + 200] for lo in range(0, len(tokens), 200)]
        got: dict[str, bytes] = {}
        for line, encoded in zip(lines, self.parts.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(line):  # a vocabulary without word ends can't be cut this way
                got.update((t, np.array(self.parts.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for t in line)
                continue
            raw, at = ids.tobytes(), 0
            for t, end in zip(line, cuts.tolist(), strict=True):
                got[t] = raw[at:end]
                at = end
        return got

    def _learn(self, words: set[bytes]) -> None:
        split = {w: _SPLIT.findall(w.decode()) for w in words}
        ids = self._parts(list({t for tokens in split.values() for t in tokens}))
        for w, tokens in split.items():
            self.known[w] = ids[tokens[0]] if len(tokens) == 1 else b"".join([ids[t] for t in tokens])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split, new = [], set()
        for t in texts:
            if t and self.cached and _PLAIN.fullmatch(t) and "<|" not in t:
                t = t.lower().encode().split()
                new.update(t)
            split.append(t)
        if len(self.known) > _CACHE_ENTRIES:
            self.known.clear()
        if new := new.difference(self.known):
            self._learn(new)
        ids = self.known.__getitem__
        return [b"".join(map(ids, t)) if isinstance(t, list) else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"" for t in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


# -- blocks ----------------------------------------------------------------


def _rest(width: int) -> tuple[str, int]:
    """How the bits above `width` are stored, and in how many bytes."""
    return ("<u2", 2) if width >= 16 else ("<u4", 4)


def _width(rest: np.ndarray, percentiles: tuple[int, ...]) -> int:
    """Bits that a percentile of the values needs, of the percentile that makes the block smallest."""
    inside = np.cumsum(np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=33))  # values of so many bits at most
    need = np.searchsorted(inside, [max(1, int(np.ceil(len(rest) * p / 100))) for p in percentiles])
    return min((-(-len(rest) * int(w) // 8) + int(inside[-1] - inside[w]) * (2 + _rest(int(w))[1]), int(w)) for w in np.unique(need))[1]


def pack_block(ids: np.ndarray, percentiles: tuple[int, ...] = PERCENTILES) -> bytes:
    """One block of u32 ids, 65,535 at most, packed at the width of one of the percentiles."""
    low = int(ids.min())
    rest = ids.astype("<u4") - np.uint32(low)
    width = _width(rest, percentiles)
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits, bitorder="little").tobytes()
    high = (rest[over] >> np.uint32(width)).astype(_rest(width)[0]) if len(over) else np.empty(0, "<u2")
    return HEAD.pack(low, width, len(ids), len(over)) + packed + over.astype("<u2").tobytes() + high.tobytes()


def unpack_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at `at`, and the offset after it."""
    low, width, n, odd = HEAD.unpack_from(raw, at)
    at += HEAD.size
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little")
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits.reshape(n, width)
    ids = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    kind, each = _rest(width)
    if odd:
        ids[np.frombuffer(raw, "<u2", odd, at)] |= np.frombuffer(raw, kind, odd, at + 2 * odd).astype("<u4") << np.uint32(width)
    return ids + np.uint32(low), at + (2 + each) * odd


class BlockWriter:
    def __init__(self, out, block: int = BLOCK):  # noqa: ANN001
        self.out, self.block, self.rest = out, block, np.empty(0, "<u4")
        self.index: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.at = self.out.write(MAGIC)

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        self.docs += [(d, len(x) // 4) for d, x in zip(docs, ids, strict=True)]
        stream = np.concatenate((self.rest, np.frombuffer(b"".join(ids), "<u4")))
        full = len(stream) // self.block * self.block
        for lo in range(0, full, self.block):
            self._put(stream[lo : lo + self.block])
        self.rest = stream[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        self.index.append(self.at)
        self.at += self.out.write(pack_block(ids))

    def close(self) -> int:
        if len(self.rest):
            self._put(self.rest)
        begin = self.at
        self.out.write(np.array(self.index, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d, _ in self.docs], "u1").tobytes())
        self.out.write(np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(FOOT.pack(len(self.index), len(self.docs), begin, self.block, MAGIC))
        return sum(n for _, n in self.docs)


class BlockReader:
    """Random access to a file's ids through its block index."""

    def __init__(self, source):  # noqa: ANN001
        self.source = source
        size = source.size()
        source.seek(size - FOOT.size)
        blocks, docs, begin, self.block, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(begin)
        raw = source.read(size - FOOT.size - begin)
        self.index = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(begin)).astype(np.int64)
        at = 8 * blocks
        ids, null = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "u1", docs, at + 8 * docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n of the file; only the blocks that hold them are read."""
        if not n:
            return np.empty(0, "<u4")
        lo, hi = first // self.block, (first + n - 1) // self.block + 1
        self.source.seek(int(self.index[lo]))
        raw, at, got = self.source.read(int(self.index[hi] - self.index[lo])), 0, []
        for _ in range(lo, hi):
            ids, at = unpack_block(raw, at)
            got.append(ids)
        return np.concatenate(got)[first - lo * self.block :][:n]


# -- the operator ----------------------------------------------------------


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode `text`, append `end_id`, and write one file for each range of doc_id.

    Returns the manifest, which is itself stored: part, path, n_docs, n_tokens.
    Each attempt of a task writes a file of its own, and only files of finished
    tasks are in the manifest, so a lost executor leaves no half file behind it.
    Null text counts as empty; equal doc_ids keep all their rows, by text.  Rows
    without a doc_id come first.  Whole texts of any length are encoded, an empty
    table gives an empty manifest, and other columns are ignored.
    """
    own = folder is None
    folder = folder or shared_dir(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, sink = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 128):
                if sink is None:
                    fs, root = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.pfr"
                    out = fs.open_output_stream(f"{root}/{name}")
                    sink = BlockWriter(out)
                sink.add(ids[lo : lo + 128], [x + end for x in encode.encode(texts.slice(lo, 128).to_pylist())])
        if sink:
            total = sink.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(sink.docs)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = settle(in_arrow(ordered, write, "part int, path string, n_docs long, n_tokens long"))
    if own and not manifest.isEmpty():
        passing(docs.sparkSession, folder)
    return manifest


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and the ids themselves.

    The running total over files is taken over the manifest, which has one row
    for each file, not for each document.
    """
    files = manifest.count()
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("part", "path", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as source:
                    file = BlockReader(source)
                    edges = np.concatenate(([0], np.cumsum(file.counts)))
                    for lo in range(0, len(file.doc_ids), 512):
                        hi = min(lo + 512, len(file.doc_ids))
                        raw = file.ids(int(edges[lo]), int(edges[hi] - edges[lo])).tobytes()
                        cut = [raw[4 * int(a - edges[lo]) : 4 * int(b - edges[lo])] for a, b in zip(edges[lo:hi], edges[lo + 1 : hi + 1], strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(file.doc_ids[lo:hi], pa.int64()),
                                "start": pa.array(base + edges[lo:hi]),
                                "n_tokens": pa.array(file.counts[lo:hi]),
                                "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                                "ids": pa.array(cut, pa.binary()),
                            }
                        )

    spread = placed.select("path", "before").repartition(max(1, files))
    return in_arrow(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
