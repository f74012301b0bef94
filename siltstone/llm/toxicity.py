"""Toxic spans and document scores from a linear-chain conditional random field.

Only documents are labelled, so tokens get their labels from them.  In a document
of label 0 no token is toxic.  In one of label 1 the tokens are whose words stand
out in such documents beyond chance and many times over; its other tokens stay
open, and the forward pass with the labelled ones held fast against the free one
is the likelihood that training climbs.  A document of label 1 without such a
token is a bag: at least one of its tokens is toxic.  A token's features are its word, its beginning and end, its shape, and the words before and after;
label transitions tie neighbours together.  Forward-backward marginals give
offending spans, and their sum, maximum and density give the document's score
through a logistic calibration on the document labels.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_sample, in_arrow, settle

_WORD = re.compile(r"\w+")
_AFFIXES, _SHAPES, _CACHE_WORDS = 4096, 8, 200_000


@dataclass(frozen=True)
class ToxicityParams:
    #: Bound of the training sample: documents for each label, windows of each, tokens of a window.
    docs_per_label: int = 3000
    windows_per_doc: int = 3
    window: int = 32
    #: Words with weights of their own: at most, and in so many documents of the sample at least.
    vocabulary: int = 20_000
    least_docs: int = 3
    #: Characters of a beginning or end.
    affix: int = 3
    #: Log-likelihood ratio from which a word's odds are its weight before training; chance gives no word so much.
    evidence: float = 25.0
    #: Log-odds from which a word of that evidence labels its tokens in documents of label 1: 20 times as common there.
    labelled: float = 3.0
    #: Passes, steps that even a small sample gets, documents of a step, step size, and pull of all weights back to those before training.
    epochs: int = 8
    least_steps: int = 500
    batch: int = 256
    rate: float = 0.05
    ridge: float = 1e-3
    seed: int = 11


def _shape(word: str) -> int:
    """Kinds of characters: digits inside, all capitals, a capital first, a character three times on end."""
    return (not word.isalpha()) * 4 + (2 if len(word) > 1 and word.isupper() else word[:1].isupper()) if not re.search(r"(.)\1\1", word) else 7


def _affix(part: str, end: int) -> int:
    return xxhash.xxh3_64_intdigest(part, seed=end) % _AFFIXES


class _Slots(dict):
    """Words met so far, with the sums of the weights of their own features; new ones are worked out when asked for."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.values = chain, np.zeros((1024, 3))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        c = self.chain
        word_id, begin, end, shape = c.features(word)
        self.values[at] = c.word[word_id] + c.begin[begin] + c.end[end] + c.shape[shape] + c.bias[0], c.before[word_id], c.after[word_id]
        self[word] = at
        return at


class Chain:
    """Two labels; label 0 has emission 0, label 1 the sum of its features' weights.  Weights are blocks of one vector."""

    def __init__(self, words: list[str], odds: np.ndarray, affix: int = 3):
        self.index = {w: i + 1 for i, w in enumerate(words)}  # 0: any other word
        self.affix, n = affix, len(words) + 1
        sizes = {"word": n, "before": n, "after": n, "begin": _AFFIXES, "end": _AFFIXES, "shape": _SHAPES, "bias": 1, "step": 4}
        self.weights = np.zeros(sum(sizes.values()))
        self.places, at = {}, 0
        for name, size in sizes.items():
            self.places[name] = (at, at + size)
            at += size
        self.word[1:] = np.clip(odds, 0.0, 6.0)
        self.bias[0] = -4.0
        self.calibration = np.zeros(4)

    def __getattr__(self, name: str) -> np.ndarray:
        places = self.__dict__.get("places", {})
        if name not in places:
            raise AttributeError(name)
        return self.weights[slice(*places[name])]

    def features(self, word: str) -> tuple[int, int, int, int]:
        low = word.lower()
        return self.index.get(low, 0), _affix(low[: self.affix], 0), _affix(low[-self.affix :], 1), _shape(word)

    # -- training -------------------------------------------------------------

    def _pass(self, x: np.ndarray, size: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log Z of windows (with the score of no toxic token as 0), P(label 1) of their tokens, and expected transitions, with the tokens `held` of label 1."""
        rows, width = x.shape[:2]
        live = np.arange(width)[None, :] < size[:, None]
        e = np.clip(self.emission(x), -30, 30)
        e = np.exp(e if held is None else np.where(held, 30.0, e))
        t = np.exp(self.step.reshape(2, 2))
        alpha, beta, total = np.ones((width, rows, 2)), np.ones((width, rows, 2)), np.zeros(rows)
        for i in range(width):
            a = alpha[i - 1] @ t if i else np.ones((rows, 2))
            a[:, 1] *= e[:, i]
            norm = a.sum(1, keepdims=True)
            alpha[i] = np.where(live[:, i, None], a / norm, alpha[i - 1] if i else 0.5)
            total += np.where(live[:, i], np.log(norm[:, 0]), 0.0)
        for i in range(width - 2, -1, -1):
            b = beta[i + 1].copy()
            b[:, 1] *= e[:, i + 1]
            b = b @ t.T
            beta[i] = np.where(live[:, i + 1, None], b / b.sum(1, keepdims=True), 1.0)
        both = alpha * beta
        p = np.where(live, (both[..., 1] / both.sum(2)).T, 0.0)
        joint = np.zeros((rows, 2, 2))
        for i in range(width - 1):
            nxt = beta[i + 1] * np.stack((np.ones(rows), e[:, i + 1]), 1)
            two = alpha[i][:, :, None] * t[None] * nxt[:, None, :]
            joint += np.where(live[:, i + 1, None, None], two / two.sum((1, 2), keepdims=True), 0.0)
        quiet = self.step[0] * np.maximum(size - 1, 0)  # the score of label 0 throughout
        joint[:, 0, 0] -= np.maximum(size - 1, 0)
        return total - quiet, p, joint

    def emission(self, x: np.ndarray) -> np.ndarray:
        """Emission of label 1 for tokens (..., 6): word, before, after, beginning, end, shape."""
        names = ("word", "before", "after", "begin", "end", "shape")
        return self.bias[0] + sum(getattr(self, name)[x[..., k]] for k, name in enumerate(names))

    def fit(self, x: np.ndarray, size: np.ndarray, owner: np.ndarray, toxic: np.ndarray, sure: np.ndarray, params: ToxicityParams) -> None:
        """Climb the likelihood of the labels, by Adam over batches of documents.

        `x` has the windows' tokens, `size` their numbers, `owner` each window's
        document, in order, `toxic` the documents' labels, and `sure` is true
        for words that label their tokens.
        """
        held = sure[x[..., 0]] & (toxic[owner] == 1)[:, None] & (np.arange(x.shape[1])[None, :] < size[:, None])
        told = np.zeros(len(toxic), bool)
        told[owner[held.any(1)]] = True
        rng = np.random.default_rng(params.seed)
        m, v, step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        start = np.searchsorted(owner, np.arange(len(toxic) + 1))
        names = ("word", "before", "after", "begin", "end", "shape")
        given = self.weights.copy()
        each = max(1, -(-len(toxic) // params.batch))
        passes = max(params.epochs, -(-params.least_steps // each))
        for _ in range(passes):
            order = rng.permutation(len(toxic))
            for lo in range(0, len(order), params.batch):
                docs = np.sort(order[lo : lo + params.batch])
                rows = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
                if not len(rows):
                    continue
                own = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
                part = x[rows]
                z, p, joint = self._pass(part, size[rows])
                load = np.bincount(own, weights=z, minlength=len(docs))
                # d/dz of -log P: 1 where no token may be toxic, -1 / (exp z - 1) where one must be
                pull = np.where(toxic[docs] == 1, -1 / np.expm1(np.clip(load, 1e-3, 30)), 1.0)[own]
                gap, moves = p * pull[:, None], joint * pull[:, None, None]
                mine = np.flatnonzero(told[docs][own])
                if len(mine):  # the free chain less the one with labelled tokens held
                    _, fixed, steps = self._pass(part[mine], size[rows][mine], held[rows][mine])
                    gap[mine], moves[mine] = p[mine] - fixed, joint[mine] - steps
                grad = params.ridge * (self.weights - given)
                for k, name in enumerate(names):
                    a, b = self.places[name]
                    grad[a:b] += np.bincount(part[..., k].ravel(), weights=gap.ravel(), minlength=b - a) / len(docs)
                grad[slice(*self.places["bias"])] += gap.sum() / len(docs)
                grad[slice(*self.places["step"])] += moves.sum(0).ravel() / len(docs)
                step += 1
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rate = params.rate * (1 - (step - 1) / (passes * each))
                self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Logistic regression of document labels on the aggregates, by Newton steps with a small ridge."""
        design = np.column_stack((np.ones(len(x)), x))
        c, ridge = np.zeros(4), np.diag([1e-6, 1e-4, 1e-4, 1e-4]) * weights.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ c, -30, 30)))
            h = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge
            step = np.linalg.solve(h, design.T @ (weights * (labels - p)) - ridge @ c)
            c += step
            if np.abs(step).max() < 1e-8:
                break
        self.calibration = c

    # -- application ----------------------------------------------------------

    def marginals(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(label 1) of each token of a stream of documents, from label 1's emissions; `first` marks where a document begins.

        A chain of two labels is a chain of ratios, and each step a fractional
        linear map of the ratio.  The stream is laid out in columns: the maps of
        each column are composed for all columns at once, the columns' ends are
        linked, and a second sweep fills in the ratios.  At a document's start
        the map is constant, so documents don't touch.
        """
        n = len(score)
        if not n:
            return np.empty(0)
        ends = np.append(first[1:], True)
        e = np.exp(np.clip(score, -30, 30))
        t = np.exp(self.step.reshape(2, 2))
        rows = max(1, int(np.sqrt(n)))
        columns = -(-n // rows)
        pad = columns * rows - n

        def lay(x: np.ndarray, fill: float) -> np.ndarray:
            return np.ascontiguousarray(np.append(x, np.full(pad, fill)).reshape(columns, rows).T)

        def sweep(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, start: float) -> np.ndarray:
            """Ratios after each of the maps r -> (a + b r) / (c + d r)."""
            pa_, pb, pc, pd = np.zeros(columns), np.ones(columns), np.ones(columns), np.zeros(columns)
            for i in range(rows):
                pa_, pb, pc, pd = a[i] * pc + b[i] * pa_, a[i] * pd + b[i] * pb, c[i] * pc + d[i] * pa_, c[i] * pd + d[i] * pb
                top = pc + pd + pa_ + pb
                pa_, pb, pc, pd = pa_ / top, pb / top, pc / top, pd / top
            ratio, at = np.empty(columns), start
            for k in range(columns):
                ratio[k] = at
                at = (pa_[k] + pb[k] * at) / (pc[k] + pd[k] * at)
            out = np.empty((rows, columns))
            for i in range(rows):
                ratio = (a[i] + b[i] * ratio) / (c[i] + d[i] * ratio)
                out[i] = ratio
            return out.T.ravel()

        start = first.astype(float)
        keep = 1 - start
        forward = sweep(lay(e * (start + keep * t[0, 1]), 0.0), lay(e * keep * t[1, 1], 1.0), lay(start + keep * t[0, 0], 1.0), lay(keep * t[1, 0], 0.0), 1.0)[:n]
        nxt, last = np.append(e[1:], 1.0)[::-1], ends[::-1].astype(float)
        on = 1 - last
        backward = sweep(lay(last + on * t[1, 0], 0.0), lay(on * t[1, 1] * nxt, 1.0), lay(last + on * t[0, 0], 1.0), lay(on * t[0, 1] * nxt, 0.0), 1.0)[:n][::-1]
        both = forward * backward
        return both / (1 + both)

    def emissions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label 1's emission of every token of all texts, and the number of tokens before each text and after the last."""
        slots = self.__dict__.setdefault("slots", _Slots(self))
        if len(slots) > _CACHE_WORDS:
            self.slots = slots = _Slots(self)
        at, edge = [], [0]
        for t in texts:
            at += map(slots.__getitem__, _WORD.findall(t)) if t else ()
            edge.append(len(at))
        value, edge = slots.values[np.array(at, np.int64)], np.array(edge)
        before, after = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
        before[1:], after[: len(at)] = value[:, 1], value[:, 2]
        before[edge], after[edge] = self.before[0], self.after[0]  # beyond a text's ends is as any other word
        return value[:, 0] + before[:-1] + after[1:], edge

    def score(self, texts: list[str | None], spans: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Aggregates and score of each text, and its offending spans (in characters) if asked for."""
        value, edge = self.emissions(texts)
        size = np.diff(edge)
        first = np.zeros(len(value), bool)
        first[edge[:-1][size > 0]] = True
        p = self.marginals(value, first)
        total = np.concatenate(([0.0], np.cumsum(p)))
        x = np.zeros((len(texts), 3))
        mass = np.maximum(total[edge[1:]] - total[edge[:-1]], 0)
        x[:, 0] = np.log1p(mass)
        x[:, 2] = np.log1p(100 * mass / np.maximum(size, 1))
        if len(p):
            x[size > 0, 1] = np.maximum.reduceat(p, edge[:-1][size > 0])
        z = np.clip(self.calibration[0] + x @ self.calibration[1:], -30, 30)
        found: list[list[tuple[int, int]]] = []
        for k, t in enumerate(texts if spans else []):
            hits = np.flatnonzero(p[edge[k] : edge[k + 1]] > 0.5)
            at = [m.span() for m in _WORD.finditer(t)] if len(hits) else []
            found.append([at[h] for h in hits])
        return x, 1 / (1 + np.exp(-z)), found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}


def _tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def train(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Chain | float:
    """Fit the chain on documents (doc_id, text) and labels (doc_id, toxic).

    Uses at most about `docs_per_label` documents of each label.  Equal texts
    count once, as toxic if one of them is labelled so; so does a doc_id with
    several labels.  With fewer than two labels among them, the rate of label 1
    instead of a chain.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rates) < 2:
        return float(next(iter(rates), 0))
    chosen = bounded_sample(marked, "doc_id", "toxic", params.docs_per_label, params.seed)
    held = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = settle(held.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return float(next(iter(n), 0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sorted(set(_tokens(text)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], ["word", "toxic"])

    with_toxic, without = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    share = n[1] / (n[0] + n[1])
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("a") + F.col("b")) / of)).otherwise(0.0)
    evident = 2 * (part("a", share) + part("b", 1 - share)) >= params.evidence
    vocabulary = (
        in_arrow(sample.select("toxic", "text"), words, "word string, toxic int").groupBy("word").agg(with_toxic.alias("a"), without.alias("b"))
        .filter(F.col("a") + F.col("b") >= params.least_docs).withColumn("odds", F.when(evident, odds).otherwise(0.0)).orderBy(F.desc(F.abs("odds")), F.desc(F.col("a") + F.col("b")), "word").limit(params.vocabulary).collect()
    )
    vocabulary.sort(key=lambda r: r["word"])
    known_odds = {r["word"]: r["odds"] for r in vocabulary if r["odds"]}
    width, per_doc = params.window, params.windows_per_doc

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around the words of most evidence, each outside those before it, and one anywhere."""
        for b in batches:
            out: list[tuple[int, int, list[str]]] = []
            for doc, toxic, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = _WORD.findall(text or "")
                if not tokens:
                    continue
                rng = np.random.default_rng([params.seed, doc & 0x7FFFFFFF])
                score = np.array([known_odds.get(t.lower(), 0.0) for t in tokens]) + rng.random(len(tokens)) * 1e-3
                starts: list[int] = [int(rng.integers(0, max(1, len(tokens) - width + 1)))]
                for _ in range(per_doc - 1):
                    at = int(score.argmax())
                    starts.append(max(0, at - width // 2))
                    score[starts[-1] : starts[-1] + width] = -np.inf
                    if np.isneginf(score).all():
                        break
                out += [(doc, toxic, tokens[s : s + width]) for s in sorted(set(starts))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_id", "toxic", "tokens"])

    cut = in_arrow(sample, windows, "doc_id long, toxic int, tokens array<string>").toArrow().to_pylist()
    cut.sort(key=lambda r: (r["doc_id"], r["tokens"]))
    chain = Chain([r["word"] for r in vocabulary], np.array([r["odds"] for r in vocabulary]), params.affix)
    x, size, known = np.zeros((len(cut), width, 6), np.int32), np.array([len(r["tokens"]) for r in cut]), {}
    for i, r in enumerate(cut):
        for t in r["tokens"]:
            if t not in known:
                known[t] = chain.features(t)
        f = np.array([known[t] for t in r["tokens"]], np.int32)
        x[i, : size[i], 0], x[i, : size[i], 3:] = f[:, 0], f[:, 1:]
        x[i, 1 : size[i], 1], x[i, : size[i] - 1, 2] = f[:-1, 0], f[1:, 0]
    ids, owner = np.unique([r["doc_id"] for r in cut], return_inverse=True) if cut else (np.empty(0), np.empty(0, np.int64))
    toxic = np.zeros(len(ids), np.int64)
    toxic[owner] = [r["toxic"] for r in cut]
    sure = np.array([False, *(r["odds"] >= params.labelled for r in vocabulary)])
    chain.fit(x, size, owner, toxic, sure, params)
    model = documents.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for b in batches:
            x, _, _ = own.score(b.column(2).to_pylist(), spans=False)
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), *(pa.array(x[:, i]) for i in range(3))], ["toxic", "x0", "x1", "x2"])

    got = in_arrow(sample, measure, "toxic int, x0 double, x1 double, x2 double").toArrow()
    table = np.stack([np.asarray(got.column(c), np.float64) for c in ("toxic", "x0", "x1", "x2")], 1)
    table = table[np.lexsort(table.T[::-1])]
    weight = np.where(table[:, 0] == 1, rates[1] / n[1], rates[0] / n[0])
    chain.calibrate(table[:, 1:], table[:, 0], weight / weight.mean())
    return chain


SCHEMA = "score double, spans array<struct<start:int,end:int>>"


def score(docs: DataFrame, chain: Chain | float) -> DataFrame:
    """doc_id, score and offending spans for every row of `docs` (doc_id, text).

    Null and empty texts get the score of no evidence.  Whole texts are read in
    batches of bounded size.  Repeated rows are scored alike, an empty table
    gives an empty result, and other columns are ignored.  Spans count
    characters of the text.
    """
    if isinstance(chain, float):
        return docs.select("doc_id", F.lit(chain).alias("score"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>").alias("spans"))
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                _, value, spans = own.score(b.column(1).slice(lo, 256).to_pylist(), spans=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(value), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)], ["doc_id", "score", "spans"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, {SCHEMA}")
