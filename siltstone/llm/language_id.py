"""Language identification with a byte convolutional network.

The network reads windows of bytes: filters of several widths slide over the
window, each filter keeps its largest response, and a softmax layer turns those
maxima into language probabilities.  It is trained in numpy on a bounded sample
of labelled text and applied to every window of every text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_sample, in_arrow

UNDETERMINED = "und"
CLASSES = 64  # byte classes, 0 is padding


@dataclass(frozen=True)
class LanguageIdParams:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    #: Bound of the training sample: documents per language, windows of each.
    docs_per_language: int = 1500
    windows_per_doc: int = 4
    #: Passes over the sample, and steps that even a small sample gets.
    epochs: int = 4
    least_steps: int = 400
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


class ByteNet:
    """Byte classes, one table of filter weights for each width, and a softmax layer."""

    def __init__(self, params: LanguageIdParams, classes: np.ndarray, languages: list[str]):
        rng = np.random.default_rng(params.seed)
        self.params, self.classes, self.languages = params, classes, languages
        self.filters = [rng.normal(0, 0.3, (w, CLASSES, params.filters)).astype(np.float32) for w in params.widths]
        self.dense = rng.normal(0, 0.1, (len(params.widths) * params.filters, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    # -- training ---------------------------------------------------------

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for table in self.filters:
            span = codes.shape[1] - len(table) + 1
            out = table[0][codes[:, :span]]
            for j in range(1, len(table)):
                out = out + table[j][codes[:, j : j + span]]
            at = out.argmax(1)
            where.append(at)
            tops.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
        return np.concatenate(tops, 1), where

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam on the cross entropy; only a filter's winning position gets a gradient."""
        p, rng = self.params, np.random.default_rng(self.params.seed)
        weights = [*self.filters, self.dense, self.bias]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        codes, step = self.classes[windows], 0
        each = -(-len(codes) // p.batch)
        for _ in range(max(p.epochs, -(-p.least_steps // each))):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), p.batch):
                rows = order[lo : lo + p.batch]
                x = codes[rows]
                tops, where = self._forward(x)
                hidden = np.maximum(tops, 0)
                logits = hidden @ self.dense + self.bias
                prob = np.exp(logits - logits.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(len(rows)), labels[rows]] -= 1
                prob /= len(rows)
                back = (prob @ self.dense.T) * (tops > 0)
                grads = []
                for k, table in enumerate(self.filters):
                    g, part = np.zeros_like(table), back[:, k * p.filters : (k + 1) * p.filters]
                    f = np.broadcast_to(np.arange(p.filters), where[k].shape)
                    for j in range(len(table)):
                        np.add.at(g[j], (np.take_along_axis(x, where[k] + j, 1), f), part)
                    grads.append(g)
                grads += [hidden.T @ prob, prob.sum(0)]
                step += 1
                for w, g, a, b in zip(weights, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= p.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    # -- application ------------------------------------------------------

    def compile(self) -> ByteNet:
        """Fold neighbouring byte classes into pair tables, which halves the look-ups."""
        self.pairs = []
        for table in self.filters:
            steps = []
            for j in range(0, len(table), 2):
                if j + 1 < len(table):
                    steps.append((j, True, np.ascontiguousarray((table[j][:, None] + table[j + 1][None]).reshape(CLASSES * CLASSES, -1))))
                else:
                    steps.append((j, False, table[j]))
            self.pairs.append((len(table), steps))
        return self

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        block = 32
        for lo in range(0, len(windows), block):
            code = self.classes[windows[lo : lo + block]]
            pair = code[:, :-1] * CLASSES + code[:, 1:]
            tops = []
            for width, steps in self.pairs:
                span, total = code.shape[1] - width + 1, None
                for j, paired, weights in steps:
                    part = np.take(weights, (pair if paired else code)[:, j : j + span], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                tops.append(total.max(1))
            logits = np.maximum(np.concatenate(tops, 1), 0) @ self.dense + self.bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[lo : lo + block] = e / e.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score of each text: the mean of its windows' probabilities, weighted by bytes."""
        size, width = [len(t) for t in texts], self.params.window
        counts = np.array([-(-n // width) for n in size], np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)))
        windows = np.zeros(int(starts[-1]) * width, np.uint8)
        for t, s, n in zip(texts, starts, size, strict=False):
            windows[s * width : s * width + n] = np.frombuffer(t, np.uint8)
        windows = windows.reshape(-1, width)
        prob = self.probabilities(windows) * (windows != 0).sum(1, keepdims=True)
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, np.repeat(np.arange(len(texts)), counts), prob)
        total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
        return total.argmax(1), total.max(1)


def _byte_classes(windows: np.ndarray) -> np.ndarray:
    """A class for each byte: letters in one case, the most frequent bytes apart, the rest together."""
    fold = np.arange(256)
    fold[65:91] += 32
    seen = np.bincount(fold[windows.ravel()], minlength=256)
    seen[0] = 0
    classes = np.full(256, CLASSES - 1, np.int32)
    classes[np.argsort(-seen, kind="stable")[: CLASSES - 2]] = np.arange(1, CLASSES - 1)
    classes[0] = 0
    return classes[fold]


def train(labelled: DataFrame, params: LanguageIdParams = LanguageIdParams()) -> ByteNet | None:
    """Fit the network on columns doc_id, text, lang.

    Uses at most about `docs_per_language` documents of each language and
    `windows_per_doc` windows of each, spread over the whole text.  None when no
    row has a language and a text with letters.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    chosen = bounded_sample(usable, "doc_id", "lang", params.docs_per_language, params.seed)
    per_doc, width = params.windows_per_doc, params.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for doc, text, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                rng = np.random.default_rng([params.seed, (doc or 0) & 0x7FFFFFFF])
                for at in rng.integers(0, max(1, len(raw) - width + 1), per_doc):
                    out.append(raw[at : at + width])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "raw"])

    got = in_arrow(chosen, cut, "lang string, raw binary").toArrow()
    if not got.num_rows:
        return None
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("raw").to_pylist(), strict=True))
    languages = sorted({lang for lang, _ in pairs})
    windows = np.zeros((len(pairs), width), np.uint8)
    for i, (_, raw) in enumerate(pairs):
        windows[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    labels = np.array([languages.index(lang) for lang, _ in pairs])
    return ByteNet(params, _byte_classes(windows), languages).fit(windows, labels)


def identify(docs: DataFrame, net: ByteNet | None, label: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Add the columns `label` and `score_name` to `docs`, which needs text.

    Null and letterless texts give `und` with score 0; so does every text when
    there was nothing to learn from.  Repeated rows are scored alike; of languages
    with equal scores the one first in order is taken.  Texts of any length are
    scored whole, window by window, and an empty table gives an empty result.  Columns
    of `docs` with the added names are replaced; choose others to keep them.
    """
    docs = docs.drop(label, score_name)
    if net is None:
        return docs.withColumns({label: F.lit(UNDETERMINED), score_name: F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    names = net.languages
    ready: list[ByteNet] = []

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        if not ready:
            ready.append(pickle.loads(model.value).compile())
        which, how = [], []
        todo = texts.tolist()
        for lo in range(0, len(todo), 256):
            raw = [(t or "").encode("utf-8", "replace") for t in todo[lo : lo + 256]]
            a, b = ready[0].predict(raw)
            which.append(a)
            how.append(b)
        if not which:
            return pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})
        return pd.DataFrame({"lang_pred": [names[i] for i in np.concatenate(which)], "score": np.concatenate(how).astype(float)})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    both = docs.withColumn(label, score(F.when(letters, F.col("text"))))
    return both.withColumns(
        {
            label: F.when(letters, F.col(label)["lang_pred"]).otherwise(F.lit(UNDETERMINED)),
            score_name: F.when(letters, F.least(F.col(label)["score"], F.lit(1.0))).otherwise(F.lit(0.0)),
        }
    )
