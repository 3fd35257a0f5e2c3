"""Language ID by a byte convolutional network, trained and applied in numpy.

A text's lower-cased bytes are cut into windows of ``WINDOW`` bytes (the last one padded), all of
them, over the whole text. Filters of several widths slide over the bytes; as a byte is one of 256,
a filter is a table of weights by place and byte, so that a convolution is a sum of look-ups. Rectified
and max-pooled over the window, the filters' outputs go through a softmax; a document's probabilities
are the mean of its windows', weighted by their bytes.

The network learns from at most ``per_language`` documents of each language (the smallest hashes of
the id below a threshold set by the exact count of documents), ``pieces`` windows of each: a
documented bound on a training sample; predictions read every byte.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A null id counts as
held out: nothing is learnt from it. Null languages are never learnt from. Without labelled documents
everything is ``und``. Repeated rows give repeated results; extra columns are ignored, whatever their
names. Languages with equal probabilities: the first in their order. A text of any length is cut whole,
its windows held in memory at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import map_batches, table

WINDOW = 256
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class ByteCnn:
    languages: list[str]
    widths: tuple[int, ...]
    filters: list[np.ndarray]  # for each width: (width, 256, n)
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def features(self, windows: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes to pooled filter outputs. A step's arrays fit a processor's cache: 32 windows at a time. Look-ups take two bytes at once where the width allows."""
        if not hasattr(self, "_pairs"):
            self._pairs = [[(t[j][:, None] + t[j + 1][None]).reshape(65536, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in (x.astype(np.float32) for x in self.filters)]
        out = np.empty((len(windows), sum(len(b) for b in self.biases)), np.float32)
        for k in range(0, len(windows), 32):
            one = windows[k : k + 32].astype(np.int32)
            two = one[:, :-1] * 256 + one[:, 1:]
            col = 0
            for width, tables, bias in zip(self.widths, self._pairs, self.biases, strict=True):
                n = WINDOW - width + 1
                acc = None
                for j, t in zip(range(0, width, 2), tables, strict=True):
                    part = np.take(t, (two if j + 1 < width else one)[:, j : j + n], axis=0)
                    acc = part if acc is None else np.add(acc, part, out=acc)
                while n > 1:  # halves: long runs of numbers for each call
                    half = (n + 1) // 2
                    np.maximum(acc[:, : n - half], acc[:, half:n], out=acc[:, : n - half])
                    n = half
                out[k : k + 32, col : col + len(bias)] = np.maximum(acc[:, 0] + bias, 0)
                col += len(bias)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.features(windows) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole text, and the bytes that each holds."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    windows = np.full(n * WINDOW, 32, np.uint8)
    windows[: len(raw)] = raw
    held = np.full(n, WINDOW, np.float32)
    held[-1] = len(raw) - (n - 1) * WINDOW
    return windows.reshape(n, WINDOW), held


def train(texts: list[str], labels: list[str], widths: tuple[int, ...] = (2, 3, 4), n_filters: int = 16, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 7) -> ByteCnn:
    """Adam on the cross entropy of single windows; every eighth window is shortened, so that short texts are met too."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    of = {x: i for i, x in enumerate(languages)}
    x, y = [], []
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        for w in cut(text)[0]:
            if k % 8 == 0:
                w = w.copy()
                w[int(rng.integers(12, WINDOW)) :] = 32
            x.append(w)
            y.append(of[label])
    x, y = np.array(x), np.array(y)
    net = ByteCnn(languages, widths, [rng.normal(0, 0.3, (w, 256, n_filters)).astype(np.float32) for w in widths], [np.zeros(n_filters, np.float32) for _ in widths], rng.normal(0, 0.2, (n_filters * len(widths), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.filters, *net.biases, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows, want = x[order[k : k + batch]].astype(np.int64), y[order[k : k + batch]]
            b = len(rows)
            pooled, at = [], []
            for width, t, bias in zip(widths, net.filters, net.biases, strict=True):
                n = WINDOW - width + 1
                acc = sum(t[j][rows[:, j : j + n]] for j in range(width))
                top = acc.argmax(1)
                at.append(top)
                pooled.append(np.take_along_axis(acc, top[:, None], 1)[:, 0] + bias)
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            p = softmax(hidden @ net.weights + net.offset)
            p[np.arange(b), want] -= 1
            p /= b
            back = (p @ net.weights.T) * (raw > 0)
            grads_t, grads_b = [], []
            for i, (width, t) in enumerate(zip(widths, net.filters, strict=True)):
                g, part = np.zeros_like(t), back[:, i * n_filters : (i + 1) * n_filters]
                who, which = np.nonzero(part)
                for j in range(width):
                    np.add.at(g[j], (rows[who, at[i][who, which] + j], which), part[who, which])
                grads_t.append(g)
                grads_b.append(part.sum(0))
            step += 1
            for q, g, m, v in zip(params, [*grads_t, *grads_b, hidden.T @ p, p.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str) -> "F.Column":
    """Documents whose crc32 of the id's text leaves no rest by 5, and those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, pieces: int) -> tuple[list[str], list[str]]:
    """Pieces of ``WINDOW`` characters, spread evenly over each sampled text, and their languages."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    # a hash below the language's share of its range: about per_language documents of each
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, per_language / n))])
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    size = F.length("text")
    cut_at = [F.substring("text", (1 + F.floor((size - WINDOW) * (j / max(1, pieces - 1)))).cast("int"), F.lit(WINDOW)) for j in range(pieces)]
    cuts = F.when(size <= WINDOW, F.array("text")).otherwise(F.array(*cut_at))
    rows = labelled.where(part < share[F.col("lang")]).select("id", "lang", cuts.alias("cuts")).orderBy(F.xxhash64("id"), "id").limit(2 * per_language * len(counts)).collect()
    pairs = [(c, r.lang) for r in rows for c in r.cuts]
    return [c for c, _ in pairs], [lang for _, lang in pairs]


def predict(docs: DataFrame, net: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if net else []
        k = 0
        while k < len(known):
            group, n = [], 0  # documents of together about 4096 windows
            while k < len(known) and n < 4096:
                group.append((known[k], *cut(texts[known[k]])))
                n += len(group[-1][2])
                k += 1
            p = net.probabilities(np.concatenate([w for _, w, _ in group])) * np.concatenate([h for _, _, h in group])[:, None]
            starts = np.cumsum([0, *(len(h) for _, _, h in group[:-1])])
            mean = np.add.reduceat(p, starts) / np.array([h.sum() for _, _, h in group])[:, None]
            for (i, _, _), row in zip(group, mean, strict=True):
                best = int(row.argmax())
                langs[i], scores[i] = net.languages[best], min(1.0, float(row[best]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("_held_out"))
    return map_batches(rows, each, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, pieces: int = 4) -> DataFrame:
    texts, labels = training_sample(docs, id_col, text_col, lang_col, per_language, pieces)
    return predict(docs, train(texts, labels) if texts else None, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
