"""One-to-one assignment. Cost matrices are built with joins and aggregates; only the assignment of
one group's small matrix (classes by classes) is solved in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators.intervals import clipped, interval_join
from turnweave.runtime import ship_package


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost: shortest augmenting paths with potentials."""
    a = np.asarray(cost, float)
    if a.size == 0:
        return []
    if a.shape[0] > a.shape[1]:
        return sorted((r, c) for c, r in solve(a.T))
    n, m = a.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = a[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def solve_many(cost: np.ndarray) -> np.ndarray:
    """``solve`` for many matrices of one shape (k, n, m), n <= m, side by side: the column of each row, (k, n)."""
    a = np.asarray(cost, float)
    k, n, m = a.shape
    every = np.arange(k)
    u, v = np.zeros((k, n + 1)), np.zeros((k, m + 1))
    match = np.zeros((k, m + 1), int)
    for i in range(1, n + 1):
        match[:, 0] = i
        least, way, used = np.full((k, m + 1), np.inf), np.zeros((k, m + 1), int), np.zeros((k, m + 1), bool)
        j0, on = np.zeros(k, int), every  # ``on``: matrices whose path has not reached a free column
        while len(on):
            at = j0[on]
            used[on, at] = True
            row = match[on, at]
            free = ~used[on, 1:]
            reduced = a[on, row - 1] - u[on, row][:, None] - v[on, 1:]
            better = free & (reduced < least[on, 1:])
            least[on, 1:] = np.where(better, reduced, least[on, 1:])
            way[on, 1:] = np.where(better, at[:, None], way[on, 1:])
            reach = np.where(free, least[on, 1:], np.inf)
            j1 = reach.argmin(1) + 1
            delta = reach[np.arange(len(on)), j1 - 1][:, None]
            taken = used[on]
            g, j = np.nonzero(taken)
            u[on[g], match[on[g], j]] += delta[g, 0]
            v[on] -= np.where(taken, delta, 0.0)
            least[on] -= np.where(taken, 0.0, delta)
            j0[on] = j1
            on = on[match[on, j1] != 0]
        on = every
        while len(on):
            match[on, j0[on]] = match[on, way[on, j0[on]]]
            j0[on] = way[on, j0[on]]
            on = on[j0[on] != 0]
    out = np.full((k, n), -1)
    g, j = np.nonzero(match[:, 1:])
    out[g, match[g, j + 1] - 1] = j
    return out


def solve_greedy(gain: np.ndarray) -> list[tuple[int, int]]:
    """Again and again the largest positive gain among what is left; ties: the first row, then column."""
    g, out = np.array(gain, float), []
    while g.size and g.max() > 0:
        r, c = np.unravel_index(int(g.argmax()), g.shape)
        out.append((int(r), int(c)))
        g[r, :] = g[:, c] = -1
    return sorted(out)


def permute(y1: np.ndarray, y2: np.ndarray, cost: str | Callable[[np.ndarray, np.ndarray], float] = "mse") -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(frames, classes) arrays: y2's columns brought into y1's order, which column stands for each of y1's (None: none), and the costs. More columns in y2 than in y1: the best of them. The cost of two columns is ``mse``, ``mae`` or a function of both."""
    if len(y1) != len(y2):
        raise ValueError("different numbers of frames")
    if callable(cost):
        costs = np.array([[cost(a, b) for b in y2.T] for a in y1.T])
    else:
        diff = y1[:, :, None] - y2[:, None, :]
        costs = (diff**2 if cost == "mse" else np.abs(diff)).mean(0)
    order: list[int | None] = [None] * y1.shape[1]
    for r, c in solve(costs):
        order[r] = c
    out = np.stack([y2[:, c] if c is not None else np.zeros(len(y2)) for c in order], 1)
    return out, order, costs


def co_occurrence(reference: DataFrame, hypothesis: DataFrame, bucket: float) -> DataFrame:
    """uri, label, r_label, together: for how long each pair of labels holds at once."""
    both = clipped(interval_join(reference.select("uri", "label", "start", "end"), hypothesis.select("uri", "label", "start", "end"), ["uri"], bucket))
    return both.groupBy("uri", "label", "r_label").agg(F.sum(F.col("end") - F.col("start")).alias("together"))


#: Matrices that are solved side by side.
MANY = 4096


def _mapping(together: DataFrame, greedy: bool) -> DataFrame:
    """A uri's matrix is one row with its labels and gains, so that a task takes its files in batches."""
    ship_package(together.sparkSession)
    cell = F.struct("label", "r_label", F.col("together").cast("double").alias("together"))
    files = together.where("label is not null and r_label is not null").groupBy("uri").agg(F.collect_list(cell).alias("m"))
    names = [F.array_sort(F.array_distinct(f"m.{c}")).alias(f"{c}s") for c in ("label", "r_label")]
    place = lambda c: F.transform(f"m.{c}", lambda x: F.array_position(f"{c}s", x).cast("int") - 1).alias(c)
    files = files.select("uri", *names, "m").select("uri", "labels", "r_labels", place("label"), place("r_label"), F.col("m.together").alias("gain"))

    def solved(shape: tuple[int, int], gains: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        if greedy:
            return [solve_greedy(g) for g in gains]
        gain = np.stack(gains)
        if shape[0] <= shape[1]:
            found = [list(enumerate(x)) for x in solve_many(-gain).tolist()]
        else:
            found = [sorted((r, c) for c, r in enumerate(x)) for x in solve_many(-gain.transpose(0, 2, 1)).tolist()]
        return [[(r, c) for r, c in pairs if g[r, c] > 0] for pairs, g in zip(found, gains, strict=True)]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        uri, rows, columns, r, c, gain = (x.to_pylist() for x in batch.columns)
        by_shape: dict[tuple[int, int], list[int]] = {}
        gains = []
        for k in range(len(uri)):
            g = np.zeros((len(rows[k]), len(columns[k])))
            np.add.at(g, (r[k], c[k]), gain[k])
            gains.append(g)
            by_shape.setdefault(g.shape, []).append(k)
        pairs: list = [None] * len(uri)
        for shape, held in by_shape.items():
            for k, found in zip(held, solved(shape, [gains[k] for k in held]), strict=True):
                pairs[k] = found
        out = [(uri[k], rows[k][i], columns[k][j], float(gains[k][i, j])) for k in range(len(uri)) for i, j in pairs[k]]
        names = ["uri", "label", "r_label", "together"]
        kinds = [pa.string()] * 3 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, MANY):
                yield some(batch.slice(k, MANY))

    return files.mapInArrow(each, "uri string, label string, r_label string, together double")


def optimal_mapping(reference: DataFrame, hypothesis: DataFrame, bucket: float) -> DataFrame:
    """uri, label, r_label: the one-to-one mapping of labels with the most time together."""
    return _mapping(co_occurrence(reference, hypothesis, bucket), False)


def greedy_mapping(reference: DataFrame, hypothesis: DataFrame, bucket: float) -> DataFrame:
    return _mapping(co_occurrence(reference, hypothesis, bucket), True)


def permute_frames(target: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("uri", "chunk")) -> DataFrame:
    """keys, k, r_k: which predicted class stands for each target class, by the least mean squared error over the frames of the group."""
    ship_package(target.sparkSession)
    n = target.groupBy(*keys).agg(F.countDistinct("frame").alias("n"))
    pairs = target.select(*keys, "frame", "k", F.col("score").alias("a")).join(pred.select(*keys, "frame", F.col("k").alias("r_k"), F.col("score").alias("b")), [*keys, "frame"])
    costs = pairs.groupBy(*keys, "k", "r_k").agg(F.sum((F.col("a") - F.col("b")) ** 2).alias("c")).join(n, list(keys)).withColumn("c", F.col("c") / F.col("n")).drop("n")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="k", columns="r_k", values="c").sort_index().sort_index(axis=1)
        rows = [(*[pdf[k].iloc[0] for k in keys], m.index[r], m.columns[c]) for r, c in solve(m.to_numpy(float))]
        return pd.DataFrame(rows, columns=[*keys, "k", "r_k"])

    kinds = ", ".join(f"{k} {target.schema[k].dataType.simpleString()}" for k in keys)
    return costs.groupBy(*keys).applyInPandas(each, f"{kinds}, k {target.schema['k'].dataType.simpleString()}, r_k {pred.schema['k'].dataType.simpleString()}")


def constrained_argmax(soft: DataFrame) -> DataFrame:
    """(uri, chunk, speaker, cluster, score) to one cluster for each speaker of a chunk, none twice, with the highest total; others null."""
    ship_package(soft.sparkSession)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="speaker", columns="cluster", values="score").sort_index().sort_index(axis=1)
        x = m.to_numpy(float)
        x = np.where(np.isnan(x), np.nanmin(x) if not np.isnan(x).all() else 0.0, x)
        at = dict(solve(-x))
        rows = [(pdf["uri"].iloc[0], pdf["chunk"].iloc[0], s, m.columns[at[r]] if r in at else None) for r, s in enumerate(m.index)]
        return pd.DataFrame(rows, columns=["uri", "chunk", "speaker", "cluster"]).astype({"cluster": "Int64"})

    return soft.groupBy("uri", "chunk").applyInPandas(each, "uri string, chunk long, speaker long, cluster long")


def permutation_graph(chunks: DataFrame, frames_per_chunk: int, duration: float, step: float, onset: float = 0.5) -> DataFrame:
    """Edges (uri, chunk, k, r_chunk, r_k, cost) between classes of chunks that overlap: the optimal pairs whose members are both active. Each frame goes to the place it has in every near chunk, so that the join is on (uri, chunk, frame)."""
    reach = int(np.floor(duration / step - 1))
    shift = F.rint((F.col("r_chunk") - F.col("chunk")) * frames_per_chunk * step / duration).cast("long")
    left = chunks.select("uri", "chunk", "frame", "k", "score")
    near = chunks.select("uri", F.col("chunk").alias("r_chunk"), F.col("frame").alias("r_frame"), F.col("k").alias("r_k"), F.col("score").alias("r_score"))
    near = near.withColumn("chunk", F.explode(F.sequence(F.col("r_chunk") - reach, F.col("r_chunk") + reach))).where("chunk <> r_chunk")
    both = left.join(near.withColumn("frame", F.col("r_frame") + shift), ["uri", "chunk", "frame"])
    costs = both.groupBy("uri", "chunk", "r_chunk", "k", "r_k").agg(F.avg((F.col("score") - F.col("r_score")) ** 2).alias("c"), F.max("score").alias("x"), F.max("r_score").alias("y"))
    ship_package(chunks.sparkSession)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="k", columns="r_k", values="c").sort_index().sort_index(axis=1)
        known = pdf.set_index(["k", "r_k"])
        rows = []
        for r, c in solve(m.to_numpy(float)):
            k, o = m.index[r], m.columns[c]
            if known.loc[(k, o), "x"] > onset and known.loc[(k, o), "y"] > onset:
                rows.append((pdf["uri"].iloc[0], pdf["chunk"].iloc[0], k, pdf["r_chunk"].iloc[0], o, m.iloc[r, c]))
        return pd.DataFrame(rows, columns=["uri", "chunk", "k", "r_chunk", "r_k", "cost"])

    return costs.groupBy("uri", "chunk", "r_chunk").applyInPandas(each, "uri string, chunk long, k long, r_chunk long, r_k long, cost double")
