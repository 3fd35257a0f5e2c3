"""Powerset encoding: sets of at most ``most`` of ``n`` classes as single classes."""

from __future__ import annotations

from itertools import combinations, permutations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def members(n: int, most: int) -> list[tuple[int, ...]]:
    """The sets by size, then in lexicographic order."""
    return [c for size in range(most + 1) for c in combinations(range(n), size)]


def num_classes(n: int, most: int) -> int:
    return sum(comb(n, size) for size in range(most + 1))


def table(spark: SparkSession, n: int, most: int) -> DataFrame:
    rows = [(k, list(m), [int(i in m) for i in range(n)]) for k, m in enumerate(members(n, most))]
    return spark.createDataFrame(rows, "ps_class int, members array<int>, bits array<int>")


def permutation_mapping(n: int, most: int) -> dict[tuple[int, ...], list[int]]:
    """For each permutation of the classes, where the sets go."""
    sets = members(n, most)
    at = {m: k for k, m in enumerate(sets)}
    return {p: [at[tuple(sorted(p.index(i) for i in m))] for m in sets] for p in permutations(range(n))}


def to_multilabel(scores: DataFrame, spark: SparkSession, n: int, most: int, soft: bool = False, keys: tuple[str, ...] = ("uri", "frame")) -> DataFrame:
    """(keys, ps_class, score as log probability) to (keys, k, score): the members of the best class (ties: the first), or the sums of the probabilities."""
    sets = F.broadcast(table(spark, n, most))  # fixed size: the number of sets
    if soft:
        rows = scores.join(sets, "ps_class").select(*keys, F.posexplode("bits").alias("k", "b"), "score")
        return rows.groupBy(*keys, "k").agg(F.sum(F.col("b") * F.exp("score")).alias("score"))
    best = scores.groupBy(*keys).agg(F.max_by("ps_class", F.struct("score", (-F.col("ps_class")).alias("p"))).alias("ps_class"))
    return best.join(sets, "ps_class").select(*keys, F.posexplode("bits").alias("k", "score"))


def to_powerset(labels: DataFrame, spark: SparkSession, n: int, most: int, keys: tuple[str, ...] = ("uri", "frame")) -> DataFrame:
    """(keys, k, score 0 or 1) to (keys, ps_class): the set with the most of the active classes; ties: the first, so the smallest."""
    sets = F.broadcast(table(spark, n, most).select("ps_class", F.explode_outer("members").alias("k")).where("k is not null"))
    hits = labels.where("score > 0").join(sets, "k").groupBy(*keys, "ps_class").agg(F.sum("score").alias("s"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("s"), "ps_class"))
    best = hits.withColumn("r", rank).where("r = 1").select(*keys, "ps_class")
    return labels.select(*keys).distinct().join(best, list(keys), "left").select(*keys, F.coalesce("ps_class", F.lit(0)).alias("ps_class"))
