"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import drop_materialised, materialise

#: Nodes with more neighbours than this, and than a hundred-thousandth of all links, are told to all tasks: 200,000 of them at most.
HUB = 200


def _with_least(df: DataFrame, links: int, least: DataFrame) -> DataFrame:
    """``df`` (u, v) with the least m of its u from ``least`` (u, m, k: number of neighbours). The rows of a hub meet its least where they are, so that they never come together in one task."""
    many = F.col("k") > max(HUB, links // 100_000)
    hubs = F.broadcast(least.where(many).select("u", "m"))
    rest = df.join(hubs, "u", "left_anti").join(least.where(~many).select("u", "m"), "u")
    return df.join(hubs, "u").unionByName(rest)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Large and small stars in turn: every node hands its larger neighbours to its smallest one, then
    its smaller neighbours and itself, until the links are stars; that takes about the logarithm of
    the longest path in rounds. A node's neighbours are only aggregated and joined, never gathered."""
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    n = edges.count()
    while n and not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = _with_least(both, n, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = _with_least(large, n, low).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialise(small, "edges")
        drop_materialised(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one link only, and to a node that has none to a smaller one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return not odd.limit(1).count()
