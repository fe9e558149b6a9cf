"""Connected components of a link table, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("u", "v") % F.lit(1 << 40)).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step.

    Every node learns its least neighbour from a pre-aggregated minimum, which is joined back
    to the edges; a hub's edges are an ordinary skewed join, which adaptive execution splits.
    """
    if small:
        of = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        of = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = of.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = of.join(least, "u")
    if small:  # to the least: every smaller neighbour, and the node itself
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:  # to the least: every larger neighbour
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node that has a link to another.

    ``links`` has long columns ``u`` and ``v``; nulls and self-links are ignored, repeated and
    reversed links count once, an empty table gives an empty table. Alternates large-star and
    small-star steps until the edges are stars, which takes a number of rounds that grows with
    the logarithm of the longest path; each round is cut off by a checkpoint.
    """
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    was = _state(edges)
    for _ in range(most_rounds):
        if not was[0]:
            break
        edges = cut_lineage(_star(_star(edges, small=False), small=True))
        now = _state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
