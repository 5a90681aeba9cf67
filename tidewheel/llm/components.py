"""Connected components of a graph too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of `edges` (a, b: long).

    Alternating large-star and small-star steps. Each step takes the smallest
    neighbour of every node (pre-aggregated before the shuffle) and joins it back
    to the edges; both sides of that join are written tables, so that a node with
    very many edges is a skewed join partition, which adaptive execution splits.
    A loop or a repeated edge changes nothing; no edges give no nodes. The rounds end
    when the edges are stars: each node has one edge, and its end has none of its own.
    """
    stars = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(stars):
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both, scratch, "large", F.col("v") > F.col("u"))
        small = _star(large, large, scratch, "small", None)
        scratch.drop(stars, large)
        stars = small
    else:
        raise RuntimeError("components did not settle")
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(stars: DataFrame) -> bool:
    ends = stars.select(F.col("v").alias("end")).distinct()
    each = stars.groupBy("u").agg(F.count("*").alias("n"))
    return each.join(ends, F.col("u") == F.col("end"), "left").where("n > 1 or end is not null").isEmpty()


def _star(edges: DataFrame, rows: DataFrame, scratch: Scratch, name: str, keep) -> DataFrame:
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), name + "-least")
    linked = rows.join(least, rows.u == least.w)
    if keep is not None:
        out = linked.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    kept = scratch.keep(out.where("u <> v").distinct(), name)
    scratch.drop(least)
    return kept
