"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """(node, other) -> the least of the node and its neighbours, beside each pair.

    The least is an aggregate with map-side combining, so a node that touches a third of all edges costs no task more than
    its share; the join back is one that Spark can split.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return pairs.join(least, "node")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return _stars(both).filter(F.col("other") > F.col("node")).select(F.col("other").alias("u"), F.col("low").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller id."""
    pairs = _stars(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
    moved = pairs.select(F.col("other").alias("u"), F.col("low").alias("v")).unionByName(pairs.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (src, dst: long), the least node that it reaches.

    Self-loops and nulls are dropped; no edges give no rows. Each round's edges are written to the shared folder; the rounds
    grow with the logarithm of the longest chain.
    """
    now = materialize(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = materialize(_small(_large(now)), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
