"""Connected components of large edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lamina.session import Workspace

MAX_ROUNDS = 100


def _stars(edges: DataFrame, work: Workspace) -> DataFrame:
    """Large star: every larger neighbour of a node is tied to the least of the neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(work.met(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_stars(edges: DataFrame, work: Workspace) -> DataFrame:
    """Small star: the node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(work.met(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is its least node.

    Alternates large and small stars (Kiveris et al., 2014) until every edge leads straight to
    its component's least node. Each round is written to the shared folder, which cuts lineage.
    No node's edges are gathered: the stars are sums by key and joins that may be split.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    before = None
    for i in range(1, MAX_ROUNDS):
        # a round that changes nothing leaves the same number of edges with the same sum of hashes, which is counted while they are written
        seen = Observation()
        made = _small_stars(_stars(now, work), work).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum"))
        now = work.keep(made, f"{name}{i}")
        work.drop(f"{name}{i - 1}")
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components aren't done after {MAX_ROUNDS} rounds")
    return work.met(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
