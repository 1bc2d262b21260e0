"""Skeleton points: their contours at level 0, neighbourhoods and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.components import contour_runs, contour_voxels
from lamina.operators.numbering import ordered_ids
from lamina.session import Workspace


def level0_contours(points: DataFrame, combined: DataFrame, f: int, work: Workspace, lines: int | None = None) -> DataFrame:
    """(point_id, label_id, z_l0, cc_id0): the level-0 contour of each point, -1 where its label isn't there.

    Level 0 repeats the combined labels f times along each axis, so its contours are those of
    the combined labels and no level-0 voxel is ever made. A point without a label keeps the
    first slice of its block; one whose label another has covered gets the middle slice.
    """
    contours = contour_voxels(contour_runs(combined.select("label_id", "z", "y", "x"), work, lines))
    found = points.join(contours, ["label_id", "z", "y", "x"], "left")
    missed = (F.col("label_id") > 0) & F.col("cc_id").isNull()
    return found.select("point_id", "label_id", (F.col("z") * f + F.when(missed, f // 2).otherwise(0)).alias("z_l0"), (F.coalesce("cc_id", F.lit(0)) - 1).alias("cc_id0"))


def hop_neighbourhood(starts: DataFrame, edges: DataFrame, hops: int, work: Workspace) -> DataFrame:
    """(start, point_id, hops): all points within so many hops, a frontier join for each hop."""
    reached = work.keep(starts.select(F.col("point_id").alias("start"), "point_id", F.lit(0).alias("hops")), "hops0")
    for hop in range(1, hops + 1):
        frontier = reached.where(F.col("hops") == hop - 1).join(edges.select(F.col("a").alias("point_id"), "b"), "point_id").select("start", F.col("b").alias("point_id")).distinct()
        new = frontier.join(reached, ["start", "point_id"], "left_anti").withColumn("hops", F.lit(hop))
        reached = work.keep(reached.unionByName(new), f"hops{hop}")
        work.drop(f"hops{hop - 1}")
    return reached


def sample_keypoints(points: DataFrame, edges: DataFrame, rate: int, work: Workspace) -> DataFrame:
    """(new_id, point_id, degree): ends, forks and every rate-th point, numbered anew."""
    degree = points.join(edges.groupBy(F.col("a").alias("point_id")).agg(F.count(F.lit(1)).alias("degree")), "point_id", "left").select("point_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    kept = degree.where(f"degree = 1 or degree >= 3 or point_id % {rate} = 0")
    return ordered_ids(kept, ["point_id"], "new_id", work).select("new_id", "point_id", "degree")


def sample_edges(points: DataFrame, edges: DataFrame, rate: int, work: Workspace, voxel: tuple[float, float, float] = (2.0, 1.0, 0.5)) -> DataFrame:
    """(node_a, node_b, distance_um, degree): the edges between the points that sampling keeps, by their new numbers; degree counts what is left at node_a."""
    kept = work.keep(sample_keypoints(points, edges, rate, work), "keypoints")
    length = F.sqrt(sum((F.pow(F.col(d) * v, 2.0) for d, v in zip(("dy", "dx"), voxel[1:])), F.pow(F.col("dz") * voxel[0], 2.0)))
    a, b = (kept.select(F.col("point_id").alias(c), F.col("new_id").alias(f"node_{c}")) for c in "ab")
    left = work.keep(edges.join(a, "a").join(b, "b").select("node_a", "node_b", F.round(length, 6).alias("distance_um")), "kept_edges")
    return left.join(left.groupBy("node_a").agg(F.count(F.lit(1)).alias("degree")), "node_a")
