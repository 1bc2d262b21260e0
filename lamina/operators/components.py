"""Components: contours of a slice (4-connected), bodies (6-connected) and skeleton parts (26-connected)."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.graph import connected_components
from lamina.operators.numbering import ordered_ids
from lamina.session import Workspace


#: Voxels of a stretch of a line that runs meet in.
X_BUCKET = 64
#: Bits of a contour's node id for its label, slice and number.
LABEL_BITS, Z_BITS, CC_BITS = 13, 22, 28


def node_id(z: F.Column, cc_id: str = "cc_id") -> F.Column:
    """A contour as one number, in order of label, slice and contour; an error where one doesn't fit its bits."""
    label, z, cc = (c.cast("long") for c in (F.col("label_id"), z, F.col(cc_id)))
    fits = label.between(0, (1 << LABEL_BITS) - 1) & z.between(0, (1 << Z_BITS) - 1) & cc.between(0, (1 << CC_BITS) - 1)
    packed = label * (1 << (Z_BITS + CC_BITS)) + z * (1 << CC_BITS) + cc
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a label, slice or contour number is too large for a node id")).cast("long"))


def runs(mask: DataFrame) -> DataFrame:
    """Voxels of (label_id, z, y) as runs (x_lo, x_hi): rows fall from the area to the outline."""
    line = Window.partitionBy("label_id", "z", "y").orderBy("x")
    starts = mask.withColumn("_run", F.col("x") - F.row_number().over(line))
    return starts.groupBy("label_id", "z", "y", "_run").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi")).drop("_run")


#: Lines of a band of a slice that one task labels.
BAND_LINES = 1024


def run_roots(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first run of each run's component, for runs in raster order: neighbouring lines' runs that share an x are tied.

    The pairs are found by search in the next line's runs, and the least member spreads by pointer jumping.
    """
    line = np.int64(hi.max() - lo.min() + 2) if len(y) else np.int64(1)
    base = lo.min() if len(y) else 0
    start, end = (y - (y[0] if len(y) else 0)).astype(np.int64) * line + (lo - base), (y - (y[0] if len(y) else 0)).astype(np.int64) * line + (hi - base)
    first, last = np.searchsorted(end, start + line), np.searchsorted(start, end + line, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    root = np.arange(len(y))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _label_band(band: pa.Table) -> pa.Table:
    """Runs of one band of a slice with ``root``, the place y, x of the first voxel of their component within the band."""
    t = band.sort_by([("y", "ascending"), ("x_lo", "ascending")])
    y, lo, hi = (t.column(c).to_numpy() for c in ("y", "x_lo", "x_hi"))
    root = run_roots(y, lo, hi)
    return t.append_column("root", pa.array((y[root].astype(np.int64) << 32) + lo[root]))


def _label_slice(whole: pa.Table) -> pa.Table:
    """cc_id of the runs of a slice that is one band."""
    t = whole.sort_by([("y", "ascending"), ("x_lo", "ascending")])
    _, number = np.unique(run_roots(*(t.column(c).to_numpy() for c in ("y", "x_lo", "x_hi"))), return_inverse=True)
    return t.append_column("cc_id", pa.array((number + 1).astype(np.int32)))


def contour_runs(mask: DataFrame, work: Workspace, lines: int | None = None, band_lines: int = BAND_LINES) -> DataFrame:
    """Runs with cc_id, counted from 1 in order of each contour's first voxel, by label and slice.

    A slice is labelled in bands of lines, each in a task of its own. Components of two bands are tied where
    runs of the lines at their border share an x, and these ties, few beside the runs, go through connected
    components. A contour's first voxel is the least of its bands' first ones, so ids don't depend on the bands.
    lines: of a slice, where they are known; if they fit into a band, nothing needs to be tied.
    """
    if lines is not None and lines <= band_lines:
        return runs(mask).groupBy("label_id", "z").applyInArrow(_label_slice, "label_id int, z int, y int, x_lo int, x_hi int, cc_id int")
    schema = "label_id int, z int, band int, y int, x_lo int, x_hi int, root long"
    banded = runs(mask).withColumn("band", F.expr(f"cast(y div {band_lines} as int)")).groupBy("label_id", "z", "band").applyInArrow(lambda t: _label_band(t.select(["label_id", "z", "band", "y", "x_lo", "x_hi"])), schema)
    banded = work.keep(banded, f"bands{uuid.uuid4().hex[:8]}")
    slice_key = ["label_id", "z"]
    if not banded.where("band > 0").isEmpty():
        stretches = F.explode(F.expr(f"sequence(x_lo div {X_BUCKET}, x_hi div {X_BUCKET})")).alias("xb")
        above = banded.where(f"y % {band_lines} = {band_lines - 1}").select(*slice_key, (F.col("y") + 1).alias("y"), "x_lo", "x_hi", F.col("root").alias("a_root"), stretches)
        below = banded.where(f"y % {band_lines} = 0 and y > 0").select(*slice_key, "y", F.col("x_lo").alias("b_lo"), F.col("x_hi").alias("b_hi"), F.col("root").alias("b_root"), stretches)
        ties = work.keep(above.join(below, [*slice_key, "y", "xb"]).where("x_lo <= b_hi and b_lo <= x_hi").select(*slice_key, "a_root", "b_root").distinct(), f"ties{uuid.uuid4().hex[:8]}")
        # nodes are numbered in order of label, slice and place, so that the least number of a component has its first voxel
        ends = ties.select(*slice_key, F.col("a_root").alias("root")).unionByName(ties.select(*slice_key, F.col("b_root").alias("root"))).distinct()
        numbered = work.keep(ordered_ids(ends, [*slice_key, "root"], "node", work), f"ends{uuid.uuid4().hex[:8]}")
        number = lambda c: numbered.select(*slice_key, F.col("root").alias(f"{c}_root"), F.col("node").alias(c))
        edges = ties.join(number("a"), [*slice_key, "a_root"]).join(number("b"), [*slice_key, "b_root"]).select("a", "b")
        groups = connected_components(edges, work, f"borders{uuid.uuid4().hex[:8]}")
        whole = numbered.join(groups, "node").join(numbered.select(F.col("node").alias("component"), F.col("root").alias("whole")), "component").select(*slice_key, "root", "whole")
        banded = banded.join(whole, [*slice_key, "root"], "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    firsts = banded.select(*slice_key, "root").distinct()
    ids = firsts.withColumn("cc_id", F.row_number().over(Window.partitionBy(*slice_key).orderBy("root")))
    return banded.join(ids, [*slice_key, "root"]).select("label_id", "z", "y", "x_lo", "x_hi", "cc_id")


def contour_voxels(labelled: DataFrame) -> DataFrame:
    return labelled.select("label_id", "z", "cc_id", "y", F.explode(F.sequence("x_lo", "x_hi")).alias("x"))


def overlaps(labelled: DataFrame) -> DataFrame:
    """Shared voxels of contours in neighbouring slices, both ways, for equal and other labels.

    Runs meet in an equi-join on slice, line and stretch of X_BUCKET voxels, and count where both
    have begun; the forward half is joined once and mirrored.
    """
    stretches = F.explode(F.expr(f"sequence(x_lo div {X_BUCKET}, x_hi div {X_BUCKET})")).alias("xb")
    a = labelled.select((F.col("z") + 1).alias("z_next"), "y", "label_id", "z", "cc_id", "x_lo", "x_hi", stretches)
    b = labelled.select(F.col("z").alias("z_next"), "y", F.col("label_id").alias("o_label_id"), F.col("cc_id").alias("o_cc_id"), F.col("x_lo").alias("o_lo"), F.col("x_hi").alias("o_hi"), stretches)
    shared = a.join(b, ["z_next", "y", "xb"]).where(f"x_lo <= o_hi and o_lo <= x_hi and xb = greatest(x_lo, o_lo) div {X_BUCKET}")
    up = shared.groupBy("label_id", "z", "cc_id", "o_label_id", "o_cc_id").agg(F.expr("sum(cast(least(x_hi, o_hi) - greatest(x_lo, o_lo) + 1 as bigint))").alias("area")).withColumn("dir", F.lit(1))
    down = up.select(F.col("o_label_id").alias("label_id"), (F.col("z") + 1).alias("z"), F.col("o_cc_id").alias("cc_id"), F.col("label_id").alias("o_label_id"), F.col("cc_id").alias("o_cc_id"), "area", F.lit(-1).alias("dir"))
    return up.unionByName(down)


def bodies(labelled: DataFrame, work: Workspace) -> DataFrame:
    """(label_id, z, cc_id, comp_id): 6-connected bodies as components of contours and their same-label overlaps.

    comp_id counts from 1 by label, in order of each body's first voxel.
    """
    nodes = labelled.select("label_id", "z", "cc_id").distinct().withColumn("node", node_id(F.col("z")))
    same = overlaps(labelled).where("dir = 1 and label_id = o_label_id")
    edges = same.select(node_id(F.col("z")).alias("a"), node_id(F.col("z") + 1, "o_cc_id").alias("b"))
    groups = connected_components(edges, work, "bodies")
    tied = work.keep(nodes.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component", "node"), "tied")
    numbered = work.keep(ordered_ids(tied.select("label_id", "root").distinct(), ["label_id", "root"], "number", work), "numbered")
    least = numbered.groupBy("label_id").agg(F.min("number").alias("least"))
    ids = numbered.join(least, "label_id").select("root", (F.col("number") - F.col("least") + 1).cast("int").alias("comp_id"))
    return tied.join(ids, "root").select("label_id", "z", "cc_id", "comp_id")


NEIGHBOURS = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) != (0, 0, 0)]


def adjacency(points: DataFrame) -> DataFrame:
    """(a, b, ord, dz, dy, dx) of 26-neighbours, ord in order of the offset; an equi-join on shifted places."""
    offsets = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dz, dy, dx) in enumerate(NEIGHBOURS)))
    shifted = points.select(F.col("point_id").alias("a"), "z", "y", "x", F.explode(offsets).alias("o")).selectExpr("a", "z + o.dz as z", "y + o.dy as y", "x + o.dx as x", "o.*")
    return shifted.join(points.select(F.col("point_id").alias("b"), "z", "y", "x"), ["z", "y", "x"]).select("a", "b", "ord", "dz", "dy", "dx")


def skeleton_points(skeleton: DataFrame, mask: DataFrame, work: Workspace) -> DataFrame:
    """(point_id, z, y, x, label_id): raster order; of overlapping masks the first label wins, 0 outside."""
    labelled = skeleton.join(mask, ["z", "y", "x"], "left").groupBy("z", "y", "x").agg(F.coalesce(F.min("label_id"), F.lit(0)).alias("label_id"))
    return work.keep(ordered_ids(labelled, ["z", "y", "x"], "point_id", work).select("point_id", "z", "y", "x", "label_id"), "points")


def spatial_components(points: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """(point_id, root): the least point of each 26-connected part."""
    groups = connected_components(edges.select("a", "b").where("a < b"), work, "spatial")
    return points.join(groups.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", "label_id", F.coalesce("component", "point_id").alias("root"))


def instances(points: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """(point_id, label_id, instance_id): parts of one label; -1 where there is no label."""
    la, lb = (points.select(F.col("point_id").alias(c), F.col("label_id").alias(f"l{c}")) for c in "ab")
    same = edges.where("a < b").join(la, "a").join(lb, "b").where("la = lb and la > 0").select("a", "b")
    groups = connected_components(same, work, "instances")
    tied = points.where("label_id > 0").join(groups.withColumnRenamed("node", "point_id"), "point_id", "left").withColumn("root", F.coalesce("component", "point_id"))
    numbered = ordered_ids(tied.select("label_id", "root").distinct(), ["label_id", "root"], "instance_id", work)
    return points.join(tied.join(numbered.select("root", "instance_id"), "root").select("point_id", "instance_id"), "point_id", "left").select("point_id", "label_id", F.coalesce("instance_id", F.lit(-1)).alias("instance_id"))
