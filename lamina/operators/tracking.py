"""What follows a contour through the slices: crossed boundaries, tracking steps, gaps in a selection, the contour at the cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.paths import path_layers
from lamina.session import Workspace, by_shuffle

#: Voxels of a band of lines that points and contours meet in.
Y_BAND = 8


def crossed_boundary(moves: DataFrame, best: DataFrame, work: Workspace) -> DataFrame:
    """(move_id, crossed) of moves (move_id, label_id, z, cc_id, to_z) along their contour's path.

    Crossed if a layer after z, up to to_z, is missing from the path or has another label. A move
    without a contour, or to its own slice, crosses nothing.
    """
    layers = path_layers(moves.where("cc_id is not null"), best, work).select(F.col("s_label").alias("label_id"), F.col("s_z").alias("z"), F.col("s_cc").alias("cc_id"), F.col("z").alias("at"), (F.col("label_id") == F.col("s_label")).alias("same"))
    between = F.col("at").between(F.least("z", "to_z"), F.greatest("z", "to_z")) & (F.col("at") != F.col("z")) & F.col("same")
    same = moves.join(layers, ["label_id", "z", "cc_id"]).groupBy("move_id").agg(F.sum(between.cast("int")).alias("n"))
    return moves.join(same, "move_id", "left").select("move_id", (F.col("cc_id").isNotNull() & (F.coalesce("n", F.lit(0)) < F.abs(F.col("to_z") - F.col("z")))).alias("crossed"))


def tracking_steps(events: DataFrame, best: DataFrame, work: Workspace, f: int = 4) -> DataFrame:
    """(event_id, step) of events (event_id, user_id, ts, z_l0, label_id, z, cc_id): what a change of slice does to what a user tracks.

    A row with cc_id is a click that tracks that contour from slice z on; one without changes to
    the level-0 slice z_l0. The state is the slice, and label, last stood on: windows over a
    user's rows since the click before.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    click = F.col("cc_id").isNotNull()
    tracked = events.withColumn("at", F.when(click, F.col("z")).otherwise(F.expr(f"cast(z_l0 div {f} as int)"))).withColumn("clicks", F.count(F.when(click, 1)).over(own))
    for column, alias in (("label_id", "s_label"), ("z", "s_z"), ("cc_id", "s_cc")):
        tracked = tracked.withColumn(alias, F.last(F.when(click, F.col(column)), ignorenulls=True).over(own))
    layers = path_layers(events.where(click), best, work).select("s_label", "s_z", "s_cc", F.col("z").alias("at"), F.col("label_id").alias("path_label"))
    joined = tracked.join(layers, ["s_label", "s_z", "s_cc", "at"], "left")
    session = Window.partitionBy("user_id", "clicks").orderBy("ts", "event_id")
    before = joined.withColumn("at_before", F.lag("at").over(session)).withColumn("label_before", F.last("path_label", ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, -1)))
    # the layers of that label from the slice before to this one: their running number by slice would need the path again
    moves = before.where("clicks > 0 and cc_id is null and path_label = label_before and at <> at_before")
    spans = moves.select("event_id", "s_label", "s_z", "s_cc", "at_before", F.col("at").alias("to_z"), "path_label")
    inside = F.col("at").between(F.least("at_before", "to_z"), F.greatest("at_before", "to_z")) & (F.col("at") != F.col("at_before"))
    same = spans.join(layers.withColumnRenamed("path_label", "layer_label"), ["s_label", "s_z", "s_cc"]).where(inside & (F.col("layer_label") == F.col("path_label"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    step = (
        F.when(click, "tracked").when(F.col("clicks") == 0, "untracked").when(F.col("at") == F.col("at_before"), "same layer").when(F.col("path_label").isNull(), "out of path")
        .when(F.col("path_label") != F.col("label_before"), "label changed").when(F.coalesce("n", F.lit(0)) < F.abs(F.col("at") - F.col("at_before")), "instance changed").otherwise("moved")
    )
    return before.join(same, "event_id", "left").select("event_id", step.alias("step"))


def missing_slices(selection: DataFrame) -> DataFrame:
    """(selection_id, z): slices between a selection's first and last one that it has nothing in."""
    ends = selection.groupBy("selection_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return ends.select("selection_id", F.explode(F.sequence("lo", "hi")).alias("z")).join(by_shuffle(selection.select("selection_id", "z")), ["selection_id", "z"], "left_anti")


def fill_gaps(selection: DataFrame, best: DataFrame, work: Workspace) -> DataFrame:
    """(selection_id, z, label_id, cc_id) that fill the missing slices of a selection of contours.

    best: the same-label neighbours. A missing slice gets what the slice before, filled or not,
    leads to; if that is nothing, what the slice after leads back to.
    """
    gaps = missing_slices(selection)
    order = Window.partitionBy("selection_id").orderBy("z")
    runs = work.met(gaps).withColumn("run", F.col("z") - F.row_number().over(order)).groupBy("selection_id", "run").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).drop("run")
    before = selection.join(runs.withColumn("z", F.col("lo") - 1), ["selection_id", "z"]).select("selection_id", "lo", "hi", "label_id", "z", "cc_id")
    ahead = path_layers(before, best.where("dir = 1"), work).select(F.col("s_label").alias("label_id"), F.col("s_z").alias("z"), F.col("s_cc").alias("cc_id"), F.col("z").alias("at"), F.col("cc_id").alias("to_cc"))
    forward = before.join(ahead, ["label_id", "z", "cc_id"]).where("at between lo and hi").select("selection_id", F.col("at").alias("z"), "label_id", F.col("to_cc").alias("cc_id")).distinct()
    after = selection.join(runs.withColumn("z", F.col("hi") + 1), ["selection_id", "z"]).join(best.where("dir = -1"), ["label_id", "z", "cc_id"])
    back = after.select("selection_id", (F.col("z") - 1).alias("z"), "label_id", F.col("o_cc_id").alias("cc_id")).distinct().join(work.met(forward), ["selection_id", "z"], "left_anti")
    return forward.unionByName(back)


def _bands(column: str, reach: int) -> F.Column:
    return F.explode(F.expr(f"sequence(cast(floor(({column} - {reach}) / {Y_BAND}) as int), cast(floor(({column} + {reach}) / {Y_BAND}) as int))"))


def ring_search(clicks: DataFrame, voxels: DataFrame, most: int = 20) -> DataFrame:
    """(click_id, ring, y, x, cc_id): the first voxel of the click's label and slice on the square rings 1 to most around it, line by line."""
    near = clicks.select("click_id", "label_id", "z", F.col("y").alias("py"), F.col("x").alias("px"), _bands("y", most).alias("band"))
    met = near.join(voxels.withColumn("band", F.expr(f"y div {Y_BAND}")), ["label_id", "z", "band"])
    ring = F.greatest(F.abs(F.col("y") - F.col("py")), F.abs(F.col("x") - F.col("px")))
    return met.withColumn("ring", ring).where(F.col("ring").between(1, most)).groupBy("click_id").agg(F.min(F.struct("ring", "y", "x", "cc_id")).alias("best")).select("click_id", "best.*")


def level0_at_cursor(tracked: DataFrame, contours: DataFrame, f: int, shape: tuple[int, int], reach: int = 20) -> DataFrame:
    """(label_id, z, cc_id, l0_cc0): the level-0 contour under the centroid of each tracked contour (label_id, z, cc_id, centroid_y, centroid_x).

    contours: voxels of the level-0 contours on the coarse grid, whose blocks of f x f pixels
    level 0 repeats. If the centroid's pixel is on none, the nearest pixel of the label within
    reach on both axes counts, the first in raster order on ties; if there is none, -1.
    """
    key = ["label_id", "z", "cc_id"]
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n * f - 1), F.bround(F.col(c) * f, 0).cast("int")))
    cursor = tracked.select(*key, at("centroid_y", shape[0]).alias("py"), at("centroid_x", shape[1]).alias("px")).withColumn("band", _bands(f"(py div {f})", reach // f + 1))
    near = contours.select("label_id", "z", F.col("cc_id").alias("l0_cc"), "y", "x", F.expr(f"y div {Y_BAND}").alias("band"))
    pixel = lambda p, v: F.greatest(F.col(v) * f, F.least(F.col(v) * f + f - 1, F.col(p)))
    met = cursor.join(near, ["label_id", "z", "band"]).withColumns({"ny": pixel("py", "y"), "nx": pixel("px", "x")}).withColumns({"dy": F.col("ny") - F.col("py"), "dx": F.col("nx") - F.col("px")})
    best = met.where((F.abs("dy") <= reach) & (F.abs("dx") <= reach)).groupBy(*key).agg(F.min(F.struct((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("d2"), "ny", "nx", "l0_cc")).alias("best"))
    return tracked.select(*key).join(best, key, "left").select(*key, (F.coalesce("best.l0_cc", F.lit(0)) - 1).alias("l0_cc0"))
