"""Paths through the slices: each contour points at the neighbour it overlaps most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import Workspace


def best_overlap(overlap: DataFrame, same_label: bool = False) -> DataFrame:
    """The neighbour of largest shared area in each direction; on ties the same label, then label and contour order."""
    pool = overlap.where("label_id = o_label_id") if same_label else overlap
    order = [F.desc("area"), F.when(F.col("label_id") == F.col("o_label_id"), 0).otherwise(1), "o_label_id", "o_cc_id"]
    return pool.withColumn("_nth", F.row_number().over(Window.partitionBy("label_id", "z", "cc_id", "dir").orderBy(*order))).where("_nth = 1").drop("_nth")


def chain_lengths(best: DataFrame, direction: int, work: Workspace) -> DataFrame:
    """(label_id, z, cc_id, steps): how far every contour's path goes in one direction.

    Pointer doubling: after n rounds a pointer spans 2^n slices, so the rounds grow with the
    logarithm of the volume's depth and all starts are followed at once.
    """
    now = best.where(F.col("dir") == direction).select("label_id", "z", "cc_id", F.col("o_label_id").alias("p_label"), (F.col("z") + direction).alias("p_z"), F.col("o_cc_id").alias("p_cc"), F.lit(1).alias("steps"))
    now, turn = work.keep(now, f"chain{direction}_0"), 0
    while True:
        ahead = now.select(F.col("label_id").alias("p_label"), F.col("z").alias("p_z"), F.col("cc_id").alias("p_cc"), F.col("p_label").alias("q_label"), F.col("p_z").alias("q_z"), F.col("p_cc").alias("q_cc"), F.col("steps").alias("more"))
        if now.join(ahead, ["p_label", "p_z", "p_cc"], "left_semi").isEmpty():
            return now.select("label_id", "z", "cc_id", "steps")
        doubled = now.join(ahead, ["p_label", "p_z", "p_cc"], "left").select("label_id", "z", "cc_id", F.coalesce("q_label", "p_label").alias("p_label"), F.coalesce("q_z", "p_z").alias("p_z"), F.coalesce("q_cc", "p_cc").alias("p_cc"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        turn += 1
        now = work.keep(doubled, f"chain{direction}_{turn}")
        work.drop(f"chain{direction}_{turn - 1}")


def all_paths(contour: DataFrame, overlap: DataFrame, work: Workspace, same_label: bool = True) -> DataFrame:
    """(label_id, z, cc_id, z_lo, z_hi): the slices that the path from every contour covers."""
    best = work.keep(best_overlap(overlap, same_label), "best")
    key = ["label_id", "z", "cc_id"]
    up, down = (chain_lengths(best, d, work).withColumnRenamed("steps", name) for d, name in ((1, "up"), (-1, "down")))
    return contour.select(*key).join(up, key, "left").join(down, key, "left").select(*key, (F.col("z") - F.coalesce("down", F.lit(0))).alias("z_lo"), (F.col("z") + F.coalesce("up", F.lit(0))).alias("z_hi"))


def path_boxes(contour: DataFrame, overlap: DataFrame, work: Workspace, margin: int, ny: int, nx: int) -> DataFrame:
    """Union box of the contours on every contour's same-label path, with a margin, cut off at the slice.

    Boxes double along the pointers as lengths do: after n rounds a box covers 2^n slices.
    """
    best = work.keep(best_overlap(overlap, same_label=True), "best_box")
    key, box = ["label_id", "z", "cc_id"], ["y_min", "y_max", "x_min", "x_max"]
    widest = {"y_min": F.least, "y_max": F.greatest, "x_min": F.least, "x_max": F.greatest}
    out = contour.select(*key, *box)
    for direction in (1, -1):
        step = best.where(F.col("dir") == direction).select(*key, (F.col("z") + direction).alias("p_z"), F.col("o_cc_id").alias("p_cc"))
        now, turn = work.keep(contour.select(*key, *box).join(step, key, "left"), f"box{direction}_0"), 0
        while not now.where("p_cc is not null").isEmpty():
            ahead = now.select("label_id", F.col("z").alias("p_z"), F.col("cc_id").alias("p_cc"), F.col("p_z").alias("q_z"), F.col("p_cc").alias("q_cc"), *(F.col(b).alias(f"n_{b}") for b in box))
            turn += 1
            grown = now.join(ahead, ["label_id", "p_z", "p_cc"], "left").select(*key, *(f(b, F.coalesce(f"n_{b}", b)).alias(b) for b, f in widest.items()), F.col("q_z").alias("p_z"), F.col("q_cc").alias("p_cc"))
            now = work.keep(grown, f"box{direction}_{turn}")
            work.drop(f"box{direction}_{turn - 1}")
        out = out.unionByName(now.select(*key, *box))
    clamp = [F.greatest(F.lit(0), F.min("y_min") - margin).alias("y0"), F.least(F.lit(ny), F.max("y_max") + margin).alias("y1"), F.greatest(F.lit(0), F.min("x_min") - margin).alias("x0"), F.least(F.lit(nx), F.max("x_max") + margin).alias("x1")]
    return out.groupBy(*key).agg(*clamp)


def path_layers(starts: DataFrame, best: DataFrame, work: Workspace) -> DataFrame:
    """(s_label, s_z, s_cc, z, label_id, cc_id): every contour on the paths from the contours of starts (label_id, z, cc_id), themselves included.

    best: one neighbour for each contour and direction. Pointers of 1, 2, 4... slices are added
    to all that is reached so far, so that each contour of a path is reached once, in log2(depth) joins.
    """
    first = starts.select("label_id", "z", "cc_id").distinct().select(F.col("label_id").alias("s_label"), F.col("z").alias("s_z"), F.col("cc_id").alias("s_cc"), "z", "label_id", "cc_id")
    name, out = f"layers{uuid.uuid4().hex[:8]}_", None
    node, ahead = ["label_id", "z", "cc_id"], ["p_label", "p_z", "p_cc"]
    for direction in (1, -1):
        reached = work.keep(first, f"{name}{direction}_0")
        jump = best.where(F.col("dir") == direction).select(*node, F.col("o_label_id").alias("p_label"), (F.col("z") + direction).alias("p_z"), F.col("o_cc_id").alias("p_cc"))
        jump, turn = work.keep(jump, f"{name}jump{direction}_0"), 0
        while not jump.isEmpty():
            new = reached.join(jump, node).select("s_label", "s_z", "s_cc", F.col("p_z").alias("z"), F.col("p_label").alias("label_id"), F.col("p_cc").alias("cc_id"))
            after = jump.select(*(F.col(n).alias(a) for n, a in zip(node, ahead)), *(F.col(a).alias(f"q{a}") for a in ahead))
            doubled = jump.join(after, ahead).select(*node, *(F.col(f"q{a}").alias(a) for a in ahead))
            turn += 1
            reached = work.keep(reached.unionByName(new), f"{name}{direction}_{turn}")
            jump = work.keep(doubled, f"{name}jump{direction}_{turn}")
            work.drop(f"{name}{direction}_{turn - 1}", f"{name}jump{direction}_{turn - 1}")
        out = reached if out is None else out.unionByName(reached.where("z < s_z"))
    return work.met(out)
