"""Nearest neighbours by a grid of cells, coarsened until every query is answered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.bounds import descend
from lamina.session import Workspace

#: Cells along the longest side from which on a grid is too coarse to try, and the most levels of nested cells.
COARSE, LEVELS = 8, 12


def nearest(queries: DataFrame, points: DataFrame, size: tuple[float, float, float], work: Workspace, cell: float = 8.0) -> DataFrame:
    """(query_id, point_id, d2) for queries (query_id, wz, wy, wx) and points (point_id, z, y, x) of voxel size (z, y, x).

    A query meets the points of its cell and the 26 around it in an equi-join; what it finds
    within one cell's length is nearest. The others try again with cells twice as long, and
    at last go down nested cells over all points by bounds. Queries with a null, NaN or infinite
    coordinate get null; without points there are no rows. Of points equally near the least id counts.
    """
    name, none = f"nearest{uuid.uuid4().hex[:8]}_", ("cast(null as bigint) as point_id", "cast(null as double) as d2")
    placed = work.met(points.select("point_id", (F.col("z") * size[0]).alias("pz"), (F.col("y") * size[1]).alias("py"), (F.col("x") * size[2]).alias("px")))
    box = placed.agg(*(f(c) for c in ("pz", "py", "px") for f in (F.min, F.max))).first()
    if box[0] is None:
        return queries.selectExpr("query_id", *none).limit(0)
    usable = F.lit(True)
    for c in ("wz", "wy", "wx"):
        usable &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    side = max(box[i + 1] - box[i] for i in (0, 2, 4))
    left = queries.where(usable).select("query_id", "wz", "wy", "wx")
    answers, steps, turn = queries.where(~usable).selectExpr("query_id", *none), F.array(*(F.lit(i) for i in (-1, 0, 1))), 0
    while cell * COARSE < side and not left.isEmpty():
        grid = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        close = left
        for c, i in (("wz", 0), ("wy", 2), ("wx", 4)):
            close = close.where(F.col(c).between(box[i] - cell, box[i + 1] + cell))
        around = close.select("*", F.explode(steps).alias("a")).select("*", F.explode(steps).alias("b")).select("*", F.explode(steps).alias("c")).select("query_id", "wz", "wy", "wx", (grid("wz") + F.col("a")).alias("gz"), (grid("wy") + F.col("b")).alias("gy"), (grid("wx") + F.col("c")).alias("gx"))
        met = around.join(placed.select("*", grid("pz").alias("gz"), grid("py").alias("gy"), grid("px").alias("gx")), ["gz", "gy", "gx"])
        found = work.keep(_best(met).where(F.col("d2") <= cell * cell), f"{name}{turn}")
        answers = answers.unionByName(found)
        left = work.keep(left.join(found, "query_id", "left_anti"), f"{name}left{turn}")
        if turn:
            work.drop(f"{name}left{turn - 1}")
        cell, turn = cell * 2, turn + 1
    ends = {c: i for c, i in (("z", 0), ("y", 2), ("x", 4))}
    low, high = ({c: box[i + n] for c, i in ends.items()} for n in (0, 1))
    named = placed.select("point_id", *(F.col(f"p{c}").alias(f"w{c}") for c in "zyx"))
    asked = left.select("query_id", *(F.col(f"w{c}").alias(f"q{c}") for c in "zyx"))
    away = lambda place: F.sqrt(sum((F.pow(place[c] - F.col(f"q{c}"), 2.0) for c in "yx"), F.pow(place["z"] - F.col("qz"), 2.0)))
    met = descend(asked, "query_id", named, low, high, max(cell, side / 2**LEVELS), away, work)
    return work.met(answers.unionByName(_best(met.select("query_id", "point_id", *(F.col(f"w{c}").alias(f"p{c}") for c in "zyx"), *(F.col(f"q{c}").alias(f"w{c}") for c in "zyx")))))


def _best(met: DataFrame) -> DataFrame:
    d2 = F.pow(F.col("pz") - F.col("wz"), 2.0) + F.pow(F.col("py") - F.col("wy"), 2.0) + F.pow(F.col("px") - F.col("wx"), 2.0)
    return met.withColumn("d2", d2).groupBy("query_id").agg(F.min(F.struct("d2", "point_id")).alias("best")).select("query_id", "best.point_id", "best.d2")
