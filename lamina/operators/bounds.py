"""A search for nearest points that goes down nested cells, for many queries at once.

Points are dealt over cells, and cells over cells twice as wide, up to one that holds all. Queries go down
level by level: each meets the children of the cells it still has; a child has a least distance that its box allows and
one of its points for a distance that is surely reached, and children whose least is more than the best of the latter
go. So a query meets few cells, also one that is far from all points, and none meets all points.
The tables of the upper levels have at most 8^n cells and are broadcast below BROADCAST_CELLS; others meet by cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import Workspace

#: Cells of a level that is broadcast, at most, and what rounding may take from a bound: a part of it, and micrometres.
BROADCAST_CELLS, SLACK = 4096, (1e-9, 1e-6)
CELL = ["cz", "cy", "cx"]
Place = dict[str, Column]


def descend(queries: DataFrame, key: str, placed: DataFrame, low: dict[str, float], high: dict[str, float], leaf: float, distance: Callable[[Place], Column], work: Workspace, possible: Callable[[Place, float], Column] = lambda middle, radius: F.lit(True), counts: Callable[[Place], Column] = lambda place: F.lit(True)) -> DataFrame:
    """Queries joined with the points (point_id, wz, wy, wx) of the cells that may hold their nearest one.

    distance: of a place to the query; a sphere of some radius around a place is nearer by no more than that.
    possible: whether a sphere may hold a point that counts. counts: whether a point counts. low, high: the points' box.
    """
    name, levels = f"bounds{uuid.uuid4().hex[:8]}_", 0
    while max(high[c] - low[c] for c in "zyx") >= leaf * 2**levels:
        levels += 1
    leaves = work.keep(placed.select("point_id", "wz", "wy", "wx", *(F.floor((F.col(f"w{c}") - low[c]) / leaf).cast("long").alias(f"c{c}") for c in "zyx")), f"{name}leaves")
    cells = [leaves.groupBy(*CELL).agg(F.min(F.struct("point_id", "wz", "wy", "wx")).alias("p"))]
    for level in range(1, levels):
        cells.append(work.keep(cells[-1].groupBy(*(F.expr(f"{c} div 2").alias(c) for c in CELL)).agg(F.min("p").alias("p")), f"{name}cells{level}"))
    own = queries.columns
    now = queries.select("*", *(F.lit(0).cast("long").alias(c) for c in CELL), F.lit(float("inf")).alias("_best"))
    for level in range(levels - 1, -1, -1):
        width = leaf * 2**level
        children = cells[level].select(*(F.expr(f"{c} div 2").alias(c) for c in CELL), *(F.col(c).alias(f"n{c}") for c in CELL), "p")
        if 8 ** (levels - level) <= BROADCAST_CELLS:
            children = F.broadcast(children)
        middle, radius = {c: F.lit(low[c]) + (F.col(f"nc{c}") + 0.5) * width for c in "zyx"}, width * 3**0.5 / 2
        sample = {c: F.col(f"p.w{c}") for c in "zyx"}
        met = now.join(children, CELL).where(possible(middle, radius)).select(*own, "_best", *(F.col(f"n{c}").alias(c) for c in CELL), (distance(middle) - radius).alias("_least"), F.when(counts(sample), distance(sample)).otherwise(float("inf")).alias("_surely"))
        met = work.keep(met, f"{name}met{level}")
        best = met.groupBy(key).agg(F.least(F.min("_surely"), F.min("_best")).alias("_best"))
        now = work.keep(met.drop("_best").join(best, key).where(f"_least <= _best * {1 + SLACK[0]!r} + {SLACK[1]}").select(*own, *CELL, "_best"), f"{name}frontier{level}")
        work.drop(f"{name}met{level}", f"{name}frontier{level + 1}")
    return now.drop("_best").join(leaves, CELL).drop(*CELL)
