"""Closed surfaces and outlines of voxel sets.

A surface net: each boundary face between a voxel inside and one outside becomes one
quadrilateral, whose corners lie in the four cells (of eight voxels each) around it. A cell's
vertex is the mean of the faces' middles that it touches. So a mesh is two tables, made by
grouping and joining; every edge belongs to two or four quadrilaterals, that is no hole is left.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.geometry import FACES, boundary_faces

#: Corners of a face's quadrilateral, as cells relative to the lower voxel's own, by the face's axis.
CORNERS = {0: ((0, -1, -1), (0, -1, 0), (0, 0, 0), (0, 0, -1)), 1: ((-1, 0, -1), (-1, 0, 0), (0, 0, 0), (0, 0, -1)), 2: ((-1, -1, 0), (-1, 0, 0), (0, 0, 0), (0, -1, 0))}


def quads(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, axis, up, z, y, x, corner, cz, cy, cx): the four corner cells of each boundary face, of which (z, y, x) is the lower voxel."""
    faces = boundary_faces(voxels, keys)
    steps = F.array(*(F.struct(*(F.lit(min(0, d)).alias(a) for d, a in zip(face, ("dz", "dy", "dx")))) for face in FACES))
    axis = F.expr("cast(face div 2 as int)")
    low = faces.withColumn("_s", F.element_at(steps, F.col("face") + 1)).select(*keys, axis.alias("axis"), (F.col("face") % 2 == 1).alias("up"), *((F.col(c) + F.col(f"_s.d{c}")).alias(c) for c in "zyx"))
    corners = F.array(*(F.array(*(F.struct(*(F.lit(o).alias(f"o{a}") for o, a in zip(corner, "zyx"))) for corner in CORNERS[i])) for i in range(3)))
    spread = low.select("*", F.posexplode(F.element_at(corners, F.col("axis") + 1)).alias("corner", "_o"))
    return spread.select(*keys, "axis", "up", "z", "y", "x", "corner", *((F.col(c) + F.col(f"_o.o{c}")).alias(f"c{c}") for c in "zyx"))


def vertices(corners: DataFrame, keys: list[str], voxel: tuple[float, float, float]) -> DataFrame:
    """(keys, cz, cy, cx, vx, vy, vz, n_faces): a mesh's vertices in micrometres, x first."""
    middle = lambda c, i: F.avg((F.col(c) + F.when(F.col("axis") == i, 0.5).otherwise(0.0)) * voxel[i])
    return corners.groupBy(*keys, "cz", "cy", "cx").agg(middle("x", 2).alias("vx"), middle("y", 1).alias("vy"), middle("z", 0).alias("vz"), F.count(F.lit(1)).alias("n_faces"))


def mesh_table(voxels: DataFrame, keys: list[str], voxel: tuple[float, float, float]) -> DataFrame:
    """(keys, n_points, n_cells, open_edges): sizes of the closed triangle mesh of each voxel set, a quadrilateral being two triangles."""
    corners = quads(voxels, keys)
    points = corners.select(*keys, "cz", "cy", "cx").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    cells = corners.where("corner = 0").groupBy(*keys).agg((2 * F.count(F.lit(1))).alias("n_cells"))
    ring = F.array(*(F.struct(F.lit(i).alias("i"), F.lit((i + 1) % 4).alias("j")) for i in range(4)))
    face = [*keys, "axis", "z", "y", "x", "up"]
    at = corners.groupBy(*face).agg(F.map_from_entries(F.collect_list(F.struct("corner", F.struct("cz", "cy", "cx").alias("c")))).alias("m"))  # four corners
    edges = at.select(*keys, "m", F.explode(ring).alias("e")).select(*keys, F.element_at("m", F.col("e.i")).alias("p"), F.element_at("m", F.col("e.j")).alias("q"))
    odd = edges.groupBy(*keys, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).count().groupBy(*keys).agg(F.sum((F.col("count") % 2 != 0).cast("long")).alias("open_edges"))
    return points.join(cells, keys).join(odd, keys)


#: Directions of an outline's steps by face (above, below, left, right), the inside on the right: start and step in y and x.
STEPS = {0: ((0, 0), (0, 1)), 1: ((1, 1), (0, -1)), 2: ((1, 0), (-1, 0)), 3: ((0, 1), (1, 0))}


def _follow(rows: pa.Table) -> pa.Table:
    """The first closed outline of one contour, in order; at a corner that two steps leave, the one that turns right."""
    z, y, x, face = (rows.column(c).to_pylist() for c in ("z", "y", "x", "face"))
    leaving: dict = defaultdict(list)
    for py, px, f in zip(y, x, face):
        (sy, sx), step = STEPS[f]
        leaving[py + sy, px + sx].append(step)
    now = start = min(leaving)
    step, path = (0, 1), []  # the first corner in raster order is left along its upper side
    while True:
        path.append(now)
        leaving[now].remove(step)
        now = (now[0] + step[0], now[1] + step[1])
        if now == start:
            break
        step = min(leaving[now], key=lambda s: {(step[1], -step[0]): 0, step: 1, (-step[1], step[0]): 2}[s])  # noqa: B023
    n = len(path)
    keys = {c: [rows.column(c)[0].as_py()] * n for c in ("label_id", "z", "cc_id")}
    return pa.table({**{c: pa.array(v, pa.int32()) for c, v in keys.items()}, "place": pa.array(range(n), pa.int32()), "cy": pa.array([p[0] for p in path], pa.int32()), "cx": pa.array([p[1] for p in path], pa.int32())})


def outlines(voxels: DataFrame) -> DataFrame:
    """(label_id, z, cc_id, place, cy, cx): the corners of each contour's outer outline in order, from its first one.

    A task has one contour's boundary steps, which are bounded by a slice. Corner (cy, cx) is the upper left one of voxel (cy, cx).
    """
    faces = boundary_faces(voxels, ["label_id", "cc_id"], FACES[2:])
    return faces.select("label_id", "z", "cc_id", "y", "x", "face").groupBy("label_id", "z", "cc_id").applyInArrow(_follow, "label_id int, z int, cc_id int, place int, cy int, cx int")
