"""Voxel geometry: dilation and boundary faces, over runs of voxels rather than voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import by_shuffle

FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


def line_runs(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, y, x_lo, x_hi): distinct voxels of each line as runs."""
    line = Window.partitionBy(*keys, "z", "y").orderBy("x")
    starts = voxels.select(*keys, "z", "y", "x").distinct().withColumn("_run", F.col("x") - F.row_number().over(line))
    return starts.groupBy(*keys, "z", "y", "_run").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi")).drop("_run")


def dilate(voxels: DataFrame, radius: int, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """Binary dilation with a ball, cut off at the shape, apart for each combination of keys.

    A run becomes a longer run on each line that the ball reaches, 29 for a radius of 3 whatever its
    length; the runs of a line are merged, so that only the result is made voxel by voxel.
    """
    reach = range(-radius, radius + 1)
    lines = [(a, b, max(c for c in reach if a * a + b * b + c * c <= radius * radius)) for a in reach for b in reach if a * a + b * b <= radius * radius]
    steps = F.array(*(F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("w")) for a, b, c in lines))
    grown = line_runs(voxels, keys).withColumn("_o", F.explode(steps)).select(*keys, (F.col("z") + F.col("_o.dz")).alias("z"), (F.col("y") + F.col("_o.dy")).alias("y"), F.greatest(F.lit(0), F.col("x_lo") - F.col("_o.w")).alias("lo"), F.least(F.lit(shape[2] - 1), F.col("x_hi") + F.col("_o.w")).alias("hi"))
    inside = grown.where((F.col("z") >= 0) & (F.col("y") >= 0) & (F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("lo") <= F.col("hi"))).distinct()
    line = Window.partitionBy(*keys, "z", "y").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") > F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    island = inside.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "z", "y", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select(*keys, "z", "y", F.explode(F.sequence("lo", "hi")).alias("x"))


def boundary_faces(voxels: DataFrame, keys: list[str], directions: tuple = FACES) -> DataFrame:
    """(keys, z, y, x, face): voxel faces without a neighbour of the same keys behind them; face is the place in directions.

    Faces along a line are the ends of its runs. Across lines a run meets the runs of the next line, which come as
    one list for each line, and what they leave uncovered are the faces; voxels inside make no row.
    """
    runs = line_runs(voxels, keys)
    ends = [(i, d) for i, d in enumerate(directions) if d[2]]
    across = [(i, d) for i, d in enumerate(directions) if not d[2]]
    out = None
    if ends:
        sides = F.array(*(F.struct(F.lit(i).alias("face"), (F.col("x_lo") if d[2] < 0 else F.col("x_hi")).alias("x")) for i, d in ends))
        out = runs.select(*keys, "z", "y", F.explode(sides).alias("s")).select(*keys, "z", "y", "s.x", "s.face")
    if across:
        sides = F.array(*(F.struct(F.lit(i).alias("face"), F.lit(d[0]).alias("dz"), F.lit(d[1]).alias("dy")) for i, d in across))
        shown = runs.withColumn("_s", F.explode(sides)).select(*keys, "z", "y", "x_lo", "x_hi", "_s.face", (F.col("z") + F.col("_s.dz")).alias("nz"), (F.col("y") + F.col("_s.dy")).alias("ny"))
        lists = runs.groupBy(*keys, F.col("z").alias("nz"), F.col("y").alias("ny")).agg(F.array_sort(F.collect_list(F.struct(F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi")))).alias("there"))  # of one line
        met = shown.join(by_shuffle(lists), [*keys, "nz", "ny"], "left").withColumn("there", F.expr("filter(there, o -> o.hi >= x_lo and o.lo <= x_hi)"))
        # what lies before the first, between, and after the last of the runs there
        starts = F.concat(F.array("x_lo"), F.transform("there", lambda o: o["hi"] + 1))
        stops = F.concat(F.transform("there", lambda o: o["lo"] - 1), F.array("x_hi"))
        gaps = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] <= g["b"])
        whole = F.array(F.struct(F.col("x_lo").alias("a"), F.col("x_hi").alias("b")))
        gaps = F.when(F.col("there").isNull(), whole).otherwise(gaps)
        faces = met.select(*keys, "z", "y", "face", F.explode(gaps).alias("g")).select(*keys, "z", "y", F.explode(F.sequence(F.col("g.a"), F.col("g.b"))).alias("x"), "face")
        out = faces if out is None else out.unionByName(faces)
    return out
