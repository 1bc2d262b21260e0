"""The points nearest to view rays, for many rays at once, by bounds on nested cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.bounds import descend
from lamina.session import Workspace

#: Micrometres that a point may lie behind the origin by rounding.
SLACK = 1e-6


def _distance(place: dict[str, Column]) -> tuple[Column, Column]:
    """(distance along the ray, distance from its line) of a place."""
    off = {c: p - F.col(f"o{c}") for c, p in place.items()}
    along = sum((off[c] * F.col(f"d{c}") for c in "yx"), off["z"] * F.col("dz"))
    left = {c: off[c] - along * F.col(f"d{c}") for c in off}
    return along, F.sqrt(sum((left[c] * left[c] for c in "yx"), left["z"] * left["z"]))


def nearest_to_rays(rays: DataFrame, points: DataFrame, voxel: tuple[float, float, float], work: Workspace, leaf: float = 8.0) -> DataFrame:
    """(ray_id, point_id, dist) for rays (ray_id, oz, oy, ox, tz, ty, tx) from an origin o through a target t, in micrometres.

    A point (point_id, z, y, x) counts if it isn't behind the origin; of equal distances, to nine digits, the least id
    stands. A ray without such a point has the least id of all and no distance; one without a direction, or
    with a null or infinite number, has neither. leaf: width of the smallest cells in micrometres.
    """
    placed = points.select("point_id", *((F.col(c) * v).cast("double").alias(f"w{c}") for c, v in zip("zyx", voxel)))
    ends = placed.agg(F.min("point_id").alias("first"), *(f(f"w{c}").alias(f"{n}_{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    numbers = [F.col(f"{a}{c}") for a in "ot" for c in "zyx"]
    length = F.sqrt(sum((F.pow(F.col(f"t{c}") - F.col(f"o{c}"), 2.0) for c in "yx"), F.pow(F.col("tz") - F.col("oz"), 2.0)))
    usable = F.coalesce(length > 0, F.lit(False)) & ~F.isnan(length) & (length < float("inf"))
    for n in numbers:
        usable = usable & F.coalesce(F.abs(n) < float("inf"), F.lit(False))
    if ends["first"] is None:
        return rays.select("ray_id", F.lit(None).cast("long").alias("point_id"), F.lit(None).cast("double").alias("dist"))
    named = work.keep(rays.select("ray_id", *(F.col(f"o{c}").cast("double").alias(f"o{c}") for c in "zyx"), *((F.when(usable, (F.col(f"t{c}") - F.col(f"o{c}")) / length)).alias(f"d{c}") for c in "zyx")), "rays")
    low, high = ({c: ends[f"{n}_{c}"] for c in "zyx"} for n in ("lo", "hi"))
    along_of, off_of = (lambda place: _distance(place)[0]), (lambda place: _distance(place)[1])
    met = descend(named.where("dz is not null"), "ray_id", placed, low, high, leaf, off_of, work, lambda middle, radius: along_of(middle) + radius >= -SLACK, lambda place: along_of(place) >= 0)
    along, off = _distance({c: F.col(f"w{c}") for c in "zyx"})
    found = met.where(along >= 0).groupBy("ray_id").agg(F.min(F.struct(F.round(off, 9).alias("dist"), "point_id")).alias("m"))
    none = F.when(F.col("dz").isNotNull(), F.lit(ends["first"]))
    return named.join(found, "ray_id", "left").select("ray_id", F.coalesce("m.point_id", none).cast("long").alias("point_id"), F.col("m.dist").alias("dist"))
