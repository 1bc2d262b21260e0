"""Colours: hex and RGB columns, evenly spread hues, and colours for labels that have none."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the golden ratio's conjugate, the step from hue to hue.
GOLDEN = 0.618033988749895


def hex_to_rgba(color: Column, alpha: float = 1.0) -> Column:
    """struct(r, g, b, a) from 0 to 1 of '#rrggbb', with or without its mark; null where it isn't one."""
    digits = F.ltrim(color, F.lit("#"))
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int") / 255.0
    return F.when(F.regexp_like(digits, F.lit("^[0-9A-Fa-f]{6}$")), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.lit(alpha).alias("a")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """'#rrggbb' in lower case; a channel is cut off, not rounded."""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex((c * 255).cast("int"))), 2, "0") for c in (r, g, b)))


def color_distance(a: Column, b: Column) -> Column:
    """Euclidean, of two structs (r, g, b)."""
    return F.sqrt(sum((F.pow(a[c] - b[c], 2.0) for c in "gb"), F.pow(a["r"] - b["r"], 2.0)))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b) of a hue from 0 to 1."""
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    pick = lambda *six: F.element_at(F.array(*six), (F.pmod(sector, F.lit(6)) + 1).cast("int"))
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def rainbow_hues(n: int) -> list[float]:
    """n hues, each GOLDEN further than the one before; added up, as rounding shows in the colours."""
    out = [0.0]
    for _ in range(n - 1):
        out.append(math.fmod(out[-1] + GOLDEN, 1.0))
    return out[:n]


def rainbow_hex(hue: Column, saturation: float = 0.75, value: float = 0.85) -> Column:
    rgb = hsv_to_rgb(hue, F.lit(saturation), F.lit(value))
    return rgb_to_hex(rgb["r"], rgb["g"], rgb["b"])


def pick_colors(candidates: Column, used: Column, n: Column) -> Column:
    """n colours, one after another: of the candidates not yet used the first that is farthest from all used ones.

    Arrays of hex colours; a fold over the small label table's row, since each choice depends
    on those before. If no candidate is left the rest are null.
    """
    distance = lambda c, others: F.coalesce(F.array_min(F.transform(others, lambda o: color_distance(hex_to_rgba(c), hex_to_rgba(o)))), F.lit(math.inf))

    def choose(state: Column, _: Column) -> Column:
        free = F.filter(candidates, lambda c: ~F.array_contains(state["used"], c))
        far = F.transform(free, lambda c, i: F.struct(distance(c, state["used"]).alias("d"), (-i).alias("place"), c.alias("color")))
        color = F.array_max(far)["color"]
        return F.struct(F.when(color.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(color))).alias("used"), F.concat(state["picked"], F.array(color)).alias("picked"))

    start = F.struct(used.alias("used"), F.expr("cast(array() as array<string>)").alias("picked"))
    return F.aggregate(F.sequence(F.lit(1), n), start, choose, lambda state: state["picked"])


def assign_colors(labels, candidates_each: int = 3, least: int = 12):
    """(label_id, name, color) of labels (label_id, name, color or null): colours that are given stay,
    the others are picked in order of label_id from a rainbow of at least ``least`` candidates."""
    missing = labels.where("color is null").agg(F.array_sort(F.collect_list("label_id")).alias("ids"), F.count(F.lit(1)).cast("int").alias("n"))  # the label table is small
    given = labels.where("color is not null").agg(F.array_sort(F.collect_list(F.lower("color"))).alias("used"))
    most = max(least, candidates_each * labels.where("color is null").count())
    rainbow = F.transform(F.lit(rainbow_hues(most)), lambda hue: rainbow_hex(hue))
    picked = missing.where("n > 0").join(F.broadcast(given)).select("ids", pick_colors(rainbow, F.col("used"), F.col("n")).alias("picked")).select(F.explode(F.arrays_zip("ids", "picked")).alias("p")).select(F.col("p.ids").alias("label_id"), F.col("p.picked").alias("_picked"))
    return labels.join(picked, "label_id", "left").select("label_id", "name", F.coalesce("color", "_picked").alias("color"))
