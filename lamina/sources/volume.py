"""Voxel tables that are derived from the business tables by integer arithmetic.

Suppliers are balls of a label in a grid of tiles: a tile is 20 x 48 x 48 voxels and holds 100
supplier keys, so the volume grows in z with the table. Around each ball's centre runs a
diagonal rod, the skeleton. The image adds up line quantities by voxel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_Z, NY, NX, TILE_KEYS = 20, 48, 48, 100
REACH = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre, radius, label and first z of the tile of every supplier."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "cast(1 + s_nationkey % 4 as int) as label_id",
        f"cast((s_suppkey div {TILE_KEYS}) * {TILE_Z} as int) as z0",
        f"cast((s_suppkey * 29) % {TILE_Z} as int) as cz",
        f"cast((s_suppkey * 53) % {NY} as int) as cy",
        f"cast((s_suppkey * 37) % {NX} as int) as cx",
        "cast(2 + s_nationkey % 3 as int) as r",
    )


def mask(spark: SparkSession, sf_dir: str, shrink: int = 0) -> DataFrame:
    """(label_id, z, y, x): outer masks, or with shrink 2 the inner ones."""
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    spread = balls(spark, sf_dir).withColumn("dz", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return (
        spread.where(f"dz*dz + dy*dy + dx*dx <= (r - {shrink}) * (r - {shrink})")
        .where(f"cz + dz between 0 and {TILE_Z - 1} and cy + dy between 0 and {NY - 1} and cx + dx between 0 and {NX - 1}")
        .selectExpr("label_id", "z0 + cz + dz as z", "cy + dy as y", "cx + dx as x")
        .distinct()
    )


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x) of the rods."""
    return (
        balls(spark, sf_dir)
        .withColumn("t", F.explode(F.sequence(F.lit(-3), F.lit(6))))
        .where(f"cz + t between 0 and {TILE_Z - 1} and cy + t % 2 between 0 and {NY - 1} and cx + t between 0 and {NX - 1}")
        .selectExpr("z0 + cz + t as z", "cy + t % 2 as y", "cx + t as x")
        .distinct()
    )


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, value); a voxel that is absent is 0."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.expr(f"cast(l_orderkey % {TILE_Z} + (l_suppkey div {TILE_KEYS}) * {TILE_Z} as int)").alias("z"), F.expr(f"cast(l_partkey % {NY} as int)").alias("y"), F.expr(f"cast(l_suppkey % {NX} as int)").alias("x"))
        .agg(F.expr("cast(sum(cast(l_quantity as bigint)) % 256 as int)").alias("value"))
    )


#: The same tables as DuckDB text.
SQL = {
    "balls": f"""select cast(1 + s_nationkey % 4 as int) label_id, cast((s_suppkey // {TILE_KEYS}) * {TILE_Z} as int) z0, cast((s_suppkey * 29) % {TILE_Z} as int) cz,
        cast((s_suppkey * 53) % {NY} as int) cy, cast((s_suppkey * 37) % {NX} as int) cx, cast(2 + s_nationkey % 3 as int) r from supplier""",
    "steps": f"select cast(unnest(generate_series(-{REACH}, {REACH})) as int) v",
    "outerv": f"""select distinct label_id, z0 + cz + a.v z, cy + b.v y, cx + c.v x from balls, steps a, steps b, steps c where a.v*a.v + b.v*b.v + c.v*c.v <= r*r
        and cz + a.v between 0 and {TILE_Z - 1} and cy + b.v between 0 and {NY - 1} and cx + c.v between 0 and {NX - 1}""",
    "innerv": f"""select distinct label_id, z0 + cz + a.v z, cy + b.v y, cx + c.v x from balls, steps a, steps b, steps c where a.v*a.v + b.v*b.v + c.v*c.v <= (r-2)*(r-2)
        and cz + a.v between 0 and {TILE_Z - 1} and cy + b.v between 0 and {NY - 1} and cx + c.v between 0 and {NX - 1}""",
    "skel": f"""select distinct cast(z0 + cz + t as int) z, cast(cy + t % 2 as int) y, cast(cx + t as int) x from balls, (select cast(unnest(generate_series(-3, 6)) as int) t)
        where cz + t between 0 and {TILE_Z - 1} and cy + t % 2 between 0 and {NY - 1} and cx + t between 0 and {NX - 1}""",
    "img": f"""select cast(l_orderkey % {TILE_Z} + (l_suppkey // {TILE_KEYS}) * {TILE_Z} as int) z, cast(l_partkey % {NY} as int) y, cast(l_suppkey % {NX} as int) x,
        cast(sum(cast(l_quantity as bigint)) % 256 as int) as value from lineitem group by 1, 2, 3""",
}
