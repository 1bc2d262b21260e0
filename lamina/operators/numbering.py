"""Row numbers in a global order, without one task that sorts everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import Workspace


def ordered_ids(df: DataFrame, order: list[str], name: str, work: Workspace) -> DataFrame:
    """``name`` counts the rows from 0 in the order of the keys ``order``; of equal keys any comes first, so keep the result.

    Rows are dealt by range and sorted in place; each range then adds the number of rows in
    the ranges before it. That list has one row for each partition, and is broadcast.
    """
    ranged = work.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), f"ranged_{uuid.uuid4().hex}")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return work.met(ranged.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before"))
