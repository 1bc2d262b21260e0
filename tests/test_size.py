"""Registered queries on volumes that are deeper, or whose tables are larger, than one task or the driver should hold."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__
from lamina.sources import mesh_files

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["S10", "S10_sizes", "K4_files", "S13"])
def test_meshes_in_bands_are_those_of_the_sql(spark, monkeypatch, name):
    """The volume is 20 slices deep, so bands of 6 slices make files as those of 256 do in a deep one."""
    monkeypatch.setattr(mesh_files.write_meshes, "__defaults__", (6,))
    rows = __spark_entry__.queries()[name](spark, DATA)
    db = duckdb.connect()
    db.execute(f"create view supplier as select * from '{DATA}/supplier.parquet'")
    assert sorted(map(tuple, rows.collect())) == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


#: Keys of joins whose one side is a few rows whatever the volume: partitions, labels and the upper levels of nested cells.
FEW = {("_part",), ("label_id",), ("s_label",), ("cz", "cy", "cx")}


def broadcast_joins(spark, run) -> set[tuple[str, ...]]:
    """Keys of the broadcast joins in all that Spark executes while run() goes on."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions = lambda: [x.apply(i) for x in [store.executionsList()] for i in range(x.size())]
    before = max((x.executionId() for x in executions()), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in executions() if x.executionId() > before]
    keys = [k for p in plans for k in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys[^\n]*: \[(.*?)\]\n", p)]
    assert plans and len(keys) == sum(len(re.findall(r"\n\(\d+\) BroadcastHashJoin", p)) for p in plans)
    return {tuple(re.sub(r"#\d+L?", "", c) for c in k.split(", ")) for k in keys}


@pytest.mark.parametrize("name", ["A7", "C3", "A9", "A10", "C4", "G12", "G11", "J6", "J12", "K3", "M3", "O3", "A8", "G4", "G6", "G17", "G21", "G22", "G5", "U5", "S9_label", "S9", "T3", "J15_rays", "G7"])
def test_tables_of_the_volume_are_not_broadcast(spark, name):
    """The tables are a few kB here, as files or before they are spread; Spark would hold them for small at any size of the volume."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = broadcast_joins(spark, lambda: __spark_entry__.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found <= FEW
