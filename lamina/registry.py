"""The lists of registered volume queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.operators.volume_tables import DerivedVolume, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[DerivedVolume], DataFrame], duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(DerivedVolume(spark, sf_dir))
    if duck:
        ORACLES[name] = oracle(duck)


def both(name: str, text: str, duck: str | None = None) -> None:
    """A query that Spark SQL and DuckDB write alike, but for integer division."""
    register(name, lambda v: v.sql(text), duck or text.replace(" div ", " // "))
