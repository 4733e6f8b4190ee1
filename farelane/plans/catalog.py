"""Registered relational queries: one for each operator of the blueprint that is a query by itself.

plain() takes SQL that both engines read alike; query() takes a DataFrame function and the comparison SQL (none where SQL
can't express it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelane.plans import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(name: str, sql: str, duck: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bridge.register(spark, sf_dir)
        return spark.sql(sql.replace("VARCHAR(20)", "STRING"))

    QUERIES[name], ORACLES[name] = run, bridge.duck(duck or sql)


def query(name: str, sql: str | None = None):
    def take(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bridge.register(spark, sf_dir)
            return f(spark)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = bridge.duck(sql)
        return f

    return take
