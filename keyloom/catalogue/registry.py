"""Registered queries: a Spark function per operator and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Lake:
    """The given tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(lake) -> DataFrame`` under a name, with the equivalent SQL."""

    def add(fn: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Lake(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def money(c: Column) -> Column:
    """Amounts as exact decimals, so sums do not depend on the order of addition."""
    return c.cast("decimal(18,2)")


def joined(c: Column) -> Column:
    """A list as one text, for comparing results."""
    return F.array_join(c, ",")
