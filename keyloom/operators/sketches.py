"""Profiles that grow with a table: one row of sketches per column and load, united when asked.

A load is read once, without a shuffle of values: counts, a HyperLogLog sketch of the distinct
values, and a sketch of the most frequent ones.  A profile unites the stored rows, so a table that has
grown is profiled by reading the new load alone.  Row counts, NULL rates and years are
exact; distinct counts are within about 1 % (one deviation of ``LG_K``), and a frequent value can't
be missed if it has more than one in ``TRACKED`` of the values.  ``confirmed`` counts the listed values exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.similarity import cardinality_label, type_family
from keyloom.functions.strings import plain_text
from keyloom.operators.profile import NULL_SHARE_LIMIT, plain_columns

LG_K = 14
TRACKED = 1024
SHOWN = 5


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ord, column_name, dtype, family, rows, present, distinct, frequent) of one load."""
    fields = [f for f in plain_columns(df) if columns is None or f.name in columns]
    texts = df.select([plain_text(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)])
    frequent = lambda i: F.expr(f"approx_top_k_accumulate(c{i}, {TRACKED}) FILTER (WHERE c{i} IS NOT NULL)")
    one = texts.agg(
        F.count(F.lit(1)).alias("rows"),
        *[x for i in range(len(fields)) for x in (F.count(f"c{i}").alias(f"n{i}"), F.hll_sketch_agg(f"c{i}", LG_K).alias(f"d{i}"), frequent(i).alias(f"t{i}"))],
    )
    entry = lambda i, f: F.struct(
        F.lit(i).alias("ord"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(type_family(f.dataType)).alias("family"),
        F.col("rows").alias("rows"), F.col(f"n{i}").alias("present"), F.col(f"d{i}").alias("distinct"), F.col(f"t{i}").alias("frequent"),
    )
    return one.select(F.explode(F.array(*[entry(i, f) for i, f in enumerate(fields)])).alias("x")).select("x.*")


def merged_profile(sketches: DataFrame, top: int = SHOWN) -> DataFrame:
    """A row per column out of the sketches of all loads, in the form of ``column_profile``.

    A column that a load lacks counts as NULL there.
    """
    loads = sketches.groupBy("load").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"))
    united = sketches.groupBy("column_name").agg(
        F.min("ord").alias("ord"),
        F.max_by("dtype", "load").alias("dtype"),
        F.max_by("family", "load").alias("family"),
        F.sum("present").alias("present"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_count"),
    )
    often = sketches.where("present > 0").groupBy("column_name").agg(F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))
    united = united.join(often, "column_name", "left")
    listed = F.transform(F.expr(f"approx_top_k_estimate(frequent, {top})"), lambda x: x["item"])
    present, rows = F.col("present"), F.col("row_count")
    out = united.join(loads.hint("broadcast"), F.lit(True)).select(  # loads: a single row
        "ord", "column_name", "dtype", "family", "row_count", F.least("unique_count", "present").alias("unique_count"),
        F.when(rows > 0, 1 - present / rows).otherwise(1.0).alias("null_rate"),
        F.when(present > 0, F.least("unique_count", "present") / present).otherwise(0.0).alias("uniqueness_rate"),
        F.when(present > 0, listed).otherwise(F.array().cast("array<string>")).alias("top_values"),
    )
    return out.withColumn("cardinality", cardinality_label(F.col("uniqueness_rate")))


def confirmed(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(column_name, value, n): exact counts of a profile's top values over the whole table, in one scan."""
    wanted = {r["column_name"]: r["top_values"] for r in profile.select("column_name", "top_values").collect()}  # a few values per column
    fields = [f for f in plain_columns(df) if wanted.get(f.name)]
    text: dict[str, Column] = {f.name: plain_text(F.col(f"`{f.name}`"), f.dataType) for f in fields}
    counts = [F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("value"), F.count_if(t == v).alias("n")) for c, t in text.items() for v in wanted[c]]
    return df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


class StoredSketches:
    """The sketches of a table's loads under one folder; adding a load again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, load: str, df: DataFrame) -> None:
        """Sketch one load; only ``df`` is read."""
        column_sketches(df).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/load={load}")

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/load=*").withColumn("load", F.col("load").cast("string"))

    def profile(self, top: int = SHOWN) -> DataFrame:
        return merged_profile(self.read(), top)

    def table_profile(self, table: str) -> DataFrame:
        """One row in the form of the stored table profiles, without a year histogram."""
        columns = self.profile()
        cells = F.greatest(F.sum("row_count"), F.lit(1))
        return columns.groupBy().agg(
            F.lit(table).alias("table_name"),
            F.max("row_count").alias("row_count"),
            F.lit(None).cast("map<string,bigint>").alias("exercicio_distribution"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "unique_count")))).alias("cardinality_per_col"),  # columns: schema-sized
            (F.sum(F.col("null_rate") * F.col("row_count")) / cells < NULL_SHARE_LIMIT).alias("quality_ok"),
        )
