"""Enrichment joins, value membership and column-set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.strings import match_text
from keyloom.session import small_table


def enrich(left: DataFrame, right: DataFrame, on: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Left equi join that adds ``keep`` columns of ``right``.

    Rows fan out when ``right`` is not unique on the key; check it with
    :func:`keyloom.operators.checks.unique_combination` first.  The strategy (broadcast,
    sort-merge, skew split) is left to Spark, which knows the sizes.
    """
    r = right.select(
        *[F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(on.values())],
        *[F.col(f"`{c}`") for c in keep],
    )
    condition = [left[a] == r[f"__k{i}"] for i, a in enumerate(on)]
    return left.join(r, condition, "left").drop(*[f"__k{i}" for i in range(len(on))])


def _texts(df: DataFrame, column: str, normalize: bool) -> Column:
    c = F.col(f"`{column}`")
    return match_text(c, df.schema[column].dataType) if normalize else c.cast("string")


def match_rate(
    a: DataFrame,
    column_a: str,
    b: DataFrame,
    column_b: str,
    normalize: bool = True,
    by_a: Column | None = None,
    by_b: Column | None = None,
) -> DataFrame:
    """Share of non-null rows of A whose value occurs in B, row weighted.

    With ``by_a`` and ``by_b`` (say, fiscal years) values are compared within equal ``by``
    only and one row per ``by`` of A comes back.  Both sides meet in one grouping on the
    value with counts added up before the shuffle, so a frequent value costs one row.
    """
    grouped = by_a is not None and by_b is not None
    by = (lambda c: [c.alias("by")]) if grouped else (lambda c: [])
    left = a.select(*by(by_a), _texts(a, column_a, normalize).alias("v"), F.lit(1).alias("n"), F.lit(0).alias("hit"))
    right = b.select(*by(by_b), _texts(b, column_b, normalize).alias("v"), F.lit(0).alias("n"), F.lit(1).alias("hit"))
    per_value = (
        left.unionAll(right)
        .where(F.col("v").isNotNull())
        .groupBy(*(["by"] if grouped else []), "v")
        .agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
    )
    rows = F.coalesce(F.sum("n"), F.lit(0))
    hits = F.coalesce(F.sum(F.col("n") * F.col("hit")), F.lit(0))
    out = per_value.groupBy(*(["by"] if grouped else [])).agg(
        rows.alias("rows_a"),
        hits.alias("hits"),
        F.when(rows > 0, hits / rows).otherwise(F.lit(0.0)).alias("match_rate"),
    )
    return out.where("rows_a > 0") if grouped else out


GROUP_LITERALS = 1000


def common_groups(a: DataFrame, by_a: Column, b: DataFrame, by_b: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the groups (fiscal years) they share.

    Years are few: up to ``GROUP_LITERALS`` shared groups become literals, which filter and prune
    the scans without moving a row.  More are a semi join with the distinct list.
    """
    in_a = a.select(by_a.alias("__by")).distinct()
    in_b = b.select(by_b.alias("__by")).distinct()
    shared = in_a.join(in_b, "__by", "left_semi")
    few = [r[0] for r in shared.limit(GROUP_LITERALS + 1).collect()]
    if len(few) <= GROUP_LITERALS:
        return a.where(by_a.isin(few)), b.where(by_b.isin(few))
    keep = lambda df, c: df.withColumn("__by", c).join(shared, "__by", "left_semi").drop("__by")
    return keep(a, by_a), keep(b, by_b)


def name_set_difference(actual: DataFrame, expected: DataFrame, upper: bool = True) -> DataFrame:
    """Full outer join of two one-column tables of names; rows where one side is missing."""
    form = F.upper if upper else (lambda c: c)
    a = actual.select(form(F.col(actual.columns[0])).alias("actual")).distinct()
    e = expected.select(form(F.col(expected.columns[0])).alias("expected")).distinct()
    joined = a.join(e, F.col("actual") == F.col("expected"), "full")
    return joined.where(F.col("actual").isNull() | F.col("expected").isNull())


def column_set_difference(
    spark: SparkSession, actual: Sequence[str], expected: Sequence[str], upper: bool = True
) -> DataFrame:
    """Column names that one of two tables lacks."""
    listed = lambda names: small_table(spark, [(n,) for n in names], "name string")
    return name_set_difference(listed(actual), listed(expected), upper)
