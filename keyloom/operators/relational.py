"""Relational helpers: deduplicate, pivot, unpivot, unions, set differences, generators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyloom.functions.names import name_form
from keyloom.session import small_table

_RANK = "__rank"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order``.

    The rank filter sits right on the window, so Spark keeps one row per key and map
    task before the shuffle: a key holding a third of the table sends a few rows only.
    """
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


deduplicate = latest_per_key


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a table under a total order."""
    return df.orderBy(*order).limit(k)


def group_by_first(df: DataFrame, n: int, *aggregates: Column) -> DataFrame:
    """Group by the first ``n`` columns, as ``GROUP BY 1..n`` does."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns[:n]]).agg(*aggregates)


def pivot_columns(
    column: str,
    values: Iterable[Any],
    agg: str = "sum",
    cmp: str = "=",
    prefix: str = "",
    suffix: str = "",
    then: Any = 1,
    otherwise: Any = 0,
    distinct: bool = False,
    quote: bool = True,
    alias: bool = True,
) -> list[Column]:
    """One conditional aggregate per value, for use inside ``groupBy().agg()``.

    ``then`` and ``otherwise`` are literals or Columns; a value with no rows gives the
    aggregate of ``otherwise``, not NULL as ``groupBy().pivot()`` would.  With
    ``quote=False`` the output names are turned into identifiers.
    """
    compare = {
        "=": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
        "<>": lambda c, v: c != v,
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
    }[cmp]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = []
    for value in values:
        hit = F.when(compare(F.col(column), F.lit(value)), as_column(then))
        cell = hit.otherwise(as_column(otherwise)) if otherwise is not None else hit
        if distinct:
            if agg != "count":
                raise ValueError("distinct is for agg='count'")
            cell = F.count_distinct(cell)
        else:
            cell = getattr(F, agg)(cell)
        name = f"{prefix}{value}{suffix}"
        out.append(cell.alias(name if quote else name_form(name, "slug")) if alias else cell)
    return out


def pivot(df: DataFrame, groups: Sequence[str], column: str, values: Iterable[Any], **options) -> DataFrame:
    return df.groupBy(*groups).agg(*pivot_columns(column, values, **options))


def column_values(
    df: DataFrame,
    column: str,
    order: Sequence[Column] | None = None,
    max_records: int | None = None,
    where: str | None = None,
) -> DataFrame:
    """Distinct values of a column with their counts, NULL being a value of its own.

    Default order is the count, largest first; the value breaks ties so the result of a
    row cap is the same every time.
    """
    rows = df.where(F.expr(where)) if where else df
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = list(order) if order is not None else [F.col("n").desc_nulls_last()]
    counted = counted.orderBy(*order, F.col("value").asc_nulls_last())
    return counted.limit(max_records) if max_records is not None else counted


def column_values_or(
    spark: SparkSession, table: str, column: str, default: Sequence[Any] | None = None, **options
) -> DataFrame:
    """:func:`column_values` of a catalog table, or the default values when it is missing.

    A table that is there but yields no value also falls back to the defaults, when given.
    """
    if not spark.catalog.tableExists(table):
        if default is None:
            raise ValueError(f"table {table} does not exist and no default was given")
        return _default_values(spark, default)
    found = column_values(spark.table(table), column, **options)
    return _default_values(spark, default) if default is not None and found.isEmpty() else found


def _default_values(spark: SparkSession, default: Sequence[Any]) -> DataFrame:
    if not default:
        return small_table(spark, [], "value string, n bigint")
    values = F.array(*[F.lit(v) for v in default])
    return spark.range(1).select(F.explode(values).alias("value"), F.lit(0).cast("bigint").alias("n"))


def single_value(df: DataFrame, default: Any = None) -> DataFrame:
    """First row and column of a query as one row ``value``; the default when it is empty.

    ``max`` over at most one row is that row's value, and an aggregate always returns a
    row, so an empty input needs no second query.
    """
    first = df.columns[0]
    cell = df.select(F.struct(F.col(f"`{first}`").alias("v")).alias("cell")).limit(1)
    found = F.max("cell")
    return cell.agg(
        F.when(found.isNull(), F.lit(default)).otherwise(found["v"]).alias("value")
        if default is not None
        else found["v"].alias("value")
    )


def unpivot(
    df: DataFrame,
    exclude: Sequence[str] = (),
    remove: Sequence[str] = (),
    cast_to: str = "string",
    field_name: str = "field_name",
    value_name: str = "value",
) -> DataFrame:
    """Columns to rows: keep ``exclude``, drop ``remove``, one row per other column.

    All values are cast to one type first, NULL values stay.  One scan, one ``Expand``.
    """
    kept = {c.lower() for c in exclude}
    gone = {c.lower() for c in remove}
    ids = [c for c in df.columns if c.lower() in kept]
    values = [c for c in df.columns if c.lower() not in kept | gone]
    typed = df.select(
        *[F.col(f"`{c}`") for c in ids],
        *[F.col(f"`{c}`").cast(cast_to).alias(c) for c in values],
    )
    return typed.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], field_name, value_name)


# Fixed value: default name of the column that says where a row came from.
SOURCE_COLUMN = "_dbt_source_relation"


def union_relations(
    relations: Mapping[str, DataFrame],
    column_override: Mapping[str, str] | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    source_column: str | None = SOURCE_COLUMN,
    where: str | None = None,
) -> DataFrame:
    """Union by name over many tables with the superset of their columns.

    Columns come in first-seen order with the first-seen type, a table lacking one gives
    typed NULLs, and ``where`` is applied inside each table so it reaches the scans.
    """
    if include and exclude:
        raise ValueError("give either an include or an exclude list, not both")
    keep = {c.lower() for c in include}
    drop = {c.lower() for c in exclude}
    override = column_override or {}
    superset: dict[str, T.DataType] = {}
    for df in relations.values():
        for f in df.schema:
            low = f.name.lower()
            if (keep and low not in keep) or low in drop:
                continue
            superset.setdefault(f.name, f.dataType)
    if not superset:
        raise ValueError(f"no columns left to union for {list(relations)}")
    parts = []
    for name, df in relations.items():
        rows = df.where(F.expr(where)) if where else df
        columns = [
            (F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(override.get(c, dt)).alias(c)
            for c, dt in superset.items()
        ]
        source = [F.lit(name).alias(source_column)] if source_column else []
        parts.append(rows.select(*source, *columns))
    return reduce(DataFrame.unionAll, parts)


def symmetric_difference(a: DataFrame, b: DataFrame, side: str = "which_diff") -> DataFrame:
    """Distinct rows present on one side only, tagged ``a_minus_b`` / ``b_minus_a``.

    Both ``EXCEPT`` directions from one grouping: repeated rows collapse before the
    shuffle and each side is read once.
    """
    if len(a.columns) != len(b.columns):
        raise ValueError("both sides need the same number of columns")
    names = a.columns
    tagged = (
        a.select("*", F.lit(1).alias("__a"), F.lit(0).alias("__b"))
        .unionAll(b.toDF(*names).select("*", F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    )
    seen = tagged.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    only = seen.where(F.col("__a") != F.col("__b"))
    tag = F.when(F.col("__a") == 1, "a_minus_b").otherwise("b_minus_a").alias(side)
    return only.select(tag, *[F.col(f"`{c}`") for c in names])


def accepted_distinct(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Distinct values of a column that are in a list."""
    return df.select(F.col(column).alias("value_field")).where(F.col("value_field").isin(list(values))).distinct()


def number_series(spark: SparkSession, upper: int) -> DataFrame:
    """Numbers 1..upper, produced in parallel."""
    if upper <= 0:
        raise ValueError("upper bound must be positive")
    return spark.range(1, upper + 1).select(F.col("id").alias("generated_number"))


_UNITS = {
    "day": ("DAY", 1), "week": ("DAY", 7), "month": ("MONTH", 1), "quarter": ("MONTH", 3), "year": ("MONTH", 12),
    "hour": ("HOUR", 1), "minute": ("MINUTE", 1), "second": ("SECOND", 1),
}
_SPINE_SHARE = 1 << 12


def date_spine(bounds: DataFrame, part: str, start: str = "start", end: str = "end", out_type: str = "timestamp_ntz") -> DataFrame:
    """One row per date part from ``start`` up to, not including, ``end``.

    ``bounds`` is a one-row table, often an aggregate over data.  An end that does not lie
    after its start is an error.  Column ``date_<part>``.
    """
    unit, per_step = _UNITS[part]
    lo, hi = F.col(start).cast(out_type), F.col(end).cast(out_type)
    checked = bounds.select(
        F.when(lo < hi, lo).otherwise(F.raise_error(F.lit("end of the spine must lie after its start")).cast(out_type)).alias("lo"),
        hi.alias("hi"),
    )
    # shares of the spine first, dealt out, then their points: no array holds it whole
    last = F.timestamp_diff(unit, F.col("lo").cast("timestamp"), F.col("hi").cast("timestamp")) / per_step
    shares = checked.withColumn("last", F.floor(last).cast("bigint"))
    shares = shares.select("lo", "hi", "last", F.explode(F.expr(f"sequence(0L, last DIV {_SPINE_SHARE})")).alias("share")).repartition("share")
    steps = shares.select("lo", "hi", F.explode(F.expr(f"sequence(share * {_SPINE_SHARE}, least(last, share * {_SPINE_SHARE} + {_SPINE_SHARE - 1}))")).alias("i"))
    points = steps.select(F.timestamp_add(unit, (F.col("i") * per_step).cast("int"), F.col("lo").cast("timestamp")).cast(out_type).alias(f"date_{part}"), "hi")
    return points.where(F.col(f"date_{part}") < F.col("hi")).select(f"date_{part}")
