"""Data-quality checks.

Each returns the failing rows; an empty result is a pass.  :class:`Check` pairs those rows
with the way failures are counted, which for most checks is the row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.names import name_form
from keyloom.operators.joins import column_set_difference
from keyloom.operators.neighbours import with_next
from keyloom.operators.relational import accepted_distinct, symmetric_difference


@dataclass
class Check:
    """Failing rows of one check and the expression that counts its failures."""

    rows: DataFrame
    count: Column = field(default_factory=lambda: F.count(F.lit(1)))

    def failures(self) -> DataFrame:
        return self.rows.agg(F.coalesce(self.count, F.lit(0)).cast("bigint").alias("failures"))


def _filtered(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(F.expr(where)) if where else df


def _bound(value: Any) -> Column:
    return F.expr(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


# -- row-local conditions, shared with the fused suite ---------------------------------


def in_range(column: str, low: Any = None, high: Any = None, inclusive: bool = True) -> Column:
    """Within the bounds; text bounds are expressions over the row, NULL stays unknown."""
    c = F.col(column)
    tests = []
    if low is not None:
        tests.append(c >= _bound(low) if inclusive else c > _bound(low))
    if high is not None:
        tests.append(c <= _bound(high) if inclusive else c < _bound(high))
    # one broken bound is enough to fail, also when the other one is unknown
    failed = F.lit(False)
    for test in tests:
        failed = failed | F.coalesce(~test, F.lit(False))
    return ~failed


def is_true(expression: str, column: str | None = None) -> Column:
    return F.expr(f"{column} {expression}" if column else expression)


def has_text(column: str, trim: bool = True) -> Column:
    c = F.col(column)
    return (F.trim(c) if trim else c) != F.lit("")


# -- checks -----------------------------------------------------------------------------


def accepted_range(df, column, low=None, high=None, inclusive=True, where=None) -> DataFrame:
    return _filtered(df, where).where(~in_range(column, low, high, inclusive))


def expression_is_true(df, expression, column=None, where=None) -> DataFrame:
    return _filtered(df, where).where(~is_true(expression, column))


def not_empty_string(df, column, trim=True, where=None) -> DataFrame:
    c = F.trim(F.col(column)) if trim else F.col(column)
    return _filtered(df, where).select(c.alias(column)).where(F.col(column) == "")


def not_null(df, column, where=None) -> DataFrame:
    return _filtered(df, where).where(F.col(column).isNull())


def unique(df, column, where=None) -> DataFrame:
    """Repeated non-null values with their row counts."""
    c = F.col(column)
    rows = _filtered(df, where).where(c.isNotNull()).groupBy(c.alias("unique_field")).agg(F.count(F.lit(1)).alias("n_records"))
    return rows.where("n_records > 1")


def accepted_values(df, column, values, where=None) -> DataFrame:
    """Values outside the list with their row counts."""
    rows = _filtered(df, where).groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records"))
    return rows.where(~F.col("value_field").isin(list(values)))


def not_accepted_values(df, column, values, where=None) -> DataFrame:
    return accepted_distinct(_filtered(df, where), column, values)


def at_least_one(df, column, groups: Sequence[str] = (), where=None) -> DataFrame:
    """Groups without a single non-null value; without groups one found row settles it."""
    rows = _filtered(df, where)
    if not groups:
        rows = rows.select(column).where(F.col(column).isNotNull()).limit(1)
    counted = rows.groupBy(*groups).agg(F.count(F.col(column)).alias("filler_column"))
    return counted.where("filler_column = 0")


def not_constant(df, column, groups: Sequence[str] = (), where=None) -> DataFrame:
    """Groups whose non-null values are all the same; all-NULL groups pass.

    Least = greatest says the same as "one distinct value" and needs no distinct shuffle.
    """
    same = F.min(column) == F.max(column)
    found = _filtered(df, where).groupBy(*groups).agg(same.alias("__same"))
    return found.where("__same").select(*groups, F.lit(1).cast("bigint").alias("filler_column"))


def not_null_proportion(df, column, at_least, at_most=1.0, groups: Sequence[str] = (), where=None) -> DataFrame:
    share = F.count(F.col(column)) / F.count(F.lit(1))
    found = _filtered(df, where).groupBy(*groups).agg(share.alias("not_null_proportion"))
    p = F.col("not_null_proportion")
    return found.where((p < F.lit(at_least)) | (p > F.lit(at_most)))


def unique_combination(df, columns: Sequence[str], where=None) -> DataFrame:
    return _filtered(df, where).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")


def relationships_where(df, column, to, field_, from_condition="1=1", to_condition="1=1") -> DataFrame:
    """Non-null ids without a partner, duplicates kept; the far side is made distinct first."""
    left = df.where(F.expr(from_condition)).select(F.col(column).alias("id")).where("id is not null")
    right = to.where(F.expr(to_condition)).select(F.col(field_).alias("id")).where("id is not null").distinct()
    return left.join(right, "id", "left_anti").withColumn("right_id", F.lit(None).cast(left.schema["id"].dataType))


def cardinality_equality(df, column, to, field_, where=None) -> DataFrame:
    """(value, count) pairs that differ between two columns, from either side."""
    a = _filtered(df, where).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("num_rows"))
    b = to.groupBy(F.col(field_).alias("value")).agg(F.count(F.lit(1)).alias("num_rows"))
    return symmetric_difference(a, b).drop("which_diff")


def _group_counts(df: DataFrame, groups: Sequence[str], tag: str, count: str) -> DataFrame:
    constant = F.lit(1).alias(f"group_key_{tag}")
    keys = [F.col(g).alias(f"{g}_{tag}") for g in groups]
    return df.groupBy(constant, *keys).agg(F.count(F.lit(1)).alias(count))


def _compare_counts(df, to, groups, count_a, count_b) -> DataFrame:
    a = _group_counts(df, groups, "a", count_a)
    b = _group_counts(to, groups, "b", count_b)
    condition = [F.col(f"{g}_a") == F.col(f"{g}_b") for g in ["group_key", *groups]]
    return a.join(b, condition, "full")


def equal_rowcount(df, to, groups: Sequence[str] = (), strict: bool = False) -> Check:
    """All groups with both row counts; failures are the summed differences.

    A group on one side only has no difference and passes, unless ``strict``.
    """
    rows = _compare_counts(df, to, groups, "count_a", "count_b")
    a, b = F.col("count_a"), F.col("count_b")
    if strict:
        a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    rows = rows.withColumn("diff_count", F.abs(a - b))
    return Check(rows, F.sum(F.coalesce("diff_count", F.lit(0))))


def fewer_rows_than(df, to, groups: Sequence[str] = (), strict: bool = False) -> Check:
    """Groups with the surplus of rows over the other table; an equal count scores one."""
    rows = _compare_counts(df, to, groups, "count_our_model", "count_comparison_model")
    ours, theirs = F.col("count_our_model"), F.col("count_comparison_model")
    if strict:
        ours, theirs = F.coalesce(ours, F.lit(0)), F.coalesce(theirs, F.lit(0))
    delta = F.when(ours > theirs, ours - theirs).when(ours == theirs, F.lit(1)).otherwise(F.lit(0))
    return Check(rows.withColumn("row_count_delta", delta.cast("bigint")), F.sum("row_count_delta"))


def equality(df, to, compare_columns=None, exclude_columns=None, precision=None) -> Check:
    """Set comparison of two tables, both ways; repeated rows count once.

    ``precision`` rounds numeric columns before comparing.  Failures are the differing
    rows plus the imbalance between the two directions.
    """
    if compare_columns and exclude_columns:
        raise ValueError("give either compare_columns or exclude_columns, not both")
    if compare_columns:
        wanted = {c.lower() for c in compare_columns}
        chosen = [c for c in df.columns if c.lower() in wanted] if precision is not None else list(compare_columns)
    else:
        dropped = {c.lower() for c in exclude_columns or ()}
        chosen = [c for c in df.columns if c.lower() not in dropped]
        other = {c.lower() for c in to.columns if c.lower() not in dropped}
        if {c.lower() for c in chosen} != other:
            raise ValueError("the two tables do not have the same columns")

    def side(table: DataFrame) -> DataFrame:
        return table.select([_rounded(table, c, precision).alias(c) for c in chosen])

    rows = symmetric_difference(side(df), side(to))
    only_a = F.count_if(F.col("which_diff") == "a_minus_b")
    only_b = F.count_if(F.col("which_diff") == "b_minus_a")
    return Check(rows, F.count(F.lit(1)) + F.abs(only_a - only_b))


def _rounded(df: DataFrame, column: str, precision: int | None) -> Column:
    c = F.col(f"`{column}`")
    if precision is None or not isinstance(df.schema[column].dataType, T.NumericType):
        return c
    # half-up on the written digits; very large numbers and NaN stay what they are
    return F.round(c, precision)


def repeated(df: DataFrame, n: str, most: int = 1 << 16) -> DataFrame:
    """Every row ``n`` times, without that column.

    A row repeated very often is first cut into shares of ``most``, which are dealt out anew.
    """
    whole = [F.col(f"`{c}`") for c in df.columns if c != n]
    last = F.ceil(F.col(n) / most).cast("bigint")
    shares = df.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("__share"))
    size = F.least(F.lit(most).cast("bigint"), F.col(n) - (F.col("__share") - 1) * most)
    shares = shares.withColumn(n, size).repartition(F.xxhash64(*whole, "__share"))
    return shares.select(*whole, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias("__copy")).drop("__copy")


def mutually_exclusive_ranges(
    df, lower: str, upper: str, partition_by: str | None = None, gaps: str = "allowed", zero_length: bool = False, where=None
) -> DataFrame:
    """Ranges that are upside down or reach into the next range of their partition.

    Repeated ranges are counted first.  Among ranges with one lower bound only the one
    with the greatest upper bound has a later lower bound next, so the search for the
    next bound runs over distinct lower bounds, cut into value ranges.
    """
    if gaps not in ("not_allowed", "allowed", "required"):
        raise ValueError(f"gaps must be not_allowed, allowed or required, got {gaps!r}")
    keys = ["partition_by_col"] if partition_by else []
    picked = _filtered(df, where).select(
        *([F.expr(partition_by).alias("partition_by_col")] if partition_by else []),
        F.expr(lower).alias("lower_bound"),
        F.expr(upper).alias("upper_bound"),
    )
    counted = picked.groupBy(*keys, "lower_bound", "upper_bound").agg(F.count(F.lit(1)).alias("__n"))
    # an upper bound that is NULL comes last
    greatest = F.when(F.count("upper_bound") == F.count(F.lit(1)), F.max("upper_bound"))
    bounds = picked.groupBy(*keys, "lower_bound").agg(greatest.alias("__top"))
    bounds = with_next(bounds, keys, "lower_bound", "__next")
    bounds = bounds.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("lower_bound").alias("__lower"),
        "__top",
        "__next",
    )
    match = [counted[k].eqNullSafe(bounds[f"__{k}"]) for k in keys] + [counted["lower_bound"].eqNullSafe(bounds["__lower"])]
    joined = counted.join(bounds, match, "inner")

    is_top = F.col("upper_bound").eqNullSafe(F.col("__top"))
    # of n equal ranges at the top, n-1 are followed by their own lower bound
    before_top = F.struct(
        F.col("lower_bound").alias("next_lower_bound"),
        F.lit(False).alias("is_last_record"),
        (F.col("__n") - F.when(is_top, 1).otherwise(0)).alias("n"),
    )
    topmost = F.struct(
        F.col("__next.v").alias("next_lower_bound"),
        F.col("__next").isNull().alias("is_last_record"),
        F.when(is_top, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n"),
    )
    cases = joined.select(*keys, "lower_bound", "upper_bound", F.explode(F.array(before_top, topmost)).alias("c")).select(
        *keys, "lower_bound", "upper_bound", "c.*"
    ).where("n > 0")

    lo, hi, nxt = F.col("lower_bound"), F.col("upper_bound"), F.col("next_lower_bound")
    length_ok, length_word = (lo <= hi, "less_than_or_equal_to") if zero_length else (lo < hi, "less_than")
    gap_ok, gap_word = {
        "not_allowed": (hi == nxt, "equal_to"),
        "allowed": (hi <= nxt, "less_than_or_equal_to"),
        "required": (hi < nxt, "less_than"),
    }[gaps]
    length_name = f"lower_bound_{length_word}_upper_bound"
    gap_name = f"upper_bound_{gap_word}_next_lower_bound"
    judged = cases.withColumn(length_name, F.coalesce(length_ok, F.lit(False))).withColumn(
        gap_name, F.coalesce(gap_ok, F.col("is_last_record"), F.lit(False))
    )
    failing = judged.where(~(F.col(length_name) & F.col(gap_name)))
    return repeated(failing, "n")


def sequential_values(df, column: str, interval: int = 1, datepart: str | None = None, groups: Sequence[str] = (), where=None) -> DataFrame:
    """Values that do not follow their predecessor by exactly the interval.

    A repeated value has itself as predecessor, so it fails once per extra copy; the first
    value of a group passes.  Runs on distinct values, cut into value ranges.
    """
    previous = f"previous_{name_form(column, 'slug')}"
    present = _filtered(df, where).where(F.col(column).isNotNull()).select(*groups, F.col(column).alias("__v"))
    counted = present.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__n"))
    linked = with_next(counted, groups, "__v", "__next")
    step = (lambda c: F.timestamp_add(datepart.upper(), F.lit(interval), c)) if datepart else (lambda c: c + F.lit(interval))
    moment = (lambda c: c.cast("timestamp")) if datepart else (lambda c: c)
    after = F.struct(F.col("__next.v").alias("value"), F.col("__v").alias("before"), F.when(F.col("__next").isNotNull(), 1).otherwise(0).cast("bigint").alias("n"))
    repeat = F.struct(F.col("__v").alias("value"), F.col("__v").alias("before"), (F.col("__n") - 1).alias("n"))
    cases = linked.select(*groups, F.explode(F.array(after, repeat)).alias("c")).select(*groups, "c.*").where("n > 0")
    failing = cases.where(~(moment(F.col("value")) == moment(step(F.col("before")))))
    return repeated(failing.select(*groups, F.col("value").alias(column), F.col("before").alias(previous), "n"), "n")


def recency(df, column, datepart, interval, now: Column | None = None, ignore_time: bool = False, groups: Sequence[str] = (), where=None) -> DataFrame:
    """Groups whose newest value is older than ``now`` minus the interval."""
    now = F.current_timestamp() if now is None else now
    newest, limit = F.max(column), F.timestamp_add(datepart.upper(), F.lit(-interval), now)
    if ignore_time:
        newest, limit = newest.cast("date"), limit.cast("date")
    found = _filtered(df, where).groupBy(*groups).agg(newest.alias("most_recent"))
    return found.withColumn("threshold", limit).where("most_recent < threshold")


def assert_equal(df, actual, expected) -> DataFrame:
    return df.where(F.expr(actual) != F.expr(expected))


def column_set(spark: SparkSession, df, expected: Sequence[str]) -> DataFrame:
    return column_set_difference(spark, df.columns, expected)


def non_empty(df, name: str = "table") -> DataFrame:
    """One row with a message when the table has no rows; reads one row at most."""
    found = df.select(F.lit(1).alias("x")).limit(1).agg(F.count("x").alias("n"))
    return found.where("n = 0").select(F.lit(f"{name}: load returned zero rows").alias("message"))
