"""Column and table profiles, pattern profiles, fiscal-year columns, table metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.names import name_form
from keyloom.functions.similarity import cardinality_label, type_family
from keyloom.functions.strings import plain_text
from keyloom.functions.vocabulary import BUILTIN_PATTERNS
from keyloom.operators.relational import top_per_group
from keyloom.session import settled, small_table

_NESTED = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)

# Sample sizes and thresholds of the profiles.
SHOWN_SAMPLE = 5
PATTERN_MAJORITY = 0.5
NULL_SHARE_LIMIT = 0.20
YEAR_PATTERN = r"^\d{4}$"
YEAR_FIRST, YEAR_LAST = 1990, 2040
YEAR_COVERAGE = 0.80


def plain_columns(df: DataFrame) -> list[T.StructField]:
    """Columns holding one value per row (nested and binary ones have no value text)."""
    return [f for f in df.schema if not isinstance(f.dataType, _NESTED)]


def _column_list(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), type_family(f.dataType)) for i, f in enumerate(fields)]
    return small_table(df.sparkSession, rows, "ord int, column_name string, dtype string, family string")


def value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``(column_name, value, n)`` over all columns: one scan, counts added up before the shuffle."""
    texts = df.select([plain_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    long = texts.unpivot([], [F.col(f"`{f.name}`") for f in fields], "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5, approx: bool = False) -> DataFrame:
    """One row per column: type, distinct count, null rate, uniqueness, label, top values.

    Null rate is 1 and uniqueness 0 on an empty table.  Distinct counts are exact;
    ``approx`` trades them for sketches and skips the top values, so nothing is shuffled.
    """
    fields = [f for f in plain_columns(df) if columns is None or f.name in columns]
    listed = _column_list(df, fields)
    if approx:
        stats = [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.approx_count_distinct(F.col(f"`{f.name}`")).alias("unique_count"),
                F.count(F.col(f"`{f.name}`")).alias("present"),
                F.count(F.lit(1)).alias("rows"),
            )
            for f in fields
        ]
        facts = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
        shown = None
    else:
        counts = value_counts(df, fields)
        facts = counts.groupBy("column_name").agg(
            F.count("value").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
            F.sum("n").alias("rows"),
        )
        # NULL may be among the ranked values and is dropped afterwards: filtering it here
        # would give the frequency table a second plan instead of reusing its shuffle
        best = top_per_group(counts, ["column_name"], [F.col("n").desc(), F.col("value").asc_nulls_last()], top + 1, "__r")
        # at most `top` + 1 rows per column are gathered
        ranked = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("__r", "value"))))
        shown = best.groupBy("column_name").agg(F.slice(F.transform(ranked, lambda x: x["value"]), 1, top).alias("top_values"))
    out = listed.join(facts, "column_name", "left")
    if shown is not None:
        out = out.join(shown, "column_name", "left")
    present, rows = F.coalesce("present", F.lit(0)), F.coalesce("rows", F.lit(0))
    unique = F.coalesce("unique_count", F.lit(0))
    out = out.select(
        "ord",
        "column_name",
        "dtype",
        "family",
        rows.alias("row_count"),
        unique.alias("unique_count"),
        F.when(rows > 0, 1 - present / rows).otherwise(1.0).alias("null_rate"),
        F.when(present > 0, unique / present).otherwise(0.0).alias("uniqueness_rate"),
        *([F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values")] if shown is not None else []),
    )
    return out.withColumn("cardinality", cardinality_label(F.col("uniqueness_rate")))


def key_suggestions(df: DataFrame, approx: bool = False) -> DataFrame:
    """Columns that are near-unique, best first."""
    found = column_profile(df, approx=approx).where(F.col("uniqueness_rate") > 0.95)
    return found.orderBy(F.col("uniqueness_rate").desc(), "ord")


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """One row: row count, quality flag, distinct count per column, fiscal-year histogram.

    Quality is fine while less than a fifth of all cells is NULL (also on an empty table).
    The year column is the first whose name contains ``exercicio`` or is ``ano``/``cd_ano``.
    """
    fields = plain_columns(df)
    year = next((c for c in df.columns if "exercicio" in c.lower() or c.lower() in ("ano", "cd_ano")), None)
    counts = value_counts(df, fields)
    per_column = counts.groupBy("column_name").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.sum("n").alias("rows"),
        *(
            [
                # the histogram of one year column: a value per year, not per row
                F.map_from_entries(
                    F.sort_array(F.collect_list(F.when(F.col("column_name") == year, F.struct(F.coalesce("value", F.lit("nan")).alias("k"), F.col("n").alias("v")))))
                ).alias("years")
            ]
            if year
            else []
        ),
    )
    one = per_column.groupBy().agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("cells"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "distinct")))).alias("found"),
        *([F.max_by("years", F.col("column_name") == year).alias("exercicio_distribution")] if year else []),
    )
    zero = F.create_map(*[x for f in sorted(fields, key=lambda f: f.name) for x in (F.lit(f.name), F.lit(0).cast("bigint"))])
    cells = F.when(F.col("cells") > 0, F.col("cells")).otherwise(1)
    return one.select(
        F.lit(table).alias("table_name"),
        "row_count",
        (F.col("exercicio_distribution") if year else F.lit(None).cast("map<string,bigint>")).alias("exercicio_distribution"),
        F.when(F.size("found") > 0, F.col("found")).otherwise(zero).alias("cardinality_per_col"),
        (F.col("nulls") / cells < NULL_SHARE_LIMIT).alias("quality_ok"),
    )


# -- samples and patterns -----------------------------------------------------------------


def _own_sample(df: DataFrame, name: str, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` non-null values of one column under ``order_by`` and then the value."""
    c = F.col(f"`{name}`")
    keys = list(dict.fromkeys([*order_by, name]))
    sort = [F.col(f"`{k}`").asc_nulls_last() for k in keys]
    first = df.where(c.isNotNull()).select(*[F.col(f"`{k}`") for k in keys]).orderBy(*sort).limit(n)
    rank = [x for k in keys for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]
    entry = F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)], plain_text(c, df.schema[name].dataType).alias("v"))
    # n entries at most
    sample = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"])
    return first.agg(sample.alias("sample")).select(F.lit(name).alias("column_name"), "sample")


def _first_rows(df: DataFrame, columns: Sequence[str], n: int, order_by: Sequence[str]) -> DataFrame:
    """``(column_name, sample, rows)``: non-null values among the first ``n`` rows, per column."""
    keys = list(dict.fromkeys([*order_by, *columns]))
    rows = df.select(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in keys]).limit(n)
    order = [x.alias(f"o{i}") for i, x in enumerate(x for k in keys for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`")))]
    texts = F.array(*[plain_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]).alias("texts")
    # n rows at most, turned into one list of non-null texts per column
    taken = rows.agg(F.sort_array(F.collect_list(F.struct(*order, texts))).alias("r"))
    names = F.split(F.lit("\n".join(columns)), "\n")
    column_texts = lambda i: F.filter(F.transform(F.col("r"), lambda e: F.get(e["texts"], i)), lambda v: v.isNotNull())
    lists = F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), column_texts)
    per_column = F.explode(F.arrays_zip(names.alias("column_name"), lists.alias("sample"))).alias("s")
    return taken.select(F.size("r").alias("rows"), per_column).select("s.*", "rows")


def table_samples(
    frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], n: int, order_by: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``(table_name, column_name, sample)``: the first ``n`` non-null values of each column.

    Spark rows have no position, so the order is the table's ``order_by`` (a unique key,
    ideally) and then the value.  Top-n plans keep a bounded heap per task: nothing is
    sorted or shuffled whole.  Where a table has an order, its first ``n`` rows serve all
    columns at once; only columns with NULLs among those rows need a top-n of their own.
    """
    own = [(t, c) for t in columns for c in columns[t] if not order_by.get(t)]
    ordered = [t for t in columns if order_by.get(t) and columns[t]]
    parts = []
    if ordered:
        first = [_first_rows(frames[t], columns[t], n, order_by[t]).withColumn("table_name", F.lit(t)) for t in ordered]
        shared = settled(reduce(DataFrame.unionAll, first))
        short = (F.col("rows") == n) & (F.size("sample") < n)
        parts.append(shared.where(~short).select("table_name", "column_name", "sample"))
        own += [(r[0], r[1]) for r in shared.where(short).select("table_name", "column_name").collect()]  # names only
    for t, c in own:
        one = _own_sample(frames[t], c, n, order_by.get(t, ()))
        parts.append(one.select(F.lit(t).alias("table_name"), "column_name", "sample"))
    return reduce(DataFrame.unionAll, parts)


def column_samples(df: DataFrame, columns: Sequence[str], n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """:func:`table_samples` of a single table, as ``(column_name, sample)``."""
    return table_samples({"": df}, {"": list(columns)}, n, {"": list(order_by)}).drop("table_name")


def pattern_facts(sample: Column, patterns: Mapping[str, str] = BUILTIN_PATTERNS) -> dict[str, Column]:
    """Pattern scores, best pattern, average length and shown values of a sample array."""
    size = F.size(sample)
    names = F.split(F.lit("\n".join(patterns)), "\n")
    tests = F.split(F.lit("\n".join(patterns.values())), "\n")
    share = lambda p: F.when(size > 0, F.size(F.filter(sample, lambda v: F.rlike(v, p))) / size).otherwise(0.0)
    shares = F.transform(tests, share)
    scores = F.map_from_arrays(names, shares)
    top = F.array_max(shares)
    # the first pattern in order wins a tie
    best = F.element_at(names, F.array_position(shares, top).cast("int"))
    total = F.aggregate(sample, F.lit(0).cast("bigint"), lambda acc, v: acc + F.length(v))
    return {
        "pattern_scores": scores,
        "best_pattern": F.when(top > PATTERN_MAJORITY, best),
        "best_score": top,
        "avg_length": F.when(size > 0, total / size),
        "sample_values": F.slice(sample, 1, SHOWN_SAMPLE),
    }


def pattern_counts(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] = BUILTIN_PATTERNS) -> DataFrame:
    """Pattern facts over all non-null values of each column: one aggregate, one scan.

    The columns are those of :func:`pattern_facts`, without ``sample_values``.
    """
    facts = []
    for name in columns:
        text = plain_text(F.col(f"`{name}`"), df.schema[name].dataType)
        hits = F.array(*[F.count_if(F.rlike(text, F.lit(p))) for p in patterns.values()])
        facts.append(F.struct(F.lit(name).alias("column_name"), F.count(text).alias("n"), F.sum(F.length(text)).alias("total"), hits.alias("hits")))
    rows = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    return best_patterns(rows, patterns, ["column_name"])


def best_patterns(rows: DataFrame, patterns: Mapping[str, str], kept: Sequence[str]) -> DataFrame:
    """Pattern facts from ``n`` values, their ``total`` length and the ``hits`` of every pattern."""
    names = F.array(*[F.lit(p) for p in patterns])
    shares = F.transform("hits", lambda h: F.when(F.col("n") > 0, h / F.col("n")).otherwise(0.0))
    rows = rows.withColumn("shares", shares).withColumn("best_score", F.array_max("shares"))
    # the first pattern in order wins a tie
    best = F.element_at(names, F.array_position("shares", F.col("best_score")).cast("int"))
    return rows.select(
        *kept,
        F.map_from_arrays(names, F.col("shares")).alias("pattern_scores"),
        F.when(F.col("best_score") > PATTERN_MAJORITY, best).alias("best_pattern"),
        "best_score",
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avg_length"),
    )


def pattern_profile(
    df: DataFrame, columns: Sequence[str] | None = None, patterns: Mapping[str, str] = BUILTIN_PATTERNS,
    sample_size: int | None = None, order_by: Sequence[str] = (),
) -> DataFrame:
    """Which value pattern the non-null values of each column follow; all of them, or the first ``sample_size``."""
    chosen = list(columns) if columns is not None else [f.name for f in plain_columns(df)]
    if sample_size is None:
        shown = column_samples(df, chosen, SHOWN_SAMPLE, order_by).withColumnRenamed("sample", "sample_values")
        return pattern_counts(df, chosen, patterns).join(shown, "column_name")
    samples = column_samples(df, chosen, sample_size, order_by)
    facts = pattern_facts(F.col("sample"), patterns)
    return samples.select("column_name", *[c.alias(k) for k, c in facts.items()])


def patterns_compatible(best_a: Column, best_b: Column, length_a: Column, length_b: Column) -> Column:
    """Equal patterns where both sides have one, else average lengths within two."""
    both = best_a.isNotNull() & best_b.isNotNull()
    gap = F.abs(F.coalesce(length_a, F.lit(0.0)) - F.coalesce(length_b, F.lit(0.0)))
    return F.when(both, best_a == best_b).otherwise(gap <= 2)


# -- fiscal years -------------------------------------------------------------------------


def year_column_facts(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per column, whether it can be the fiscal-year column; all columns in one aggregate."""
    aliases = {a.lower() for a in (groups or {}).get("exercicio", ())}
    fields = plain_columns(df)
    facts = []
    for i, f in enumerate(fields):
        text = plain_text(F.col(f"`{f.name}`"), f.dataType)
        is_year = text.rlike(YEAR_PATTERN)
        number = F.when(is_year, text.try_cast("int"))
        facts.append(
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(f.name).alias("column_name"),
                F.lit(name_form(f.name, "coverage") in aliases).alias("named"),
                F.count(text).alias("present"),
                F.count_if(is_year).alias("years"),
                F.min(number).alias("first_year"),
                F.max(number).alias("last_year"),
            )
        )
    rows = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    fits = (
        (F.col("present") > 0)
        & (F.col("years") / F.nullif(F.col("present"), F.lit(0)) >= YEAR_COVERAGE)
        & (F.col("first_year") >= YEAR_FIRST)
        & (F.col("last_year") <= YEAR_LAST)
    )
    return rows.withColumn("is_year", F.coalesce(fits, F.lit(False)))


def year_column(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The fiscal-year column as one row: a vocabulary alias first, else the first fitting one."""
    facts = year_column_facts(df, groups).where("named or is_year")
    order = F.struct((~F.col("named")).alias("other"), "ord")
    return facts.agg(F.min_by("column_name", order).alias("year_column"))


def year_distribution(df: DataFrame, column: str) -> DataFrame:
    """``(year, n)`` over four-digit values of a column."""
    text = plain_text(F.col(f"`{column}`"), df.schema[column].dataType)
    years = df.select(text.alias("year")).where(F.col("year").rlike(YEAR_PATTERN))
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def year_map(df: DataFrame, column: str) -> DataFrame:
    """The distribution as one map ``{year: n}``; ten thousand keys at most."""
    entries = F.sort_array(F.collect_list(F.struct("year", "n")))
    return year_distribution(df, column).agg(F.map_from_entries(entries).alias("exercicio_distribution"))
