"""Projections, NULL clean-up, nested-to-text and the row validation gate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_columns(df: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """The declared columns that exist, in declared order; all when none is declared."""
    wanted = list(wanted or [])
    return df.select([c for c in wanted if c in df.columns]) if wanted else df


def filtered_columns(df: DataFrame, leave_out: Iterable[str] = ()) -> list[str]:
    """Column names except a case-insensitive list."""
    dropped = {c.lower() for c in leave_out}
    return [c for c in df.columns if c.lower() not in dropped]


def star(
    df: DataFrame, leave_out: Iterable[str] = (), prefix: str = "", suffix: str = "", alias: str | None = None
) -> list[Column]:
    """Columns to select: all but ``leave_out``, renamed with prefix and suffix."""
    scope = f"{alias}." if alias else ""
    return [F.col(f"{scope}`{c}`").alias(f"{prefix}{c}{suffix}") for c in filtered_columns(df, leave_out)]


def blank_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Empty text becomes NULL in the given (default: all) string columns."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        [
            F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
            if f.name in chosen and isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed projection; values that do not fit become NULL instead of failing the job."""
    return df.select([F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, so a flat store accepts them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    )


def row_faults(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks; an unknown (NULL) outcome is no fault."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def column_rules(df: DataFrame, spec: Mapping[str, Mapping]) -> dict[str, Column]:
    """Rules from a declared schema: ``{"col": {"required": True, "type": "int", "min": 0, "max": 9}}``."""
    rules: dict[str, Column] = {}
    for name, wanted in spec.items():
        if name not in df.columns:
            rules[f"{name}:missing"] = F.lit(False)
            continue
        c = F.col(f"`{name}`")
        if wanted.get("required"):
            rules[f"{name}:required"] = c.isNotNull()
        typed = c
        if "type" in wanted:
            typed = c.try_cast(wanted["type"])
            rules[f"{name}:type"] = c.isNull() | typed.isNotNull()
        if "min" in wanted:
            rules[f"{name}:min"] = typed >= F.lit(wanted["min"])
        if "max" in wanted:
            rules[f"{name}:max"] = typed <= F.lit(wanted["max"])
    return rules


def validation_gate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split a table into rows that keep every rule and rejected rows with their ``faults``."""
    marked = df.withColumn("faults", row_faults(rules))
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def gate_summary(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Accepted and rejected row counts in one pass."""
    broken = F.size(row_faults(rules)) > 0
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~broken).alias("accepted"),
        F.count_if(broken).alias("rejected"),
    )
