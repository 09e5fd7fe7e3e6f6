"""Many checks on one table, one result row per check.

Checks that look at one row at a time are counted together in a single aggregate over a
single scan; the rest keep their own plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators import checks


@dataclass
class RowRule:
    """A row-local rule; a row fails when the condition is false (unknown passes)."""

    name: str
    column: str | None
    condition: Column
    where: str | None = None
    warn_if: str = "> 0"
    error_if: str = "> 0"
    severity: str = "error"


@dataclass
class TableRule:
    """A check with its own plan: failing rows or a :class:`checks.Check`."""

    name: str
    column: str | None
    check: DataFrame | checks.Check
    warn_if: str = "> 0"
    error_if: str = "> 0"
    severity: str = "error"


def _status(rule: RowRule | TableRule, failures: Column) -> Column:
    """``fail`` past the error threshold (unless the rule only warns), else ``warn``, else ``pass``."""
    count = f"__failures {{}}"
    past = lambda threshold: F.expr(count.format(threshold))
    warn = F.when(past(rule.warn_if), "warn").otherwise("pass")
    return warn if rule.severity == "warn" else F.when(past(rule.error_if), "fail").otherwise(warn)


def run_suite(df: DataFrame, rules: Sequence[RowRule | TableRule]) -> DataFrame:
    """Rows ``(check, column, failures, status)`` for all rules."""
    local = [r for r in rules if isinstance(r, RowRule)]
    parts = []
    if local:
        counts = [
            F.count_if(~r.condition & (F.expr(r.where) if r.where else F.lit(True))).alias(f"c{i}") for i, r in enumerate(local)
        ]
        one = df.agg(*counts)
        parts.append(
            one.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(next(k for k, x in enumerate(rules) if x is r)).alias("__rule"), F.lit(r.name).alias("check"), F.lit(r.column).cast("string").alias("column"), F.col(f"c{i}").alias("__failures"))
                            for i, r in enumerate(local)
                        ]
                    )
                ).alias("r")
            ).select("r.*")
        )
    for k, r in enumerate(rules):
        if isinstance(r, TableRule):
            check = r.check if isinstance(r.check, checks.Check) else checks.Check(r.check)
            parts.append(
                check.failures().select(
                    F.lit(k).alias("__rule"), F.lit(r.name).alias("check"), F.lit(r.column).cast("string").alias("column"), F.col("failures").alias("__failures")
                )
            )
    counted = reduce(DataFrame.unionAll, parts)
    status = F.lit(None).cast("string")
    for k, r in enumerate(rules):
        status = F.when(F.col("__rule") == k, _status(r, F.col("__failures"))).otherwise(status)
    return counted.select("check", "column", F.col("__failures").cast("bigint").alias("failures"), status.alias("status"))
