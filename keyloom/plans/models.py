"""The modelled tables: enriched commitments and the execution panel, by column name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.joins import enrich, match_rate


def enriched(facts: DataFrame, finance: DataFrame, on: dict[str, str], fact_columns: Sequence[str], finance_columns: Sequence[str]) -> DataFrame:
    """Facts with finance attributes on a composite key; facts without a match stay."""
    return enrich(facts.select(*dict.fromkeys([*fact_columns, *on])), finance, on, finance_columns).select(
        *fact_columns, *finance_columns
    )


def execution_panel(
    facts: DataFrame,
    plans: DataFrame,
    key: dict[str, str],
    groups: dict[str, str],
    document: str,
    amount: Column,
    plan_id: str,
    names: tuple[str, str, str] = ("qtd_empenhos", "total_empenhado", "qtd_planos_acao"),
) -> DataFrame:
    """Documents, amount and linked plans per group; the amount counts once per linked plan.

    Asking for two distinct counts at once would copy every joined row per count.  Documents
    do not depend on the join, so they are counted on the facts alone; plans are counted by
    grouping on (group, plan) first, which adds the amounts up along the way.
    """
    (left_key, right_key), = key.items()
    named = [F.col(c).alias(n) for n, c in groups.items()]
    documents = facts.groupBy(*named).agg(F.count_distinct(document).alias(names[0]))
    picked = facts.select(*named, F.col(left_key).alias("__left"), amount.alias("__amount"))
    linked = plans.select(F.col(right_key).alias("__key"), F.col(plan_id).alias("__plan"))
    per_plan = (
        picked.join(linked, F.col("__left") == F.col("__key"), "left")
        .groupBy(*groups, "__plan")
        .agg(F.sum("__amount").alias("__amount"))
    )
    totals = per_plan.groupBy(*[F.col(n).alias(f"__{n}") for n in groups]).agg(
        F.sum("__amount").alias(names[1]), F.count("__plan").alias(names[2])
    )
    same_group = [documents[n].eqNullSafe(totals[f"__{n}"]) for n in groups]
    return documents.join(totals, same_group).select(*groups, *names)


def derived_key_rate(
    a: DataFrame,
    column_a: str,
    b: DataFrame,
    column_b: str,
    transform_a: Callable[[Column], Column] | None = None,
    transform_b: Callable[[Column], Column] | None = None,
    by_a: Column | None = None,
    by_b: Column | None = None,
) -> DataFrame:
    """Match rate of a column pair before and after transforming one or both sides.

    With ``by_a`` and ``by_b`` the rates are given per fiscal year.
    """
    same = lambda c: c
    ta, tb = transform_a or same, transform_b or same
    grouped = by_a is not None and by_b is not None
    before = match_rate(a, column_a, b, column_b, by_a=by_a, by_b=by_b)
    year_a = [by_a.alias("__by")] if grouped else []
    year_b = [by_b.alias("__by")] if grouped else []
    ka = a.select(ta(F.col(column_a)).alias("k"), *year_a)
    kb = b.select(tb(F.col(column_b)).alias("k"), *year_b)
    by = F.col("__by") if grouped else None
    after = match_rate(ka, "k", kb, "k", by_a=by, by_b=by)
    if grouped:
        return before.select("by", "rows_a", F.col("match_rate").alias("rate_before")).join(
            after.select("by", F.col("match_rate").alias("rate_after")), "by"
        )
    # two one-row results side by side
    tagged = before.select(F.lit("before").alias("step"), "match_rate", "rows_a").unionAll(
        after.select(F.lit("after").alias("step"), "match_rate", "rows_a")
    )
    pick = lambda s, c: F.max(F.when(F.col("step") == s, F.col(c)))
    return tagged.agg(
        pick("before", "rows_a").alias("rows_a"), pick("before", "match_rate").alias("rate_before"), pick("after", "match_rate").alias("rate_after")
    )
