"""Keyed merges and incremental loads, as pure table-to-table functions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.relational import latest_per_key
from keyloom.session import settled


def _same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    tests = [a[k].eqNullSafe(b[k]) if null_safe else a[k] == b[k] for k in keys]
    return reduce(lambda x, y: x & y, tests)


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``: missing ones as typed NULL, surplus ones gone."""
    return df.select(
        [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema]
    )


def merge_latest(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None, null_safe: bool = False
) -> DataFrame:
    """Replace rows of ``target`` by key and add new ones; incoming wins.

    With ``order``, several updates for one key are first reduced to the first under it.
    The result has the columns of ``updates``: new columns appear and dropped ones leave.
    """
    if order is not None:
        updates = latest_per_key(updates, keys, order)
    stay = target.join(updates, _same_keys(target, updates, keys, null_safe), "left_anti")
    return align(stay, updates).unionAll(updates)


def merge_greatest(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    greatest: str,
    keep: Sequence[str] = (),
    stamp: dict[str, Column] | None = None,
) -> DataFrame:
    """Upsert that keeps the greater ``greatest`` value and overwrites the other fields.

    ``keep`` columns stay as the target has them on a match, ``stamp`` columns are set on
    a match only.  Of several updates for a key the one with the greatest ``greatest`` counts
    (ties: by the other columns).  A full outer join on the keys needs one shuffle of each side.
    """
    stamp = stamp or {}
    rest = [F.col(f"`{f.name}`").asc_nulls_last() for f in updates.schema if f.name not in keys and f.name != greatest and not isinstance(f.dataType, T.MapType)]
    updates = latest_per_key(updates, keys, [F.col(greatest).desc_nulls_last(), *rest])
    u = updates.select([F.col(f"`{c}`").alias(f"__u_{c}") for c in updates.columns] + [F.lit(True).alias("__u")])
    mine = target.withColumn("__t", F.lit(True))
    joined = mine.join(u, [mine[k] == u[f"__u_{k}"] for k in keys], "full")
    has_t, has_u = F.col("__t").isNotNull(), F.col("__u").isNotNull()
    out = []
    for f in target.schema:
        mine = F.col(f"`{f.name}`")
        new = F.col(f"__u_{f.name}").cast(f.dataType) if f.name in updates.columns else F.lit(None).cast(f.dataType)
        if f.name in keys:
            value = F.coalesce(mine, new)
        elif f.name == greatest:
            value = F.greatest(mine, new)
        elif f.name in stamp:
            value = F.when(has_t & has_u, stamp[f.name]).when(has_t, mine).otherwise(new)
        elif f.name in keep or f.name not in updates.columns:
            value = F.when(has_t, mine).otherwise(new)
        else:
            value = F.when(has_u, new).otherwise(mine)
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(out)


def newer_rows(source: DataFrame, target: DataFrame | None, stamp: str, lookback: timedelta | None = None) -> DataFrame:
    """Rows of ``source`` above the high-water mark of ``target``.

    The mark is read first, so the comparison is with a literal and prunes row groups of
    the source scan.  Late rows and rows without a stamp are left out unless ``lookback``
    lowers the mark; a missing or empty target takes the whole source.
    """
    if target is None:
        return source
    mark = target.agg(F.max(stamp).alias("mark")).head()["mark"]
    if mark is None:
        return source
    if lookback is not None:
        mark = mark - lookback
    return source.where(F.col(stamp) > F.lit(mark).cast(source.schema[stamp].dataType))


def incremental_merge(
    source: DataFrame,
    target: DataFrame | None,
    keys: Sequence[str],
    stamp: str,
    order: Sequence[Column] | None = None,
    lookback: timedelta | None = None,
) -> DataFrame:
    """Full new state of ``target`` after one incremental run.

    First run: the whole source.  Later: newer rows replace target rows by key; several
    newer rows of one key leave the one with the latest stamp.  Columns follow the source.
    """
    order = list(order) if order is not None else [F.col(stamp).desc_nulls_last()]
    fresh = newer_rows(source, target, stamp, lookback)
    if target is None:
        return fresh
    return merge_latest(target, fresh, keys, order)


def merge_touched_partitions(path: str, updates: DataFrame, keys: Sequence[str], partition: str, order: Sequence[Column] | None = None) -> None:
    """Upsert into a Parquet table partitioned by ``partition``, rewriting touched partitions only.

    A key must always fall in the same partition (``partition`` is a key, or follows from
    one).  The new partitions are written aside before they replace the old ones, so
    nothing is overwritten while it is read.
    """
    spark = updates.sparkSession
    if order is not None:
        updates = latest_per_key(updates, keys, order)
    updates = settled(updates, "updates")
    touched = [r[0] for r in updates.select(partition).distinct().collect()]  # partition values only
    if not touched:
        return
    target = spark.read.parquet(path)
    old = target.where(F.col(partition).isin([v for v in touched if v is not None]))
    if None in touched:
        old = old.unionAll(target.where(F.col(partition).isNull()))
    merged = settled(merge_latest(old, align(updates, target), keys), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
