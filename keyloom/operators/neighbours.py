"""Next value within a group when one group may hold much of the table.

``lead``/``lag`` over a plain window sort a whole group in one task.  Here rows are dealt out by
ranges of (group, value), which Spark samples itself; a window runs inside each range, and the
first value a group has in a range is handed to the range where it came before.  No task
sees a whole group, whatever its size, and there is one plan at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.session import settled


def with_next(df: DataFrame, groups: Sequence[str], value: str, out: str = "next") -> DataFrame:
    """Add ``out = struct(v)`` holding the following value of ``value`` within its group.

    ``df`` must hold each (group, value) once; NULL counts as the last value, NaN as the last
    number.  ``out`` is NULL exactly for the last value of a group, while ``out.v`` is NULL when
    the following value is the NULL one.
    """
    groups = list(groups)
    v = F.col(f"`{value}`")
    order = [F.col(f"`{g}`").asc_nulls_first() for g in groups] + [v.asc_nulls_last()]
    # written once: the ranges are sampled, and both uses below must see the same ones
    ranged = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")

    least = F.min_by(v, F.struct(v.isNull(), v)).alias(value)
    firsts = ranged.groupBy(*groups, "__range").agg(least)
    # a group has at most one row per range from here on
    before = F.lag("__range").over(Window.partitionBy(*groups).orderBy("__range"))
    handed = firsts.withColumn("__range", before).where(F.col("__range").isNotNull())

    # the handed value comes after every value of the range it is handed to
    guests = handed.select(*[F.col(f"`{g}`") for g in groups], "__range", F.col(f"`{value}`"), F.lit(True).alias("__guest"))
    both = ranged.withColumn("__guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    inside = Window.partitionBy(*groups, "__range").orderBy("__guest", v.asc_nulls_last())
    return both.withColumn(out, F.lead(F.struct(v.alias("v"))).over(inside)).where("NOT __guest").drop("__range", "__guest")
