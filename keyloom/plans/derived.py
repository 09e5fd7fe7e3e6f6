"""Search for the transforms that make two columns join: pads, strips, digits, substrings.

All forms of all values meet in one grouping.  A value text collects how many rows of A give
it under each transform, and the bit set of transforms under which B holds it; the rates of
all pairs of transforms are read off those rows.  Nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.strings import digits, match_text, pad_left, strip_zeros

Transform = Callable[[Column], Column]


def default_transforms(pads: tuple[int, ...] = (6, 9), cuts: tuple[int, ...] = (4, 6)) -> dict[str, Transform]:
    """Named text transforms, the simpler first."""
    out: dict[str, Transform] = {"as_is": lambda c: c, "digits": digits, "no_leading_zeros": strip_zeros, "digits_no_leading_zeros": lambda c: strip_zeros(digits(c))}
    for n in pads:
        out[f"pad_{n}"] = lambda c, n=n: pad_left(c, n)
    for n in cuts:
        out[f"first_{n}"] = lambda c, n=n: F.when(F.length(c) > n, F.substring(c, 1, n))
        out[f"last_{n}"] = lambda c, n=n: F.when(F.length(c) > n, F.substring(c, -n, n))
    return out


def derived_key_search(a: DataFrame, column_a: str, b: DataFrame, column_b: str, transforms: Mapping[str, Transform] | None = None) -> DataFrame:
    """(transform_a, transform_b, rows_a, hits, match_rate, rank) for every pair of transforms with a hit.

    ``match_rate`` is the share of A's non-null rows whose transformed value B holds,
    transformed likewise.  Values are taken in match form first; one that a transform leaves empty
    matches nothing.  Of equal rates the simpler pair ranks first.  Up to 63 transforms.
    """
    transforms = dict(transforms or default_transforms())
    names = list(transforms)

    def forms(df: DataFrame, column: str) -> DataFrame:
        text = match_text(F.col(f"`{column}`"), df.schema[column].dataType).alias("v")
        counted = df.select(text).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        listed = F.array(*[F.struct(F.lit(i).alias("t"), F.nullif(transforms[name](F.col("v")), F.lit("")).alias("form")) for i, name in enumerate(names)])
        return counted.select("n", F.explode(listed).alias("x")).select("n", "x.t", "x.form").where("form IS NOT NULL")

    left = forms(a, column_a).select("form", *[F.when(F.col("t") == i, F.col("n")).otherwise(0).alias(f"n{i}") for i in range(len(names))], F.lit(0).cast("long").alias("held"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t"))
    right = forms(b, column_b).select("form", *[F.lit(0).cast("long").alias(f"n{i}") for i in range(len(names))], bit.alias("held"))
    met = left.unionAll(right).groupBy("form").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))], F.bit_or("held").alias("held"))

    hits = lambda i, j: F.sum(F.when(F.call_function("bit_get", F.col("held"), F.lit(j)) == 1, F.col(f"n{i}")).otherwise(0))
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    one = met.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), hits(i, j).alias("hits")) for i, j in pairs]).alias("found"))
    rows = a.agg(F.count(F.col(f"`{column_a}`")).alias("rows_a"))
    listed = F.array(*[F.lit(n) for n in names])
    found = one.select(F.explode("found").alias("f")).select("f.*").where("hits > 0").join(rows.hint("broadcast"), F.lit(True))  # a single row
    order = F.struct((-F.col("hits")).alias("h"), (F.col("i") + F.col("j")).alias("s"), F.col("i"))
    scored = found.select(F.get(listed, F.col("i")).alias("transform_a"), F.get(listed, F.col("j")).alias("transform_b"), "rows_a", "hits", (F.col("hits") / F.col("rows_a")).alias("match_rate"), order.alias("o"))
    # as many rows as pairs of transforms
    return scored.groupBy().agg(F.sort_array(F.collect_list(F.struct("o", "transform_a", "transform_b", "rows_a", "hits", "match_rate"))).alias("all")).select(
        F.posexplode("all").alias("at", "x")
    ).select("x.transform_a", "x.transform_b", "x.rows_a", "x.hits", "x.match_rate", (F.col("at") + 1).alias("rank"))
