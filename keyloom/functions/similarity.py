"""Name similarity and column-type compatibility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.names import name_form_col


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _longest_block(x: Column, y: Column, part: Column) -> Column:
    """(k, i, j): length of the longest common block of a part of two texts and its negated places.

    Of several the one that begins first in ``x``, then in ``y``.  One row of match lengths is
    carried from character to character of ``x``.
    """
    others = F.slice(y, part["bl"] + 1, part["bh"] - part["bl"])

    def along(s: Column, c: Column) -> Column:
        row = F.transform(others, lambda d, t: F.when(c == d, F.coalesce(F.get(s["row"], t - 1), F.lit(0)) + 1).otherwise(F.lit(0)))
        ends = lambda r: F.transform(r, lambda k, t: F.struct(k.alias("k"), (k - s["at"] - 1).alias("i"), (k - part["bl"] - t - 1).alias("j")))
        return _bound(row, lambda r: F.struct((s["at"] + 1).alias("at"), r.alias("row"), F.greatest(s["best"], F.array_max(ends(r))).alias("best")))

    none = F.struct(F.lit(0).alias("k"), F.lit(-(2**31) + 1).alias("i"), F.lit(0).alias("j"))
    start = F.struct(part["al"].alias("at"), F.array().cast("array<int>").alias("row"), none.alias("best"))
    return F.aggregate(F.slice(x, part["al"] + 1, part["ah"] - part["al"]), start, along, lambda s: s["best"])


def _matched(x: Column, y: Column) -> Column:
    """Characters in common blocks: the longest one, then those to its left and right, and so on.

    Parts still to be looked at wait in a list; every block leaves two at most.
    """
    part = lambda al, ah, bl, bh: F.struct(al.alias("al"), ah.alias("ah"), bl.alias("bl"), bh.alias("bh"))
    zero = F.lit(0)

    def step(s: Column, _: Column) -> Column:
        def split(p: Column, m: Column) -> Column:
            i, j = -m["i"], -m["j"]
            sides = F.array(part(p["al"], i, p["bl"], j), part(i + m["k"], p["ah"], j + m["k"], p["bh"]))
            more = F.filter(sides, lambda z: (m["k"] > 0) & (z["al"] < z["ah"]) & (z["bl"] < z["bh"]))
            return F.struct(F.concat(F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1), more).alias("todo"), (s["n"] + m["k"]).alias("n"))

        look = _bound(F.element_at(s["todo"], -1), lambda p: _bound(_longest_block(x, y, p), lambda m: split(p, m)))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(look)

    start = F.struct(F.array(part(zero, F.size(x), zero, F.size(y))).alias("todo"), zero.alias("n"))
    steps = F.sequence(F.lit(0), 2 * F.least(F.size(x), F.size(y)))
    return F.aggregate(steps, start, step, lambda s: s["n"])


def text_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts: twice the characters in common blocks by all characters."""
    total = lambda x, y: F.size(x) + F.size(y)
    ratio = lambda x, y: F.when(total(x, y) == 0, F.lit(1.0)).otherwise(2.0 * _matched(x, y) / total(x, y))
    scored = _bound(_characters(a), lambda x: _bound(_characters(b), lambda y: ratio(x, y)))
    return F.when(a == b, F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), scored)


def name_similarity(a: Column, b: Column) -> Column:
    """Ratio of two column names in match form; work grows with the product of their lengths."""
    return text_ratio(name_form_col(a, "match"), name_form_col(b, "match"))


# Fixed value: score two names of one vocabulary group reach at least.
SAME_GROUP_SCORE = 0.75


def semantic_score(similarity: Column, group_a: Column, group_b: Column) -> Column:
    """Similarity, raised when both names belong to the same vocabulary group."""
    return F.when(group_a == group_b, F.greatest(similarity, F.lit(SAME_GROUP_SCORE))).otherwise(similarity)


# Which right-hand type families a left-hand family accepts.
COMPATIBLE = {
    "object": ("object", "category"),
    "int64": ("int64", "int32", "float64", "object"),
    "float64": ("float64", "int64", "object"),
    "category": ("category", "object"),
}


def type_family(data_type: T.DataType) -> str:
    """Type family of a column; types outside the four families stand for themselves."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(data_type, T.StringType):
        return "object"
    return data_type.simpleString()


def types_compatible(family_a: Column, family_b: Column) -> Column:
    """Whether the right type fits the left one; the relation has a direction."""
    test = family_a == family_b
    for family, accepted in COMPATIBLE.items():
        test = test | ((family_a == family) & family_b.isin(*accepted))
    return test


def cardinality_label(uniqueness: Column) -> Column:
    # Thresholds and labels.
    return (
        F.when(uniqueness > 0.95, "high (near-unique)")
        .when(uniqueness > 0.5, "medium")
        .otherwise("low (repetitive)")
    )
