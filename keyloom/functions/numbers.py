"""Null-safe arithmetic, buckets, distance and date arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zeroed(columns: Sequence[Column]) -> list[Column]:
    if not columns:
        raise ValueError("at least one column is needed")
    return [F.coalesce(c, F.lit(0)) for c in columns]


def safe_add(columns: Sequence[Column]) -> Column:
    """Sum of the columns with NULL counted as zero."""
    return reduce(lambda x, y: x + y, _zeroed(columns))


def safe_subtract(columns: Sequence[Column]) -> Column:
    """First column minus the rest with NULL counted as zero."""
    return reduce(lambda x, y: x - y, _zeroed(columns))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """True division, NULL on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def width_bucket(value: Column, low: Column, high: Column, buckets: Column) -> Column:
    """Equal-width bucket 1..n; 0 below ``low`` and n+1 from ``high`` on."""
    return F.width_bucket(value.cast("double"), low.cast("double"), high.cast("double"), buckets)


# Earth radius in miles and kilometres per mile.
RADIUS_MILES = 3961.0
KM_PER_MILE = 1.60934


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "mi") -> Column:
    """Great-circle distance between two points given in degrees."""
    if unit not in ("mi", "km"):
        raise ValueError(f"unit must be 'mi' or 'km', got {unit!r}")
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = (phi2 - phi1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_lon), 2)
    radius = RADIUS_MILES * (KM_PER_MILE if unit == "km" else 1.0)
    return F.lit(2 * radius) * F.asin(F.sqrt(chord))


def date_add(part: str, n: int | Column, c: Column) -> Column:
    """``c`` moved by ``n`` date parts (keeps the timestamp flavour of ``c``)."""
    return F.timestamp_add(part.upper(), F.lit(n) if isinstance(n, int) else n, c)


def date_diff(part: str, start: Column, end: Column) -> Column:
    """Boundaries of ``part`` crossed between two moments."""
    return F.timestamp_diff(part.upper(), F.date_trunc(part, start), F.date_trunc(part, end))


def date_trunc(part: str, c: Column) -> Column:
    return F.date_trunc(part, c)


def fixed_text(x: Column, places: int) -> Column:
    """A number from 0 on with so many decimals, rounded as its exact binary value says, ties to even.

    ``format_string`` rounds the shortest decimal text half up, which differs where that
    text ends in 5.  The value is scaled by a power of two to a whole number first, which is exact.
    """
    x = x.cast("double")
    k = (61 - F.floor(F.log2(F.greatest(x, F.lit(1.0))))).cast("int")
    scaled, one = (x * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(20,0)"), F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(20,0)")
    wide = scaled * F.lit(10**places).cast("decimal(6,0)")
    whole, rest = F.call_function("div", wide, one), (wide % one) * 2
    up = (rest > one) | ((rest == one) & (whole % 2 == 1))
    n = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.call_function("div", n, F.lit(10**places)).cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))
