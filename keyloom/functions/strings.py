"""Text functions: match normalisation, code padding, keys, URLs, identifiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a NULL contributes to a surrogate key.
NULL_KEY_TEXT = "_dbt_utils_surrogate_key_null_"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL + _FRACTIONAL)


def plain_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a value; whole doubles and decimals read like integers (``1.0`` -> ``1``)."""
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, _FRACTIONAL):
        whole = c.try_cast("bigint")
        return F.when(whole == c, whole.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def normalize_text(c: Column) -> Column:
    """Match form of a text value: trim, upper-case, delete ``. - /`` and blanks."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[.\-/\s]", "")


def match_text(c: Column, data_type: T.DataType) -> Column:
    """Match form of a value of any simple type; numbers keep their punctuation."""
    text = plain_text(c, data_type)
    return F.trim(text) if is_numeric(data_type) else normalize_text(text)


def pad_left(c: Column, width: int) -> Column:
    """Zero-pad a code to ``width``; longer values stay whole, a sign stays in front."""
    c = F.trim(c.cast("string"))
    signed = F.substring(c, 1, 1).isin("-", "+")
    padded_rest = F.lpad(c.substr(F.lit(2), F.length(c)), max(width - 1, 0), "0")
    return (
        F.when(F.length(c) >= width, c)
        .when(signed, F.concat(F.substring(c, 1, 1), padded_rest))
        .otherwise(F.lpad(c, width, "0"))
    )


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "^0+", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def concat_columns(columns: Iterable[Column], sep: str = "", null_text: str | None = "nan") -> Column:
    """Join columns as text; NULL reads ``null_text``, or is left out when that is None."""
    texts = [c.cast("string") for c in columns]
    if null_text is not None:
        texts = [F.coalesce(t, F.lit(null_text)) for t in texts]
    return F.concat_ws(sep, *texts)


def surrogate_key(columns: Iterable[Column], null_text: str = NULL_KEY_TEXT) -> Column:
    """MD5 over the ``-``-joined texts; pass ``null_text=''`` for the older definition."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(null_text)) for c in columns]))


def _without_scheme(url: Column, schemes: Iterable[str]) -> Column:
    for scheme in schemes:
        url = F.replace(url, F.lit(scheme), F.lit(""))
    return url


def url_host(url: Column) -> Column:
    """Host: scheme removed, cut at the first ``/`` and then at the first ``?``."""
    bare = _without_scheme(url, ("android-app://", "http://", "https://"))
    return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def url_path(url: Column) -> Column:
    """Text after the first ``/`` behind the scheme, cut at ``?``, without leading slash.

    A text with no ``/`` keeps what follows the ``?`` cut rule: query-only gives an
    empty text, and a bare host is returned whole.
    """
    bare = _without_scheme(url, ("http://", "https://"))
    slash = F.instr(bare, "/")
    query = F.instr(bare, "?")
    start = F.when(slash > 0, slash).when(query > 0, query - 1).otherwise(F.lit(0))
    rest = bare.substr(start + 1, F.length(bare))
    return F.split_part(rest, F.lit("?"), F.lit(1))


def url_parameter(url: Column, name: str) -> Column:
    """Text after the first ``name=`` up to ``&``; NULL when absent or empty."""
    after = F.split_part(url, F.lit(f"{name}="), F.lit(2))
    return F.nullif(F.split_part(after, F.lit("&"), F.lit(1)), F.lit(""))


def any_match(c: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern the value matches, NULL when none does."""
    tests = [F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()]
    return F.coalesce(*tests)


# Structured budget identifiers: unit 6, management 5, year 4, type 2, sequence 6.
# Fixed value: the layout below.
LONG_IDENTIFIER = r"^(\d{6})(\d{5})(\d{4})([A-Z]{2})(\d{6})$"
SHORT_IDENTIFIER = r"^(\d{4})([A-Z]{2})(\d{6})$"


def _group_or_null(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_identifier(c: Column) -> Column:
    """Struct of the five parts of a long identifier; all NULL when it is none."""
    parts = ("unit", "management", "year", "kind", "sequence")
    return F.struct(*[_group_or_null(c, LONG_IDENTIFIER, i + 1).alias(p) for i, p in enumerate(parts)])


def shorten_identifier(c: Column) -> Column:
    """Short form ``YYYY`` + type + sequence of a long identifier."""
    long_parts = [_group_or_null(c, LONG_IDENTIFIER, i) for i in (3, 4, 5)]
    return F.concat(*long_parts)


def extend_identifier(short: Column, unit: Column, management: Column) -> Column:
    """Long form rebuilt from a short identifier and its unit and management codes."""
    valid = F.when(short.rlike(SHORT_IDENTIFIER), short)
    return F.concat(pad_left(unit, 6), pad_left(management, 5), valid)
