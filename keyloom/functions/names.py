"""Column-name forms, usable on schema names and on name columns alike.

Each form is a short list of regular-expression steps after lower-casing, so the
driver-side and the ``Column`` versions cannot drift apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TRIM = (r"^\s+|\s+$", "")

FORMS: dict[str, list[tuple[str, str]]] = {
    # staged tables: keep underscores, everything else becomes one
    "staged": [_TRIM, (r"[^a-z0-9_]", "_")],
    # name matching: runs collapse and the ends are trimmed
    "match": [_TRIM, (r"[^a-z0-9]", "_"), (r"_+", "_"), (r"^_+|_+$", "")],
    # vocabulary coverage: one underscore per replaced character
    "coverage": [_TRIM, (r"[^a-z0-9]", "_")],
    # identifiers from free text: blanks and dashes join words, no leading digit
    "slug": [(r"[ -]+", "_"), (r"[^a-z0-9_]+", ""), (r"^(?=[0-9])", "_")],
}

_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])"


def name_form(name: str, form: str, snake: bool = False) -> str:
    """One of :data:`FORMS` applied to a schema name; ``snake`` splits camelCase first."""
    if snake:
        name = re.sub(_CAMEL, "_", name)
    name = name.lower()
    for pattern, replacement in FORMS[form]:
        name = re.sub(pattern, replacement, name)
    return name


def name_form_col(name: Column, form: str, snake: bool = False) -> Column:
    """The same rule as :func:`name_form` for names held in a column."""
    if snake:
        name = F.regexp_replace(name, _CAMEL, "_")
    name = F.lower(name)
    for pattern, replacement in FORMS[form]:
        name = F.regexp_replace(name, pattern, replacement)
    return name


def rename_columns(df: DataFrame, form: str = "staged", snake: bool = False) -> DataFrame:
    """Rename every column of a table; two names falling together is an error."""
    names = [name_form(c, form, snake) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names fall together after renaming: {twice}")
    return df.toDF(*names)
