"""Landed pages of JSON responses.

Pages are read as VARIANT, so no scan infers a schema and pages may differ in shape; the types
of what is asked for come from one aggregate over just that part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_FILE = "__page_file"


def read_pages(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame:
    """One row per page: a file each, or with ``lines`` a line each; top-level fields are columns.

    Without a schema the columns are the fields of all pages together, NULL where a page lacks
    one; a field of several shapes (a list here, an object there) stays a VARIANT.
    """
    reader = spark.read.option("multiLine", not lines)
    file = F.col("_metadata.file_name").alias(PAGE_FILE)
    if schema is not None:
        return reader.schema(schema).json(path).select("*", file)
    pages = reader.option("singleVariantColumn", "body").json(path).select("body", file)
    kind = _merged_type(pages, F.col("body"))
    if not isinstance(kind, T.StructType):
        return pages
    return pages.select(F.variant_get("body", "$", _ddl(kind)).alias("p"), PAGE_FILE).select("p.*", PAGE_FILE)


def _merged_type(df: DataFrame, value: Column) -> T.DataType | None:
    """Type of a VARIANT column over all rows; None where it has no value."""
    found = df.agg(F.schema_of_variant_agg(value)).head()[0]
    if found is None or found == "VOID":
        return None
    # whole numbers are BIGINT; others come as decimals of the digits seen, and a field that is always null as VOID
    plain = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    return T.DataType.fromDDL(plain)


def _ddl(kind: T.DataType) -> str:
    return kind.simpleString()


def page_records(pages: DataFrame, records_path: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Flat rows under the dot path: a list gives its elements, an object gives itself.

    A page without the path gives no rows.  Where the path leads into a VARIANT, the record's
    columns are those of all records together, unless a ``schema`` says which.
    """
    if not records_path:
        return pages.drop(PAGE_FILE)
    data_type: T.DataType = pages.schema
    keys = records_path.split(".")
    for depth, key in enumerate(keys):
        if isinstance(data_type, T.VariantType):
            break
        data_type = data_type[key].dataType
    else:
        depth = len(keys)
    found = F.col(".".join(f"`{k}`" for k in keys[:depth]))
    if isinstance(data_type, T.VariantType):
        return _variant_records(pages, found, keys[depth:], schema)
    if isinstance(data_type, T.ArrayType):
        rows = pages.select(F.explode(found).alias("r"))
        data_type = data_type.elementType
    else:
        rows = pages.select(found.alias("r")).where("r is not null")
    return rows.select("r.*") if isinstance(data_type, T.StructType) else rows.withColumnRenamed("r", "value")


def _variant_records(pages: DataFrame, found: Column, keys: list[str], schema: str | T.StructType | None) -> DataFrame:
    path = "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)
    at = F.try_variant_get(found, path, "variant")
    listed = F.try_variant_get(found, path, "array<variant>")
    one = F.when(at.isNotNull() & ~F.is_variant_null(at), F.array(at))
    rows = pages.select(F.explode(F.coalesce(listed, one)).alias("r"))
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or _merged_type(rows, F.col("r"))
    if kind is None:
        return rows.select(F.lit(None).cast("string").alias("value")).limit(0)
    typed = rows.select(F.try_variant_get("r", "$", _ddl(kind)).alias("r"))
    return typed.select("r.*") if isinstance(kind, T.StructType) else typed.withColumnRenamed("r", "value")


def page_completeness(pages: DataFrame, page: str, has_more: str) -> DataFrame:
    """Whether the pages 1..n are all there and only the last one says there are no more."""
    last = ~F.coalesce(F.col(has_more).cast("boolean"), F.lit(False))
    got = pages.agg(
        F.max(page).cast("bigint").alias("last_page"),
        F.count_distinct(page).alias("pages"),
        F.count_if(last).alias("final_pages"),
        F.max(F.when(last, F.col(page))).cast("bigint").alias("final_page"),
    )
    whole = (F.col("pages") == F.col("last_page")) & (F.col("final_pages") == 1) & (F.col("final_page") == F.col("last_page"))
    return got.withColumn("complete", F.coalesce(whole, F.lit(False)))
