"""Raw zone, staged tables, load catalog, table lookup, metadata, samples and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.names import name_form, rename_columns
from keyloom.functions.strings import plain_text
from keyloom.operators.profile import column_samples, plain_columns
from keyloom.session import small_table


# -- raw zone -----------------------------------------------------------------------------


# Fixed value: the form of a raw path.
def raw_path(root: str, source: str, day: date, name: str) -> str:
    return f"{root}/raw/{source}/{day.isoformat()}/{name}"


def write_raw(df: DataFrame, root: str, source: str, name: str, day: date | None = None) -> str:
    """Write a table once; an existing path is an error, raw data is never replaced."""
    path = raw_path(root, source, day or date.today(), name)
    df.write.mode("errorifexists").parquet(path)
    return path


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_artefacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files with path, size and content; unused content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


# -- staged tables ------------------------------------------------------------------------


# Fixed value: the form of a staged name.
def staged_name(source: str, day: date | None = None) -> str:
    return f"{name_form(source, 'staged')}_{(day or date.today()):%Y%m%d}"


def stage(df: DataFrame, root: str, source: str, day: date | None = None, snake: bool = False) -> str:
    """Write a staged table with normalised column names, replacing the day's earlier one."""
    name = staged_name(source, day)
    rename_columns(df, "staged", snake).write.mode("overwrite").parquet(f"{root}/{name}")
    return name


def read_staged(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def list_staged(spark: SparkSession, root: str) -> list[str]:
    """Names of the staged tables under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


# -- load catalog -------------------------------------------------------------------------


def record_load(spark: SparkSession, path: str, source: str, table: str, schema: str, rows: int, quality_ok: bool, at: Column | None = None) -> None:
    """Append one row for a finished load."""
    row = small_table(spark, 
        [(source, table, schema, rows, quality_ok)],
        "source_name string, table_name string, schema_name string, row_count bigint, quality_ok boolean",
    )
    row.withColumn("loaded_at", F.current_timestamp() if at is None else at).coalesce(1).write.mode("append").parquet(path)


def usable_tables(catalog: DataFrame) -> DataFrame:
    """Latest good load of each table."""
    good = catalog.where("quality_ok")
    newest = F.max_by(F.struct("source_name", "row_count", "loaded_at"), "loaded_at").alias("r")
    return good.groupBy("schema_name", "table_name").agg(newest).select("schema_name", "table_name", "r.*")


def find_tables(tables: DataFrame, schema_pattern: str, table_pattern: str, exclude: str = "") -> DataFrame:
    """Rows of ``(table_schema, table_name)`` whose names fit case-insensitive LIKE patterns."""
    hit = F.col("table_schema").ilike(schema_pattern) & F.col("table_name").ilike(table_pattern)
    return tables.where(hit & ~F.col("table_name").ilike(exclude)).distinct()


def find_tables_by_prefix(tables: DataFrame, schema: str, prefix: str, exclude: str = "") -> DataFrame:
    return find_tables(tables, schema, f"{prefix}%", exclude)


def catalog_tables(spark: SparkSession) -> DataFrame:
    """The session's tables as ``(table_schema, table_name)``."""
    rows = [
        (".".join(t.namespace) if t.namespace else "", t.name)
        for db in spark.catalog.listDatabases()
        for t in spark.catalog.listTables(db.name)
    ]
    return small_table(spark, sorted(set(rows)), "table_schema string, table_name string")


def relations(spark: SparkSession, found: DataFrame) -> dict[str, DataFrame]:
    """The found tables by name, ready for a union; only names pass the driver."""
    names = [r["table_schema"] + "." + r["table_name"] if r["table_schema"] else r["table_name"] for r in found.orderBy("table_schema", "table_name").collect()]
    return {n: spark.table(n) for n in names}


# -- metadata and samples -----------------------------------------------------------------


def table_metadata(df: DataFrame, table: str, descriptions: Mapping[str, str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, table row count, description and up to five first values."""
    fields = plain_columns(df)
    told = descriptions or {}
    listed = small_table(df.sparkSession, 
        [(table, i, f.name, f.dataType.simpleString(), told.get(f.name, "")) for i, f in enumerate(fields)],
        "table_name string, ord int, column_name string, dtype string, description string",
    )
    head = column_samples(df, [f.name for f in fields], 5, order_by).withColumnRenamed("sample", "sample_values")
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    with_table = counted.withColumn("table_name", F.lit(table))
    return listed.join(head, "column_name").join(with_table, "table_name").select(
        "table_name", "ord", "column_name", "dtype", "row_count", "description", "sample_values"
    )


def seeded_sample(df: DataFrame, key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """min(n, rows) rows, the same ones every time: the smallest hashes of the key.

    A top-n keeps n rows per task; nothing is sorted whole.
    """
    texts = [F.coalesce(plain_text(F.col(k), df.schema[k].dataType), F.lit("")) for k in key]
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return df.orderBy(hashed, *key).limit(n)


def write_result(df: DataFrame, path: str) -> str:
    """Discovery result as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


# Fixed value: the form of a result's name.
def result_name(table_a: str, table_b: str) -> str:
    return f"identificar_chave_{table_a}__{table_b}.json"
