"""Delimited text: plain or compressed, every column read as text."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from io import StringIO
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.projection import cast_columns, keep_columns
from keyloom.sources.records import Records, read_records


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "utf-8",
    skip_rows: int = 0,
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Delimited text files with a header row each: a file, a folder, a pattern or a list of them.

    Codes such as ``001`` must survive, so nothing is inferred: all columns are text and
    ``types`` names those to cast.  ``skip_rows`` drops lines above the header of each file.
    Quoted cells may hold line breaks, also below a preamble and over the end of a split.  Files
    may have different headers: the result has every column, in the order they are first
    seen, with NULL where a file lacks one.  An empty header cell is called ``Unnamed: n`` by its
    place, and a repeated name gets ``.1``, ``.2``.  Encodings that are not ASCII at heart
    (UTF-16) are left to Spark's own reader, without those features.
    """
    if '\n"a'.encode(encoding) == b'\n"a':
        df = _placed(read_records(spark, path, sep, encoding, skip_rows), sep)
    elif skip_rows:
        raise ValueError(f"skip_rows is not supported for {encoding}")
    else:
        df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False, escape='"', multiLine=True)
    df = keep_columns(df, columns)
    return cast_columns(df, types) if types else df


def header_names(header: str, sep: str) -> list[str]:
    """The column names of a header record."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(next(csv.reader(StringIO(header, newline=""), delimiter=sep))):
        name, n = cell or f"Unnamed: {i}", 0
        while name.lower() in taken:
            n += 1
            name = f"{cell or f'Unnamed: {i}'}.{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def _placed(records: Records, sep: str) -> DataFrame:
    """Cells under the names that the record's own header gives them."""
    headers = [header_names(h, sep) for h in records.headers]
    if not headers:
        raise ValueError("no file has a header")
    seen: dict[str, tuple[str, dict[int, int]]] = {}
    for number, names in enumerate(headers):
        for place, name in enumerate(names):
            seen.setdefault(name.lower(), (name, {}))[1][number] = place
    slots = ", ".join(f"_{i} string" for i in range(max(map(len, headers))))
    cells = records.rows.select("header", F.from_csv("record", slots, {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))

    def cell(places: dict[int, int]) -> Column:
        if len(places) == len(headers) and len(set(places.values())) == 1:
            return F.col(f"r._{places[0]}")
        out = F.lit(None).cast("string")
        for place in sorted(set(places.values())):
            out = F.when(F.col("header").isin([h for h, p in places.items() if p == place]), F.col(f"r._{place}")).otherwise(out)
        return out

    return cells.select([cell(places).alias(name) for name, places in seen.values()])


def read_dump(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", columns: Sequence[str] | None = None, partitions: int | None = None, skip_rows: int = 0
) -> DataFrame:
    """A gzip-compressed dump.  Such files cannot be split, so rows are spread after reading."""
    df = read_delimited(spark, path, sep, encoding, skip_rows, columns)
    return df.repartition(partitions or spark.sparkContext.defaultParallelism)


def read_source(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Read by a source description: ``type`` csv, dump (``format`` csv_gz) or api pages."""
    from keyloom.sources.pages import page_records, read_pages

    kind = config.get("type", "csv")
    columns = config.get("columns")
    if kind == "csv":
        return read_delimited(
            spark, config["file_path"], config.get("separator", ","), config.get("encoding", "utf-8"), config.get("skip_rows", 0), columns
        )
    if kind == "dump":
        if config.get("format", "csv_gz") != "csv_gz":
            raise ValueError(f"unsupported dump format {config['format']!r}")
        return read_dump(spark, config["file_path"], config.get("separator", ","), config.get("encoding", "utf-8"), columns, skip_rows=config.get("skip_rows", 0))
    if kind == "api":
        return keep_columns(page_records(read_pages(spark, config["file_path"]), config.get("records_path")), columns)
    raise ValueError(f"unsupported source type {kind!r}")
