"""Tables kept by key in buckets, so that a merge reads and rewrites only what it touches.

A key belongs to one of a fixed number of buckets.  A version is a commit record that
says for every bucket which folder holds it.  A merge reads the buckets its updates fall
in, writes those anew into a folder of its own, and carries all others over by name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.merge import align, merge_latest
from keyloom.session import settled, small_table
from keyloom.sources.commits import CommitLog, Conflict

BUCKET = "__bucket"
KEPT_TAGS = 100


class KeyedTable:
    """A table with at most one row per key, under ``path``.

    ``buckets`` is fixed when the table is first written: some hundreds of megabytes a bucket
    at the size expected.  Columns follow the newest updates: new ones appear with NULL in rows
    not updated, dropped ones leave; a column that changes its type has all buckets rewritten.
    Two writers may merge at once: the later commit is carried over to the other's version where
    they touch different buckets, and made anew from it otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), list(keys), buckets, keep
        self.log = CommitLog(spark, f"{self.path}/commits")

    def versions(self) -> list[int]:
        return self.log.numbers()

    def has(self, tag: str) -> bool:
        return tag in (self.log.latest()[1] or {}).get("tags", [])

    def mark(self, stamp: str, like: str = "timestamp"):
        """The greatest ``stamp`` ever merged, None when there is none; read from the newest record, not from the rows."""
        text = (self.log.latest()[1] or {}).get("marks", {}).get(stamp)
        return None if text is None else small_table(self.spark, [(text,)], "v string").select(F.col("v").cast(like)).head()[0]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the newest (or a kept) version, None when there is none."""
        record = self.log.get(version) if version is not None else self.log.latest()[1]
        return None if record is None else self._rows(record, sorted(map(int, record["folders"])))

    def bucket_paths(self, record: dict, buckets: Sequence[int]) -> list[str]:
        return [f"{self.path}/{record['folders'][str(b)]}/{BUCKET}={b}" for b in buckets if str(b) in record["folders"]]

    def _rows(self, record: dict, buckets: Sequence[int]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        paths = self.bucket_paths(record, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        """By the keys' text, so that a key keeps its bucket when its type widens."""
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(n)).cast("int")

    def merge(
        self,
        updates: DataFrame,
        order: Sequence[Column] | None = None,
        stamp: str | None = None,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        tag: str | None = None,
        hidden: Sequence[str] = (),
        attempts: int = 10,
    ) -> int:
        """Upsert ``updates`` by key and return the version.

        Of several updates for a key the first under ``order`` stays.  ``stamp`` names a
        column whose greatest value is kept as the table's mark.  ``combine(old, updates)``
        may say otherwise how the rows of the touched buckets meet the updates; it alone sees
        the updates' ``hidden`` columns.  A ``tag`` makes a retry harmless.
        """
        if combine is None:
            combine = lambda old, new: merge_latest(old, new, self.keys, order or [F.lit(0)])
        _, record = self.log.latest()
        n = record["buckets"] if record else self.buckets
        updates = settled(updates.withColumn(BUCKET, self._bucket(n)), "updates")
        touched = sorted(r[0] for r in updates.select(BUCKET).distinct().collect())  # bucket numbers
        rows, like = updates.drop(BUCKET), updates.drop(BUCKET, *hidden)
        greatest = updates.agg(F.max(stamp).cast("string")).head()[0] if stamp else None
        for _ in range(attempts):
            number, record = self.log.latest()
            if record and tag in record["tags"] or record and not touched:
                return number
            own = set(touched)
            if record and self._retyped(record, like.schema):
                own |= set(map(int, record["folders"]))
            old = align(self._rows(record, sorted(own)), like) if record else self.spark.createDataFrame([], like.schema)
            folder = f"data-{uuid.uuid4().hex}"
            merged = combine(old, rows).withColumn(BUCKET, self._bucket(n)).hint("rebalance", F.col(BUCKET))
            merged.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            base = record
            while True:
                new = self._next(record, like.schema, own, folder, n, tag, stamp, greatest)
                if self.log.add(number + 1, new):
                    self._tidy()
                    return number + 1
                number, record = self.log.latest()
                if tag is not None and tag in record["tags"]:
                    break
                if base is None or base["schema"] != record["schema"] or any(base["folders"].get(str(b)) != record["folders"].get(str(b)) for b in own):
                    break  # the other writer changed what this one read
            self.log.delete(f"{self.path}/{folder}")
        raise Conflict(f"{self.path} was written by others {attempts} times in a row")

    @staticmethod
    def _retyped(record: dict, schema: T.StructType) -> bool:
        old = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(record["schema"]))}
        return any(f.name in old and old[f.name] != f.dataType for f in schema)

    def _next(self, record: dict | None, schema: T.StructType, own: set[int], folder: str, n: int, tag: str | None, stamp: str | None, greatest: str | None) -> dict:
        record = record or {"folders": {}, "tags": [], "marks": {}}
        marks = dict(record["marks"])
        if greatest is not None:
            marks[stamp] = max(filter(None, [marks.get(stamp), greatest]), key=lambda v: self._ordered(schema[stamp].dataType, v))
        fs, root = self.log._fs(f"{self.path}/{folder}")
        written = {s.getPath().getName().removeprefix(f"{BUCKET}=") for s in fs.listStatus(root)} if fs.exists(root) else set()
        folders = {b: f for b, f in record["folders"].items() if int(b) not in own} | {str(b): folder for b in own if str(b) in written}
        tags = [*record["tags"], *([tag] if tag is not None else [])][-KEPT_TAGS:]
        return {"folders": folders, "buckets": n, "schema": schema.json(), "tags": tags, "marks": marks}

    def _ordered(self, kind: T.DataType, text: str):
        """The mark's value, to compare it as its type does."""
        return small_table(self.spark, [(text,)], "v string").select(F.col("v").cast(kind)).head()[0]

    def _tidy(self) -> None:
        """Drop records but the newest few, and the buckets that only those named."""
        numbers = self.versions()
        gone, kept = (numbers[: -self.keep - 1], numbers[-self.keep - 1 :]) if self.keep else ([], numbers)
        used = {(b, f) for v in kept for b, f in self.log.get(v)["folders"].items()} if gone else set()
        for v in gone:
            for b, f in self.log.get(v)["folders"].items():
                if (b, f) not in used:
                    self.log.delete(f"{self.path}/{f}/{BUCKET}={b}")
            self.log.forget(v)

    def load_newer(self, source: DataFrame, stamp: str, order: Sequence[Column] | None = None, lookback: timedelta | None = None) -> int:
        """One incremental run: rows of ``source`` above the table's mark, upserted by key.

        The mark is a literal in the source's scan.  Rows at or below it, and rows without a
        stamp, are left out, but for a first run, which takes all.
        """
        kind = source.schema[stamp].dataType
        mark = self.mark(stamp, kind.simpleString())
        if mark is not None:
            source = source.where(F.col(stamp) > F.lit(mark - lookback if lookback is not None else mark).cast(kind))
        return self.merge(source, list(order) if order is not None else [F.col(stamp).desc_nulls_last()], stamp)


def append_copy(source: DataFrame, path: str) -> None:
    """Append all rows of ``source`` to the copy at ``path``, without keys: loading twice leaves both.

    The copy's columns and types stay as its first load made them; missing ones are NULL and surplus ones an error.
    """
    spark = source.sparkSession
    fs, root = CommitLog(spark, path)._fs(path)
    if fs.exists(root):
        like = spark.read.parquet(path)
        surplus = set(source.columns) - set(like.columns)
        if surplus:
            raise ValueError(f"the copy at {path} has no columns {sorted(surplus)}")
        source = align(source, like)
    source.write.mode("append").parquet(path)
