"""Files landing in the raw zone flow into a staged table by key, batch after batch."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.merge import align, merge_latest
from keyloom.operators.relational import latest_per_key
from keyloom.sources.commits import CommitLog
from keyloom.sources.keyed import KeyedTable
from keyloom.sources.versions import VersionedTable

_LANDED = "__landed"


class _Runs:
    """The marks of a stream's runs, kept beside the table: until when a run's files had landed, and its mark."""

    def __init__(self, table: VersionedTable | KeyedTable, stream: str, kind: T.DataType):
        self.log = CommitLog(table.spark, f"{table.path}/runs/{stream}")
        self.kind = kind
        self.runs: list[tuple[int, str | None]] = []

    def begin(self, mark: str | None) -> None:
        """Note the mark of the run that begins now."""
        _, record = self.log.latest()
        self.runs = [tuple(r) for r in record["runs"]] if record else []
        now = time.time_ns() // 1_000_000
        if self.runs and self.runs[-1][1] == mark:
            self.runs[-1] = (now, mark)
        else:
            self.runs.append((now, mark))
        while not self.log.add(self.log.latest()[0] + 1, {"runs": self.runs}):
            pass
        for old in self.log.numbers()[:-2]:
            self.log.forget(old)

    def mark_at(self, landed: int | None) -> str | None:
        """The mark that judges a file by the time it landed, in milliseconds."""
        return next((mark for until, mark in self.runs if landed is not None and landed <= until), self.runs[-1][1])

    def limit(self) -> Column:
        """The mark for each row, by the time its file landed; NULL takes every row."""
        out = F.lit(self.runs[-1][1]).cast(self.kind)
        for until, mark in reversed(self.runs[:-1]):
            out = F.when(F.unix_millis(_LANDED) <= until, F.lit(mark).cast(self.kind)).otherwise(out)
        return out


def stream_merge(
    spark: SparkSession,
    raw_dir: str,
    schema: T.StructType,
    table: VersionedTable | KeyedTable,
    keys: Sequence[str],
    stamp: str,
    checkpoint: str,
    order: Sequence[Column] | None = None,
    skip_late: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process all files there are, merging each batch into ``table``.

    A ``KeyedTable`` has only the buckets a batch touches rewritten; a ``VersionedTable`` is
    rewritten whole for every batch.

    ``skip_late`` keeps the batch rule: rows at or below the high-water mark are left out;
    without it every row is an upsert by key.  The mark is read once, when a run starts, and
    noted beside the table with the time.  Every file is judged by the mark of the first run that
    started after it had landed, so neither the number of files in a batch nor a failure and a restart
    matter.  The table is keyed from the start: of several rows for a key the first under
    ``order`` stays.

    Each batch is tagged with the stream and the batch: a batch repeated after a failure finds its tag and
    changes nothing.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ordering = list(order) if order is not None else [F.col(stamp).desc_nulls_last()]
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    kind = schema[stamp].dataType
    runs = _Runs(table, stream, kind)
    if skip_late:
        start = table.read()
        runs.begin(start.agg(F.max(stamp).cast("string")).head()[0] if start is not None else None)

    def combined(target: DataFrame | None, batch: DataFrame) -> DataFrame:
        """The target's rows (of the touched buckets) after the batch."""
        rows = batch.drop(_LANDED)
        if target is None:
            return latest_per_key(rows, keys, ordering)
        target = align(target, rows)
        if not skip_late:
            return merge_latest(target, rows, keys, ordering)
        fresh = batch.where(runs.limit().isNull() | (F.col(stamp) > runs.limit())).drop(_LANDED)
        # rows that came after the mark compete with this batch's; older ones give way to both
        mark = runs.mark_at(batch.agg(F.min(F.unix_millis(_LANDED))).head()[0])
        if mark is None:
            return latest_per_key(target.unionByName(fresh), keys, ordering)
        limit = F.lit(mark).cast(kind)
        newer = latest_per_key(target.where(F.col(stamp) > limit).unionByName(fresh), keys, ordering)
        return merge_latest(target.where((F.col(stamp) <= limit) | F.col(stamp).isNull()), newer, keys)

    def merge(batch: DataFrame, batch_id: int) -> None:
        tag = f"{stream}-{batch_id}"
        if table.has(tag):
            return
        if isinstance(table, KeyedTable):
            table.merge(batch, combine=lambda old, new: combined(old if table.versions() else None, new), stamp=stamp, tag=tag, hidden=[_LANDED])
        else:
            table.update(lambda found: combined(found, batch), tag)

    return (
        reader.parquet(raw_dir)
        .withColumn(_LANDED, F.col("_metadata.file_modification_time"))
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
