"""Records of delimited text whose quoted cells may hold line breaks, cut split by split.

Whether a line lies inside a quoted cell depends on all the text before it, yet no file is
read as a whole.  A first scan takes every split under both assumptions, that it begins
outside or inside a quoted cell, and keeps what state each leads to: one row per split.  The state
at a split's start follows from the splits before it (a window over those rows).  The
second scan then cuts each split into records by itself; only records that go over the end of a split
are put together from their pieces afterwards.

A split is known by its file and where it begins, so the state found for it holds whatever
its length; should Spark cut the files elsewhere between the two scans, the second one fails
rather than guess.  To the driver go one hash and one state per split, and the distinct headers.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTSIDE, INSIDE = 0, 1
_CLOSING = re.compile(rb'(?:[^"]|"")*"(?!")', re.DOTALL)
_BOM = b"\xef\xbb\xbf"


def state_after(line: bytes, state: int, sep: bytes) -> int:
    """Whether the end of a line lies inside a quoted cell.  A quote opens a cell only at its very start."""
    at = 0
    if state == OUTSIDE:
        if not line.startswith(b'"'):
            at = line.find(sep + b'"')
            if at < 0:
                return OUTSIDE
            at += len(sep)
        at += 1
    while True:
        closed = _CLOSING.match(line, at)
        if closed is None:
            return INSIDE
        at = line.find(sep + b'"', closed.end())
        if at < 0:
            return OUTSIDE
        at += len(sep) + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their file and split; a split's lines come in order within a task."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.withColumn("name", F.xxhash64("file", "start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, pa.Array]]:
    """Lines of a batch by split: the split, its name, the lines."""
    files = batch.column("file").dictionary_encode()
    place, start = files.indices.to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
        if b > a:
            split = files.dictionary[int(place[a])].as_py(), int(start[a])
            yield split, batch.column("name")[int(a)].as_py(), batch.column("line").slice(int(a), int(b - a))


class _Top:
    """What stands above the first record of a file: ``skip`` lines and the header record."""

    def __init__(self, skip: int, sep: bytes):
        self.skip, self.sep, self.header, self.state, self.done = skip, sep, [], OUTSIDE, False

    def drop(self, lines: pa.Array) -> pa.Array:
        """The lines below; the header's are kept."""
        at = min(self.skip, len(lines))
        self.skip -= at
        while at < len(lines) and not self.done:
            line = lines[at].as_py()
            at += 1
            if not self.header:
                line = line.removeprefix(_BOM)
                if not line.strip():
                    continue
            self.header.append(line)
            self.state = state_after(line, self.state, self.sep)
            self.done = self.state == OUTSIDE
        return lines.slice(at)


def _quoted(lines: pa.Array) -> np.ndarray:
    """Places of the lines with a quote; the others leave the state as it is."""
    return np.flatnonzero(pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False))


def _record_ends(lines: pa.Array, state: int, sep: bytes) -> tuple[np.ndarray, int]:
    """Places of the lines that end outside a quoted cell, and the last state."""
    after = np.full(len(lines), state, np.int8)
    for i in _quoted(lines):
        state = state_after(lines[int(i)].as_py(), state, sep)
        after[i:] = state
    return np.flatnonzero(after == OUTSIDE), state


def _survey(lines: DataFrame, sep: bytes, skip: int) -> DataFrame:
    """(file, start, outside, inside, header): where each assumption on a split's start leads."""

    def run(batches):
        split, top, ends = None, None, [OUTSIDE, INSIDE]

        def row():
            header = b"\n".join(top.header) if top is not None and top.header else None
            cells = [[split[0]], [split[1]], [ends[0]], [ends[1]], [header]]
            kinds = [pa.string(), pa.int64(), pa.int8(), pa.int8(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["file", "start", "outside", "inside", "header"])

        for batch in batches:
            for key, _, part in _runs(batch):
                if key != split:
                    if split is not None:
                        yield row()
                    split = key
                    top = _Top(skip, sep) if key[1] == 0 else None
                    ends = [OUTSIDE, OUTSIDE] if top else [OUTSIDE, INSIDE]
                if top is not None:
                    part = top.drop(part)
                for i in _quoted(part):
                    line = part[int(i)].as_py()
                    first = state_after(line, ends[0], sep)
                    ends = [first, first if ends[0] == ends[1] else state_after(line, ends[1], sep)]
        if split is not None:
            yield row()

    return lines.mapInArrow(run, "file string, start long, outside tinyint, inside tinyint, header binary")


def _split_starts(survey: DataFrame) -> DataFrame:
    """(name, state): the state at every split's start, from those before it in its file.

    The nearest split before that leads to one state whatever its start settles it, but for
    the splits since that turn outside into inside and the reverse.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("outside") == INSIDE) & (F.col("inside") == OUTSIDE), 1).otherwise(0)
    counted = survey.withColumn("turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    state = F.pmod(F.coalesce(last["outside"], F.lit(OUTSIDE)).cast("long") + F.col("turns") - F.coalesce(last["turns"], F.lit(0)), F.lit(2))
    return counted.select(F.xxhash64("file", "start").alias("name"), state.cast("tinyint").alias("state"), "file", "start", "header")


@dataclass
class Records:
    """Records as text, each with the number of its header among ``headers``."""

    rows: DataFrame
    headers: list[str]


def read_records(spark: SparkSession, path: str | list[str], sep: str, encoding: str, skip: int) -> Records:
    """The records of all files below ``skip`` lines and a header record each.

    Distinct headers are numbered by the first file that has them.  Blank lines are no records.
    """
    mark = sep.encode(encoding)
    lines = _lines(spark, path)
    starts = _split_starts(_survey(lines, mark, skip)).select("name", "state", "header", F.when(F.col("header").isNotNull(), F.col("file")).alias("file")).toArrow()
    order = np.argsort(starts.column("name").to_numpy())
    names, states = starts.column("name").to_numpy()[order], starts.column("state").to_numpy()[order]
    first: dict[bytes, str] = {}
    of_file: dict[str, bytes] = {}
    for header, file in zip(starts.column("header").to_pylist(), starts.column("file").to_pylist()):
        if header is not None:
            first[header] = min(first.get(header, file), file)
            of_file[file] = header
    headers = sorted(first, key=first.get)
    number = {h: i for i, h in enumerate(headers)}
    several = {file: number[h] for file, h in of_file.items()} if len(headers) > 1 else {}
    known = spark.sparkContext.broadcast((names, states, several))
    cut = lines.mapInArrow(_cutter(known, mark, encoding, skip), "file string, start long, opens boolean, header int, record binary")
    text = F.rtrim(F.col("record").cast("string"), F.lit("\r"))
    rows = cut.where("file IS NULL").select("header", text.alias("record"))
    if INSIDE in states:
        # a record opens in one split and goes on at the start of the next ones
        pieces = cut.where("file IS NOT NULL")
        record = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("start", "opens"))
        joined = pieces.withColumn("nth", record).groupBy("file", "nth").agg(
            F.first("header").alias("header"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "opens", F.col("record").cast("string").alias("text")))), lambda x: x["text"]), "\n").alias("record")
        )
        rows = rows.unionAll(joined.select("header", F.rtrim("record", F.lit("\r"))))
    return Records(rows.where(F.length(F.trim("record")) > 0), [h.decode(encoding).rstrip("\r") for h in headers])


def _cutter(known, sep: bytes, encoding: str, skip: int):
    """Cuts every split into its whole records (without file) and the pieces of others at its ends."""
    plain = codecs.lookup(encoding).name == "utf-8"

    def rows(texts, header: int, file: str | None = None, start: int | None = None, opens: bool | None = None) -> pa.RecordBatch:
        if not plain:
            texts = [t.decode(encoding, "replace").encode() for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        records = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        n = len(records)
        cells = [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([opens] * n, pa.bool_()), pa.array(np.full(n, header, np.int32)), records]
        return pa.RecordBatch.from_arrays(cells, names=["file", "start", "opens", "header", "record"])

    def run(batches):
        names, states, several = known.value
        split, top, state, header = None, None, OUTSIDE, 0
        held: list[bytes] = []  # lines of a record whose end has not come
        continued = False  # it began in an earlier split
        for batch in batches:
            for key, name, part in _runs(batch):
                if key != split:
                    if held:
                        yield rows([b"\n".join(held)], header, *split, not continued)
                    at = int(np.searchsorted(names, name))
                    if at == len(names) or names[at] != name:
                        raise RuntimeError("the files or their splits changed since they were surveyed; read them again")
                    split, state, header, held = key, int(states[at]), several.get(key[0], 0), []
                    continued = state == INSIDE
                    top = _Top(skip, sep) if key[1] == 0 else None
                if top is not None:
                    part = top.drop(part)
                ends, after = _record_ends(part, state, sep)
                if len(ends) == len(part) and not held and not continued:
                    yield rows(part, header)
                    continue
                lines, at, whole = part.to_pylist(), 0, []
                for end in ends.tolist():
                    record = b"\n".join([*held, *lines[at : end + 1]])
                    at, held = end + 1, []
                    if continued:
                        yield rows([record], header, *split, False)
                        continued = False
                    else:
                        whole.append(record)
                held += lines[at:]
                state = after
                yield rows(whole, header)
        if held:
            yield rows([b"\n".join(held)], header, *split, not continued)

    return run
