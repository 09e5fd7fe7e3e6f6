"""Exact substring dedup: bytes inside strings of ``length`` bytes that start anywhere else too.

Prefix doubling gives positions ranks for short strings first, sorts pairs of ranks at growing
offsets, and goes on with positions that are neither unique nor past the threshold.  Sorting
every position of a corpus in every round is beyond reach, so positions go through the rounds
in blocks:

* The position of the least hash among the short strings (``GRAM`` bytes) in a window of
  ``length`` bytes is its anchor.  Equal windows have equal anchors at equal offsets, and
  neighbouring windows mostly share one.  Windows of one anchor are a block.
* A block has a pair of ranks (64-bit names instead of numbers, so no round waits for
  another's count): of the text that all its windows share, and of all its text.  Spark
  sorts the blocks by the pair.  A block alone with its first rank is unique: no window of it
  recurs.  A block that shares both is past the threshold: all of its windows recur.
* The others go on in smaller blocks, whose shared text is longer: 64 bytes in the first round,
  ``length - 7`` for eight windows, ``length`` for one.  One representative of each settled
  text goes on with them as long as an open block shares its first rank.

A round is decided by rows next to each other in the sorted stream, so no group is held,
whatever its size.  Which blocks are open reaches the next scan as a Bloom filter of fixed size;
blocks it lets through by mistake are decided like the rest.

Defined results: null and empty texts, and those shorter than ``length``, lose nothing; rows with
equal ids are separate texts (a repeated row is a copy of the other); matches never cross texts;
an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.ngram_join import filter_bits
from keyloom.llm.bloom import may_contain
from keyloom.llm.textops import blocks, buffers, byte_sums, byte_table, mix, row_batches, spare_name, summed_spans
from keyloom.session import settled

LENGTH = 200
GRAM = 64
FINE = 8
FILTER_BITS = 1 << 26
SEGMENT = 1 << 20
BLOCK = 1 << 17
CORE = byte_table(fold_case=False, seed=2)
HULL = byte_table(fold_case=False, seed=3)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(sums: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of every window start, from the sums of at most 2 ** 20 bytes that the windows lie in."""
    n = len(sums) - gram
    grams = summed_spans(sums, slice(0, n), slice(gram, gram + n))
    low = np.uint64(SEGMENT * 2 - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)  # ties: the first
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[starts], least[starts + width - size])
    return (least & low).astype(np.int64)


def pieces(column: pa.Array, length: int):
    """(rows, bytes, offset of these bytes in the row, starts of whole windows, row of each).

    Short texts come together; a very long one comes in overlapping segments.
    """
    data, offsets = buffers(column)
    for i, j, part, at in blocks(data, offsets, min(BLOCK, SEGMENT)):
        if len(part) <= SEGMENT:  # one longer than BLOCK is a single text
            if len(part) < length:
                continue
            ok = np.zeros(len(part) + 1, np.int32)
            long = np.diff(at) >= length
            np.add.at(ok, at[:-1][long], 1)
            np.add.at(ok, at[1:][long] - length + 1, -1)
            starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
            if len(starts):
                owner = np.searchsorted(at, starts, "right") - 1
                yield part, starts, owner + i, starts - at[owner]
            continue
        step = SEGMENT - length + 1
        for s in range(0, len(part) - length + 1, step):
            own = part[s : s + SEGMENT]
            starts = np.arange(len(own) - length + 1)
            yield own, starts, np.full(len(starts), i), starts + s


def level_rows(column: pa.Array, size: int, length: int, gram: int, wanted=()):
    """Arrays (row, core, hull, low, n) of the blocks of at most ``size`` windows (0: whole blocks).

    ``wanted`` tells which names of whole blocks, and which of their parts of ``FINE`` windows, go on in parts;
    nothing else is made of the others.
    """
    for data, starts, owner, place in pieces(column, length):
        sums, hull_sums = byte_sums(data, CORE), byte_sums(data, HULL)
        anchor = anchors(sums, starts, length, gram)
        back = anchor - starts  # how far the anchor lies behind the start
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1

        def hull(a, b):
            """Names of whole parts from window ``a`` to window ``b``: their text and where the anchor is."""
            h = summed_spans(hull_sums, starts[a], starts[b] + length)
            return mix(h ^ mix(back[a].astype(np.uint64) * _ODD + back[b].astype(np.uint64)))

        whole = hull(first, last)
        if size == 0:
            at = anchor[first]
            yield owner[first], summed_spans(sums, at, at + gram), whole, place[first], last - first + 1
            continue
        if wanted:
            keep = np.repeat(wanted[0](whole), last - first + 1)
            starts, owner, place, anchor, back, new = (x[keep] for x in (starts, owner, place, anchor, back, new))
            if not len(starts):
                continue
        new |= np.diff(back // FINE, prepend=back[0]) != 0
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(starts)) - 1
        fine = hull(a, b)
        if size == FINE:
            # shared by all windows of the aligned part, whichever of them exist here
            top = back[a] // FINE * FINE
            core = summed_spans(sums, anchor[a] - top, anchor[a] - top - FINE + 1 + length)
            core = mix(core ^ (top.astype(np.uint64) * _ODD))
            yield owner[a], core, fine, place[a], b - a + 1
            continue
        if wanted:
            keep = np.repeat(wanted[1](fine), b - a + 1)
            starts, owner, place, back = (x[keep] for x in (starts, owner, place, back))
        every = slice(None)
        yield owner, summed_spans(sums, starts, starts + length), hull(every, every), place, np.ones(len(starts), np.int64)


def level(rows: DataFrame, size: int, length: int, gram: int, open_names: list[Broadcast], bits: int) -> DataFrame:
    """(core, hull, key, id, low, n) of all blocks of a level; below the first, parts of open ones only.

    An open block occurs once.  A settled one goes on as a partner, and is enough once a task.
    ``open_names`` has a filter for each level before: a part is open in all of them.
    """
    id_field = rows.schema["id"]
    names = ["core", "hull", "key", "id", "low", "n"]

    def run(batches):
        def first_open(names):
            seen: set[int] = set()

            def test(named):
                take = may_contain(names.value, bits, named)
                for g in np.flatnonzero(take).tolist():
                    name = int(named[g])
                    take[g] = name not in seen
                    seen.add(name)
                return take

            return test

        wanted = [first_open(names) for names in open_names]
        for batch in batches:
            for owner, core, hull, low, n in level_rows(batch.column(2), size, length, gram, wanted):
                for s in range(0, len(owner), 50_000):
                    cut = slice(s, s + 50_000)
                    at = pa.array(owner[cut])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(core[cut].view(np.int64)),
                            pa.array(hull[cut].view(np.int64)),
                            batch.column(0).take(at),
                            batch.column(1).take(at),
                            pa.array(low[cut].astype(np.int64)),
                            pa.array(n[cut].astype(np.int32)),
                        ],
                        names=names,
                    )

    longs = [T.StructField(c, T.LongType()) for c in ("core", "hull", "key")]
    return rows.select("key", "id", "text").mapInArrow(run, T.StructType([*longs, id_field, T.StructField("low", T.LongType()), T.StructField("n", T.IntegerType())]))


SETTLED, OPEN, FIRST = 1, 2, 4


def decided(blocks_: DataFrame) -> DataFrame:
    """Blocks whose core recurs, with ``state``: ``SETTLED`` or ``OPEN``, plus ``FIRST`` for one block of each settled text."""
    schema = T.StructType([*blocks_.schema.fields, T.StructField("state", T.IntegerType())])

    def run(batches):
        held: pa.RecordBatch | None = None  # the last row so far, not yet decided
        before: tuple[int, int] | None = None  # the row before it

        def decide(batch, previous, following):
            core, hull = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = len(core)
            with_last = np.zeros(n, bool), np.zeros(n, bool)
            same_core = core[1:] == core[:-1]
            with_last[0][1:] = same_core
            with_last[1][1:] = same_core & (hull[1:] == hull[:-1])
            if previous is not None:
                with_last[0][0] = core[0] == previous[0]
                with_last[1][0] = (core[0], hull[0]) == previous
            with_next = np.append(with_last[0][1:], following is not None and core[-1] == following[0]), np.append(with_last[1][1:], following is not None and (core[-1], hull[-1]) == following)
            again = with_last[1] | with_next[1]
            keep = with_last[0] | with_next[0]
            state = np.where(again, SETTLED, OPEN) + np.where(again & ~with_last[1], FIRST, 0)
            out = batch.filter(pa.array(keep))
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(state[keep].astype(np.int32))], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if table.num_rows > 1:
                body, held = table.slice(0, table.num_rows - 1), table.slice(table.num_rows - 1)
                following = (held.column(0)[0].as_py(), held.column(1)[0].as_py())
                yield decide(body, before, following)
                before = (body.column(0)[-1].as_py(), body.column(1)[-1].as_py())
            else:
                held = table
        if held is not None:
            yield decide(held, before, None)

    return blocks_.repartition("core").sortWithinPartitions("core", "hull", "id", "key", "low").mapInArrow(run, schema)


def repeated_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """(key, id, low, high): byte ranges covered by recurring strings; ranges of a text may overlap.

    ``rows`` has key, id and text.
    """
    out = None
    names: list[Broadcast] = []
    for size in (0, FINE, 1):
        table = settled(decided(level(rows, size, length, gram, names, bits)), f"level{size}")
        found = table.where(F.col("state").bitwiseAND(SETTLED) != 0).select("key", "id", "low", (F.col("low") + F.col("n") + length - 1).alias("high"))
        out = found if out is None else out.unionAll(found)
        if size == 1:
            break
        still = table.where(F.col("state") == OPEN).select("core", "hull")
        partner = table.where(F.col("state") == SETTLED + FIRST).select("core", "hull").join(still.select("core").distinct(), "core", "left_semi")
        names = [*names, rows.sparkSession.sparkContext.broadcast(filter_bits(still.unionAll(partner).select("hull"), bits))]
    for name in names:
        name.destroy()  # all levels are written
    return out


def drop_repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``kept`` (the remaining bytes), ``n_bytes`` and ``removed`` (runs of bytes, [begin, end)) added.

    A new name that ``df`` already has gets an underscore at its end.
    """
    if not 0 < gram < length - FINE:
        raise ValueError("gram must be positive and well below length")
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    rows = df.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    runs = repeated_runs(rows, length, gram, bits)
    # ranges of a text in one list, as many as it has at most; sorted and united on use
    runs = runs.groupBy("key", "id").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    added: list[str] = []
    for name in ("kept", "n_bytes", "removed"):
        added.append(spare_name([*df.columns, *added], name))
    mine = [spare_name(df.columns, c) for c in ("run_key", "run_id", "run_list")]
    runs = runs.select(*[F.col(c).alias(m) for c, m in zip(("key", "id", "runs"), mine)])
    both = df.join(runs, key.eqNullSafe(F.col(mine[0])) & F.col(f"`{id_col}`").eqNullSafe(F.col(mine[1])), "left")
    both = both.select([F.col(f"`{c}`") for c in df.columns] + [F.col(mine[2])])
    at, width = df.columns.index(text_col), len(df.columns)
    more = T.StructType.fromDDL(f"`{added[0]}` binary, `{added[1]}` long, `{added[2]}` array<struct<begin:long,end:long>>")
    schema = T.StructType([*df.schema.fields, *more.fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in row_batches(batch, 500):
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *without_runs(part.column(at), part.column(width))], names=names)

    return both.mapInArrow(run, schema)


def without_runs(texts: pa.Array, ranges: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(kept bytes, number of bytes, removed runs) of texts that lose their lists of ranges (low, high)."""
    data, at = buffers(texts)
    flat = ranges.flatten()
    owner = np.repeat(np.arange(len(ranges)), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy())
    owner, begin, end = united(owner, at[owner] + flat.field("low").to_numpy(), at[owner] + flat.field("high").to_numpy())
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin] += 1
    edge[end] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
    gone = np.bincount(owner, end - begin, len(texts)).astype(np.int64)
    kept_at = np.append(0, np.cumsum(np.diff(at) - gone))
    kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(data[stays])])
    runs = pa.StructArray.from_arrays([pa.array(begin - at[owner]), pa.array(end - at[owner])], names=["begin", "end"])
    runs_at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
    return kept, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(runs_at.astype(np.int32)), runs)


def united(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each owner sorted, disjoint and not touching; ranges of a later owner lie behind."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(owner), bool)
    new[1:] = (begin[1:] > end[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], begin[first], end[np.append(first[1:], len(owner)) - 1]
