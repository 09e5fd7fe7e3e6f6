"""Which values lie inside which others, as a grouping of short values and an equi join of the rest.

A value below eight bytes is a number: its bytes with its length.  So is every window of those few
sizes, and one grouping by that number says which columns' values hold it.  A task writes a window
once for each bit set it met it under (as far as its bounded memory goes), not once for each place.

Every longer value is looked for by one of its windows, its *anchor*.  A value of n bytes has windows
of the greatest power of two up to n bytes, and its anchor is the one that is rarest among all longer
values.  The longer values are then read once for each window size that occurs, with rolling
hashes, so the work is the length of the texts times the few sizes.  Where a window
may be an anchor (a bit map of all anchors says so), the bytes around it go to the join, no more than
the longest value of that size could take, and the join's condition compares the bytes themselves.

A value's own anchor is left out unless another value has the same one.  Rarity only steers
which window is taken, so it is estimated on a hash sample of the values; results don't depend on it.
Bytes of UTF-8 are compared, which finds what comparing characters would find.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import settled

#: Below this length a value is looked for as a whole.
SHORT = 8
SLOTS = 1 << 20
SAMPLE_BYTES = 1 << 26
FILTER_BITS = 1 << 24
BLOCK_BYTES = 1 << 20
#: Windows that a task keeps before it writes them.
KEPT_WINDOWS = 1 << 21
#: The number of a short window takes 59 bits, which leaves five for one of so many bit sets.
KEY_BITS = 59
SETS_A_ROUND = 32

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Block:
    """Some values end to end, with hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @cached_property
    def down(self) -> np.ndarray:
        out = np.full(len(self.data) + 1, _BACK)
        out[0] = 1
        return np.cumprod(out)

    @cached_property
    def sums(self) -> np.ndarray:
        up = np.full(len(self.data) + 1, _STEP)
        up[0] = 1
        np.cumprod(up, out=up)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.data] * up[:-1], dtype=np.uint64)])

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, size: int) -> np.ndarray:
        """Of the windows at every place, those over the end of a value among them."""
        n = max(len(self.data) - size + 1, 0)
        return _mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n] + np.uint64(size))

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def short_windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Size, numbers of the windows at every place, places of those within a value and of those that are one."""
        left = np.repeat(self.offsets[1:], self.lengths) - np.arange(len(self.data))
        start = np.zeros(len(self.data), bool)
        start[self.offsets[:-1][self.lengths > 0]] = True
        number = np.zeros(len(self.data), np.uint64)
        for size in range(1, min(SHORT, len(self.data) + 1)):
            n = len(self.data) - size + 1
            number = (number[:n] << np.uint64(8)) | self.data[size - 1 :]
            whole = start[:n] & (left[:n] == size)
            yield size, number | np.uint64(size << 56), np.flatnonzero((left[:n] >= size) & ~whole), np.flatnonzero(whole)

    def anchors(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window size, hash and place within the value of every value's anchor."""
        sizes, keys, places = window_size(self.lengths), np.zeros(len(self.lengths), np.uint64), np.zeros(len(self.lengths), np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            if size == 0:
                continue
            h = self.hashes(int(size))
            begin, count = self.offsets[mine], self.lengths[mine] - size + 1
            if size >= SHORT and count.max() > 1:
                first = np.cumsum(count) - count
                at = np.arange(count.sum()) + np.repeat(begin - first, count)
                weight = (rarity[h[at] & np.uint64(len(rarity) - 1)].astype(np.int64) << 40) + at - np.repeat(begin, count)
                places[mine] = np.minimum.reduceat(weight, first) & ((1 << 40) - 1)
            keys[mine] = h[begin + places[mine]]
        return sizes, keys, places


def window_size(lengths: np.ndarray) -> np.ndarray:
    """The length itself below ``SHORT``, else the greatest power of two up to it."""
    exponent = np.frexp(np.maximum(lengths, 1).astype(np.float64))[1]
    return np.where(lengths < SHORT, lengths, np.int64(1) << np.maximum(exponent - 1, 0).astype(np.int64))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, Block]]:
    """First and end row of runs of values of about ``BLOCK_BYTES``; a longer value is one alone."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j, Block(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _rarity(texts: DataFrame, total: int) -> np.ndarray:
    """Windows per slot over a hash sample of the values, for all sizes."""
    share = max(1, total // SAMPLE_BYTES)

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                longest, size = int(block.lengths.max(initial=0)), SHORT
                while size <= longest:
                    h = block.hashes(size)
                    inside = block.owners(np.arange(len(h))) == block.owners(np.arange(len(h)) + size - 1)
                    counts += np.bincount((h[inside] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                    size *= 2
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])

    sample = texts.where(F.pmod(F.xxhash64("value"), F.lit(share)) == 0).select("value")
    counted = sample.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.uint32)
    out[counted.column("slot").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 22) - 1)
    return out


def _set_bits(words: pa.Table, column: str, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column(column).to_numpy()
    return out.view(np.uint64)


def _may_be(filter_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(filter_words) * 64 - 1)
    return (filter_words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Sets:
    """Numbers for the bit sets met by a task."""

    def __init__(self):
        self.rows: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The number of the set of every row."""
        distinct, of = np.unique(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1), axis=0, return_inverse=True)
        numbers = []
        for row in map(tuple, distinct.tolist()):
            if row not in self.ids:
                self.ids[row] = len(self.rows)
                self.rows.append(row)
            numbers.append(self.ids[row])
        return np.array(numbers, np.int64)[of.reshape(-1)]


def _short(texts: DataFrame, bits: Sequence[str], n: int) -> DataFrame:
    """``texts`` below ``SHORT`` bytes with the bits of all values that hold them; windows are taken of all texts."""
    n_bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))

    def marked(batches):
        words, sizes = np.zeros(n_bits // 64, np.uint64), 0
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                sizes |= int((block.lengths == 0).any())
                for size, number, _, whole in block.short_windows():
                    if len(whole):
                        sizes |= 1 << size
                        at = _mixed(number[whole]) & np.uint64(n_bits - 1)
                        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(words[some].view(np.int64), sizes))], names=["word", "marks"])

    little = texts.where(F.octet_length("value") < SHORT).select("value")
    # n_bits / 64 rows at most, and one of the sizes
    marks = little.mapInArrow(marked, "word long, marks long").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    sizes = sum(marks.filter(pc.less(marks.column("word"), 0)).column("marks").to_pylist())
    chosen = texts.sparkSession.sparkContext.broadcast((_set_bits(marks.filter(pc.greater_equal(marks.column("word"), 0)), "marks", n_bits), sizes))
    low, shift = np.uint64((1 << KEY_BITS) - 1), np.uint64(KEY_BITS)

    def windows(batches):
        known, sizes = chosen.value
        sets, kept, held = _Sets(), {}, 0

        def rows(keys: np.ndarray, of: np.ndarray, itself: bool) -> pa.RecordBatch:
            out = np.array(sets.rows, np.int64)[of]
            own = out if itself else np.zeros_like(out)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), itself)), *[pa.array(x[:, k]) for x in (own, out) for k in range(len(bits))]],
                names=["key", "itself", *bits, *[f"o{b}" for b in bits]],
            )

        def written():
            for part, codes in kept.items():
                codes = np.unique(np.concatenate(codes))
                yield rows(codes & low, (codes >> shift).astype(np.int64) + part * SETS_A_ROUND, False)
            kept.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            of = sets.of(batch)
            for i, j, block in blocks(batch.column(0)):
                mine = of[i:j]
                at_place = np.repeat(mine, block.lengths)
                empty = np.flatnonzero(block.lengths == 0)
                if len(empty):
                    yield rows(np.zeros(len(empty), np.uint64), mine[empty], True)
                for size, number, inside, whole in block.short_windows():
                    if not sizes >> size & 1:
                        continue
                    if len(whole):
                        yield rows(number[whole], at_place[whole], True)
                    inside = inside[_may_be(known, _mixed(number[inside]))]
                    group = at_place[inside]
                    codes = number[inside] | ((group % SETS_A_ROUND).astype(np.uint64) << shift)
                    for part in np.unique(group // SETS_A_ROUND).tolist():
                        some = np.unique(codes[group // SETS_A_ROUND == part])
                        kept.setdefault(part, []).append(some)
                        held += len(some)
                if held > KEPT_WINDOWS:
                    for part, codes in kept.items():
                        kept[part] = [np.unique(np.concatenate(codes))]
                    held = sum(len(codes[0]) for codes in kept.values())
                    if held > KEPT_WINDOWS // 2:
                        yield from written()
                        held = 0
        yield from written()
        if sizes & 1 and sets.rows:  # the empty value lies in all
            yield rows(np.zeros(len(sets.rows), np.uint64), np.arange(len(sets.rows)), False)

    ddl = ", ".join(["key long, itself boolean", *[f"`{b}` long" for b in bits], *[f"`o{b}` long" for b in bits]])
    words = [*bits, *[f"o{b}" for b in bits]]
    met = texts.mapInArrow(windows, ddl).groupBy("key").agg(F.bool_or("itself").alias("itself"), *[F.bit_or(w).alias(w) for w in words]).where("itself")
    digits = F.lpad(F.hex("key"), 16, "0")
    value = F.unhex(F.substring(digits, (17 - 2 * F.shiftright("key", 56)).cast("int"), F.lit(2 * SHORT)))
    return met.select(F.when(F.col("key") == 0, F.lit("")).otherwise(F.decode(value, "utf-8")).alias("value"), *words)


def containing(texts: DataFrame, bits: Sequence[str]) -> DataFrame:
    """``texts`` (distinct ``value``, and words of a bit set) with the bits of all values that hold the value.

    The new words are called ``o`` + name.  A value holds itself, and the empty value lies in all.
    """
    texts = settled(texts.select(F.encode("value", "utf-8").alias("value"), *bits), "texts")
    length = F.octet_length("value")
    longer = F.when(length >= SHORT, length)
    size = texts.agg((F.count("*") - F.count(longer)).alias("short"), F.count(longer).alias("long"), F.coalesce(F.sum(longer), F.lit(0)).alias("total")).head()
    if not size["short"] + size["long"]:
        return texts.select(F.decode("value", "utf-8").alias("value"), *bits, *[F.col(b).alias(f"o{b}") for b in bits])
    short = _short(texts, bits, size["short"]) if size["short"] else None
    if not size["long"]:
        return short
    long = _long(texts.where(length >= SHORT), bits, size["long"], size["total"])
    return long if short is None else short.unionAll(long)


def _long(texts: DataFrame, bits: Sequence[str], n: int, total: int) -> DataFrame:
    """The same among texts of ``SHORT`` bytes and more, by their anchors."""
    spark = texts.sparkSession
    rarity = _rarity(texts, total)
    chosen = spark.sparkContext.broadcast(rarity)

    def anchored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, block in blocks(batch.column(0)):
            sizes, keys, places = block.anchors(chosen.value)
            new = [pa.array(sizes), pa.array(keys.view(np.int64)), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=[*batch.schema.names, "size", "key", "place"])

    ddl = ", ".join(["value binary", *[f"`{b}` long" for b in bits]])
    wanted = texts.mapInArrow(lambda batches: (out for batch in batches for out in anchored(batch)), f"{ddl}, size long, key long, place long")

    n_bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    keys = wanted.groupBy("size", "key").count().withColumn("at", F.pmod("key", F.lit(n_bits)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = (
        keys.groupBy((F.col("at") / 64).cast("long").alias("word"))
        .agg(F.bit_or(one).alias("once"), F.bit_or(F.when(F.col("count") > 1, one).otherwise(F.lit(0).cast("long"))).alias("twice"), F.collect_set("size").alias("sizes"))
        .toArrow()  # n_bits / 64 rows at most
    )
    sizes = sorted(set(words.column("sizes").combine_chunks().flatten().to_pylist()))
    anchors = spark.sparkContext.broadcast((_set_bits(words, "once", n_bits), _set_bits(words, "twice", n_bits), sizes))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        once, twice, sizes = anchors.value
        sets = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
        distinct, of = np.unique(sets, axis=0, return_inverse=True)
        of = of.reshape(-1)
        for i, j, block in blocks(batch.column(0)):
            own_size, _, own_place = block.anchors(chosen.value)
            raw, group = block.data.tobytes(), of[i:j]
            found: list[tuple[np.ndarray, np.ndarray, list[int], list[bytes]]] = []
            for size in sizes:
                h = block.hashes(size)
                at = np.flatnonzero(_may_be(once, h))
                owner = block.owners(at)
                inside = at + size <= block.offsets[owner + 1]
                at, owner = at[inside], owner[inside]
                own = (own_size[owner] == size) & (own_place[owner] == at - block.offsets[owner])
                stay = ~own | _may_be(twice, h[at])
                at, owner = at[stay], owner[stay]
                # a value of this size has less than size bytes before and after the window
                begin, end = np.maximum(at - size + 1, block.offsets[owner]), np.minimum(at + 2 * size, block.offsets[owner + 1])
                found.append((h[at].view(np.int64), group[owner], (at - begin).tolist(), [raw[x:y] for x, y in zip(begin.tolist(), end.tolist())]))
            groups = np.concatenate([g for _, g, _, _ in found]).astype(np.int64)
            cells = [pa.array(np.concatenate([k for k, *_ in found])), pa.array([x for f in found for x in f[2]], pa.int64()), pa.array([x for f in found for x in f[3]], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cells, *[pa.array(distinct[groups, k]) for k in range(distinct.shape[1])]], names=["key", "before", "around", *[f"o{b}" for b in bits]])

    places = ", ".join(["key long, before long, around binary", *[f"`o{b}` long" for b in bits]])
    spots = texts.mapInArrow(lambda batches: (out for batch in batches if batch.num_rows for out in scan(batch)), places)
    begin = (F.col("before") - F.col("place") + 1).cast("int")
    same = (F.col("before") >= F.col("place")) & (F.substring(F.col("around"), begin, F.octet_length("value")) == F.col("value"))
    held = wanted.drop("size").join(spots, "key").where(same).select("value", *bits, *[f"o{b}" for b in bits])
    itself = texts.select("value", *bits, *[F.col(b).alias(f"o{b}") for b in bits])
    united = held.unionAll(itself).groupBy("value", *bits).agg(*[F.bit_or(f"o{b}").alias(f"o{b}") for b in bits])
    return united.withColumn("value", F.decode("value", "utf-8"))
