"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles.

1. One pass turns every text into its set of shingle hashes, keeps size and fingerprint, counts
   shingles in a sketch and marks those seen twice in a bit map, both of fixed size.  Sets are
   ordered rare shingles first, the same way everywhere: those certainly of one text only,
   then by (count, hash).  Equal sets are one from here on.
2. A set of n can only reach the threshold with another when they share one of its first
   n - ceil(t n) + 1 shingles.  Those go to a shuffle by shingle, but for the ones certainly of
   one text only; a stream over each shingle's sets, sorted by size, drops shingles of a single
   set and pairs each set with the first set of a comparable size.
3. Pairs are verified exactly: the sets paired with one set form a prefix tree, held as its
   leaves in depth-first order with the length each shares with the leaf before.  The
   overlap of a shared part is counted once, and a branch is left as soon as what remains of
   both sets can't reach the threshold.
4. Components of the links.  Rounds pair each set with one set of another component that shares
   a shingle, the likeliest of some next to it in drawn orders, and unite what links.  All sets that then still share a shingle in
   different components are paired and verified too, at the first shingle they share, under the
   same bounds and one more: parity bits of both sets differ in no more places than the sets
   do.  Sets already connected need no further link.  So no link between different components
   is lost, and groups of many near copies never become all their pairs.

Hashes have 64 bits; equal fingerprints with different sets raise an error.

Defined results: a text without words or a null has no shingles and its own id as component;
rows with equal ids are separate rows; a null id never names a component unless alone; ties
at the threshold link; an empty table gives an empty one.  Only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bloom import CHUNK_DDL, TwiceFilter, may_contain, merged_chunks
from keyloom.llm.components import components
from keyloom.llm.textops import NOT_WHITE, blocks, buffers, byte_table, mix, span_hashes, spare_name, window_hashes, word_spans
from keyloom.session import settled_alone
from keyloom.session import settled_clean as settled

WORDS = 5
#: The threshold as a fraction, so that it is tested in whole numbers.
PART, OF = 75, 100
SKETCH = 1 << 20
SKETCH_CHUNK = 1 << 13
#: Bits of the map of shingles seen twice, and bits of it in one part while it is made.
MAP_BITS = 1 << 28
MAP_PART = 1 << 20
MAP_HELD = 1 << 22
#: Bits of a shingle's fine place, and of those in one part: the map gets what is twice among these.
PLACE_BITS = 40
PLACE_PART = 30
#: Bits of the map wanted for each shingle; a smaller corpus takes a map a power of two smaller.
MAP_ROOM = 16
#: Bits of the map wanted for each shingle seen twice, where only those are in it.
FINE_ROOM = 128
FILTER_BITS = 1 << 24
TREE = 512
PARITY_BITS = 512
HUB_PERCENT = 104
#: Rounds that pair sets of different components by one each: sizes mix in them in steps of e ** (1 / 20), then in steps as wide as the
#: threshold is, then in such steps from the middle of one to that of the next, so that like sizes at an edge meet as well.
SIZE_STEPS = ((20, 0.0), (3, 0.0), (3, 0.5))
ORDERS = 8
#: Sets before a set among which such a round looks for the likeliest one.
WINDOW = 32
#: Shingles of a set that tell whether a pair has met at an earlier one.
EARLIER = 64
FOLD = byte_table()


def shingle_sets(column: pa.Array, words: int):
    """(row, sorted distinct shingle hashes) of every text of a column."""
    data, offsets = buffers(column)
    for i, j, part, at in blocks(data, offsets):
        starts, ends, first = word_spans(part, at, NOT_WHITE)
        hashes = span_hashes(part, starts, ends, FOLD)
        shingles = window_hashes(hashes, words)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= words:
                yield i + k, np.unique(shingles[a : b - words + 1])
            elif b > a:  # fewer words: all of them, as one
                yield i + k, mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield i + k, np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Order:
    """The global order of shingles: certainly of one text only, then by counted rarity, then by value."""

    def __init__(self, counts: np.ndarray, twice: np.ndarray, shift: int):
        self.counts, self.twice, self.shift = counts, twice, np.uint32(shift)

    def alone(self, s: np.ndarray) -> np.ndarray:
        at = map_places(s) >> self.shift
        return (self.twice[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 == 0

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set in order, and how many of its shingles come first as they are certainly alone."""
        alone = self.alone(s)
        rest = s[~alone]
        rest = rest[np.argsort(self.counts[rest & np.uint64(SKETCH - 1)], kind="stable")]
        first = s[alone]
        return np.concatenate([first, rest]), len(first)


def map_places(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.uint32)


def gaps_of(places: np.ndarray) -> bytes:
    """Sorted places below 2 ** 20 as gaps of a byte each; 255 stands for 255 and goes on."""
    gaps = np.diff(places, prepend=np.uint32(0)).astype(np.int64)
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def places_of(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def fine_places(s: np.ndarray) -> np.ndarray:
    return s >> np.uint64(64 - PLACE_BITS)


def packed_gaps(places: np.ndarray) -> bytes:
    """Sorted places below 2 ** 32 as compressed gaps, their first bytes before their second ones and so on."""
    gaps = np.diff(places.astype("<u4"), prepend=np.zeros(1, "<u4"))
    return len(places).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_places(packed: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(packed.slice(0, 4).to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(packed.slice(4), 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def halved_bits(bits: np.ndarray) -> np.ndarray:
    """A bit for every two."""
    pairs = np.unpackbits(bits, bitorder="little").reshape(-1, 2)
    return np.packbits(pairs[:, 0] | pairs[:, 1], bitorder="little")


def scan(rows: DataFrame, words: int) -> DataFrame:
    """Rows (id, n, fp, proof) of documents and, with ``kind``, parts of the sketch (0) and of the map of places (1)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = T.StructField("id", rows.schema["id"].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("n int, fp long, proof binary, kind int, chunk int, data binary").fields])
    names, id_type = schema.names, to_arrow_type(id_field.dataType)

    def part_row(kind, k, data):
        empty = [pa.nulls(1, t) for t in (id_type, pa.int32(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*empty, pa.array([kind], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=names)

    def map_rows(places: np.ndarray):
        places = np.sort(places)
        cuts = np.searchsorted(places, np.arange(0, MAP_BITS + 1, MAP_PART))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield part_row(1, k, gaps_of(places[cuts[k] : cuts[k + 1]] - np.uint32(k * MAP_PART)))

    def run(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        held, used = np.empty(MAP_HELD, np.uint32), 0
        for batch in batches:
            n, fp, proof = [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                fp.append(fingerprint(s))
                proof.append(xxhash.xxh3_128_digest(s.tobytes()))
                if used + len(s) > len(held):
                    yield from map_rows(held[:used])
                    used = 0
                if len(s) > len(held):
                    yield from map_rows(map_places(s))
                else:
                    held[used : used + len(s)] = map_places(s)
                    used += len(s)
                np.add.at(sketch, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            m = batch.num_rows
            nothing = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(proof, pa.binary()), *nothing], names=names)
        yield from map_rows(held[:used])
        for k, part in enumerate(sketch.reshape(-1, SKETCH_CHUNK)):
            if part.any():
                yield part_row(0, k, part.astype(np.min_scalar_type(part.max())).tobytes())

    return rows.mapInArrow(run, schema)


def folded(parts: DataFrame, start, add, end) -> DataFrame:
    """(chunk, data): all parts of a chunk, one after the other, in one value; a task holds one at a time."""

    def run(batches):
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([end(total)], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total = k, start()
                total = add(total, c.as_buffer())
        if at is not None:
            yield done()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, data binary")


def global_order(parts: DataFrame, shingles: int | None = None, counted: bool = True) -> Order:
    """The sketch and the map of shingles seen twice: ``4 * SKETCH + MAP_BITS / 8`` bytes at most, at any size of data.

    With a number of ``shingles`` the parts have bits of the map (``scan``), which fills with all shingles.  Without it
    they have fine places (``paragraphs.place_parts``), and the map fills with those seen twice only.
    Without ``counted`` the parts have no sketch and are read once.  What is folded is written, so its shuffle goes.
    """
    shift = 0
    while shingles is not None and shift < 10 and MAP_BITS >> (shift + 1) >= MAP_ROOM * shingles:
        shift += 1

    def add_counts(total, c):
        c = np.frombuffer(c, f"u{c.size // SKETCH_CHUNK}").astype(np.uint32)  # as narrow as its greatest count lets it be
        total += np.minimum(c, ~total)  # stays at the greatest value rather than begin anew
        return total

    def add_places(total, c):
        once, twice = total
        places = places_of(np.frombuffer(c, np.uint8)) >> shift
        again = places[1:][places[1:] == places[:-1]]
        twice[again] = True
        twice[places[once[places]]] = True
        once[places] = True
        return total

    counts = np.zeros((SKETCH // SKETCH_CHUNK, SKETCH_CHUNK), np.uint32)
    if counted:
        for row in settled(folded(parts.where("kind = 0").select("chunk", "data"), lambda: np.zeros(SKETCH_CHUNK, np.uint32), add_counts, lambda t: t.tobytes()), "sketch").toLocalIterator():
            counts[row["chunk"]] = np.frombuffer(bytes(row["data"]), np.uint32)
    def add_fine(total, c):
        total.append(unpacked_places(c))
        return total

    def fine_bits(total):
        places = np.sort(np.concatenate(total))
        bits = np.zeros(MAP_BITS >> (PLACE_BITS - PLACE_PART), bool)
        bits[places[1:][places[1:] == places[:-1]] >> (PLACE_BITS - MAP_BITS.bit_length() + 1)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    width = (MAP_PART >> shift) // 8 if shingles is not None else MAP_BITS >> (PLACE_BITS - PLACE_PART + 3)
    twice = np.zeros((MAP_BITS >> shift) // 8, np.uint8)
    maps = parts.where("kind = 1").select("chunk", "data")
    if shingles is None:
        maps = folded(maps, list, add_fine, fine_bits)
    else:
        maps = folded(maps, lambda: (np.zeros(MAP_PART >> shift, bool), np.zeros(MAP_PART >> shift, bool)), add_places, lambda t: np.packbits(t[1], bitorder="little").tobytes())
    for row in settled(maps, "map").toLocalIterator():
        twice[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["data"], np.uint8)
    if shingles is None:  # few repeated shingles take a smaller map
        marked = int(np.bitwise_count(twice).sum(dtype=np.int64))
        while shift < 10 and MAP_BITS >> (shift + 1) >= FINE_ROOM * marked:
            shift += 1
            twice = np.concatenate([halved_bits(piece) for piece in np.split(twice, 16)])
    return Order(counts.ravel(), twice, shift)


def prefix_rows(rows: DataFrame, order, words: int, part: int, of: int) -> DataFrame:
    """(shingle, fp, n, at): the necessary prefix of every set, without shingles certainly alone.

    Copies in a task appear once.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            shingles, fps, ns, places = [], [], [], []

            def out():
                length = [len(x) for x in shingles]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(shingles).view(np.int64)),
                        pa.array(np.repeat(np.array(fps, np.int64), length)),
                        pa.array(np.repeat(np.array(ns, np.int32), length)),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["shingle", "fp", "n", "at"],
                )

            held = 0
            for _, s in shingle_sets(batch.column(1), words):
                fp = fingerprint(s)
                if not len(s) or fp in seen:
                    continue
                seen.add(fp)
                if len(seen) > 1_000_000:  # only saves rows: copies meet again in the shuffle
                    seen.clear()
                take = len(s) - -(-part * len(s) // of) + 1
                ordered, alone = order.value.sort(s)
                if alone >= take:
                    continue
                shingles.append(ordered[alone:take])
                fps.append(fp)
                ns.append(len(s))
                places.append(np.arange(alone, take, dtype=np.int32))
                held += take - alone
                if held > 50_000:
                    yield out()
                    shingles, fps, ns, places, held = [], [], [], [], 0
            if held:
                yield out()

    return rows.mapInArrow(run, "shingle long, fp long, n int, at int")


def bounded(a_n, b_n, a_at, b_at, part: int, of: int):
    """Size and position bounds of a pair whose first common shingle is at the given places.

    Works on columns and on arrays: ``(of + part) * overlap >= part * (a_n + b_n)`` must still be possible.
    """
    left_a, left_b = a_n - a_at, b_n - b_at
    need = part * (a_n + b_n)
    return (of * a_n >= part * b_n) & (of * b_n >= part * a_n) & ((of + part) * left_a >= need) & ((of + part) * left_b >= need)


def shared_shingles(prefixes: DataFrame, part: int, of: int) -> DataFrame:
    """Prefix rows whose shingle several sets have, each with ``hub``: a set to compare it with, or null.

    Rows of a shingle come sorted by size.  The first of them is the hub until a set is some
    percent larger, is compared with it and takes its place: sets of like size are the likeliest to
    be similar.  The stream holds one row of a group.
    """
    names = ["shingle", "fp", "n", "at", "hub"]

    def run(batches):
        last = None  # the latest row: shingle, fp, n, at
        alone = True  # it is the first of its shingle and waits for a second
        hub = None
        for batch in batches:
            sh, fp, n, at = (c.to_numpy() for c in batch.columns)
            out: list[tuple] = []
            # only rows next to one of the same shingle matter
            near = np.zeros(len(sh), bool)
            same = sh[1:] == sh[:-1]
            near[1:] |= same
            near[:-1] |= same
            near[[0, -1]] = True
            for s, f, m, p in zip(sh[near].tolist(), fp[near].tolist(), n[near].tolist(), at[near].tolist()):
                if last is not None and last[0] == s:
                    if last[1] == f:
                        continue  # a copy
                    if alone:
                        out.append((*last, None))
                        alone = False
                    mine = hub[1] if bounded(hub[2], m, hub[3], p, part, of) else None
                    if 100 * m > HUB_PERCENT * hub[2]:
                        hub = (s, f, m, p)
                    last = (s, f, m, p)
                    out.append((*last, mine))
                else:
                    last = hub = (s, f, m, p)
                    alone = True
            if out:
                cells = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

    ordered = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "fp")
    return ordered.mapInArrow(run, "shingle long, fp long, n int, at int, hub long")


def filter_bits(ids: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the one long column of ``ids``, of ``bits / 8`` bytes."""

    def run(batches):
        seen = TwiceFilter(bits)
        for batch in batches:
            seen.add(batch.column(0).to_numpy().view(np.uint64))
        yield seen.chunks()

    out = bytearray(bits // 8)
    for row in merged_chunks(ids.mapInArrow(run, CHUNK_DDL)).select("chunk", "once").toLocalIterator():
        out[row["chunk"] * (1 << 13) : (row["chunk"] + 1) * (1 << 13)] = bytes(row["once"])
    return bytes(out)


def wanted_sets(rows: DataFrame, wanted: DataFrame, order, words: int, bits: int) -> DataFrame:
    """(fp, members): the ordered sets whose ``fp`` is in ``wanted``, once each."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_bits(wanted, bits))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            fps, sets = [], []
            for _, s in shingle_sets(batch.column(1), words):
                fp = fingerprint(s)
                if len(s) and fp not in seen and may_contain(shared.value, bits, np.array([fp], np.int64).view(np.uint64))[0]:
                    seen.add(fp)
                    fps.append(fp)
                    sets.append(order.value.sort(s)[0].tobytes())
                if len(fps) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "members"])
                    fps, sets = [], []
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "members"])

    return rows.mapInArrow(run, "fp long, members binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def tree_links(probe: np.ndarray, leaves: list[np.ndarray], part: int, of: int, step: int = 64) -> np.ndarray:
    """Which of the ordered sets reach the threshold with ``probe``, by one walk over their prefix tree."""
    values = np.sort(probe)
    order = sorted(range(len(leaves)), key=lambda k: leaves[k].tobytes())
    out = np.zeros(len(leaves), bool)
    before: np.ndarray | None = None
    counted = np.zeros(1, np.int64)  # overlap of the first 0, 1, ... shingles of the branch
    for k in order:
        leaf = leaves[k]
        shared = 0
        if before is not None:
            m = min(len(before), len(leaf), len(counted) - 1)
            differ = np.flatnonzero(before[:m] != leaf[:m])
            shared = int(differ[0]) if len(differ) else m
        done = [counted[: shared + 1]]
        overlap, at = int(counted[shared]), shared
        need = -(-part * (len(values) + len(leaf)) // (of + part))
        while at < len(leaf) and overlap + min(len(leaf) - at, len(values) - overlap) >= need:
            piece = leaf[at : at + step]
            place = np.minimum(np.searchsorted(values, piece), len(values) - 1)
            run = overlap + np.cumsum(values[place] == piece)
            done.append(run)
            overlap, at = int(run[-1]), at + len(piece)
        out[k] = at == len(leaf) and overlap >= need
        before, counted = leaf, np.concatenate(done)
    return out


def verified(pairs: DataFrame, sets: DataFrame, part: int, of: int, tree: int = TREE) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    Pairs of one ``a`` are dealt in blocks of about ``tree``, so a set with very many partners is the
    work of many tasks.
    """
    blocks_of = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("blocks"))
    dealt = pairs.join(blocks_of, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    leaves = dealt.join(sets.select(F.col("fp").alias("b"), "members"), "b").select("a", "block", "b", "members")
    probes = blocks_of.join(sets.select(F.col("fp").alias("a"), "members"), "a")
    probes = probes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "members")
    rows = probes.unionByName(leaves).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        probe, key, held = None, None, []

        def links():
            yes = tree_links(probe, [s for _, s in held], part, of)
            b = [x for (x, _), y in zip(held, yes) if y]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(b), pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            a, block, b, members = batch.columns
            for i in range(batch.num_rows):
                s = np.frombuffer(members[i].as_buffer(), np.uint64)
                if not b[i].is_valid:
                    if held:
                        yield links()
                    probe, key, held = s.copy(), (a[i].as_py(), block[i].as_py()), []
                else:
                    held.append((b[i].as_py(), s.copy()))
                    if len(held) >= 2 * tree:
                        yield links()
                        held = []
        if held:
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def parities(sets: DataFrame) -> DataFrame:
    """(fp, p0, p1, ...): for each of ``PARITY_BITS`` classes of shingles, whether a set has an odd number of them."""
    names = ["fp", *[f"p{k}" for k in range(PARITY_BITS // 64)]]

    def run(batches):
        for batch in batches:
            odd = np.zeros((batch.num_rows, PARITY_BITS), np.uint8)
            for i, members in enumerate(batch.column(1)):
                s = np.frombuffer(members.as_buffer(), np.uint64)
                odd[i] = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
            words = np.packbits(odd, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1])]], names=names)

    return sets.select("fp", "members").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def swept(placed: DataFrame, odd: DataFrame, seed: int, steps: tuple[int, float], part: int, of: int, window: int = WINDOW) -> DataFrame:
    """(a, b): each set with one set of another component that shares a shingle, as many pairs as rows at most.

    Sets of a shingle and of like size come in one of some orders drawn by ``seed``, those with an equal word of parities
    (``odd``) together, as small similar sets are likely to have; of the ``window`` sets before it and the last one whose
    component differs, a set meets the one whose parities differ least, if they let the pair reach the threshold.
    A hot shingle spans tasks, as the order is dealt by ranges.
    """
    order = ["shingle", "size", "place", "turn"]
    words = odd.columns[1:]
    word = F.element_at(F.array(*words), (F.pmod(F.col("shingle") + seed, F.lit(len(words))) + 1).cast("int"))
    rows = placed.join(odd, "fp").withColumn("size", F.floor(F.log("n") * steps[0] + steps[1])).withColumn("place", F.xxhash64(word, F.lit(seed)))
    rows = rows.withColumn("turn", F.xxhash64("fp", F.pmod("shingle", F.lit(ORDERS)), F.lit(seed)))
    rows = rows.select(*order, "fp", "n", "at", "component", *words).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        held = None  # the latest rows and the one that the last of them has met, before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in (0, 4, 5, 6, 7)]
            bits = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[8:]], axis=1)  # bitwise_count takes the absolute value of others
            old = 0 if held is None else len(held[0])
            if old:
                *columns, bits = (np.concatenate([h, c]) for h, c in zip(held, [*columns, bits]))
            sh, fp, n, at, component = columns
            begins = np.ones(len(sh), bool)  # of a run of one shingle and component
            begins[1:] = (sh[1:] != sh[:-1]) | (component[1:] != component[:-1])
            met = np.maximum.accumulate(np.where(begins, np.arange(len(sh)), 0)) - 1
            mine = np.arange(old, len(sh))
            least, with_ = np.full(len(mine), of * PARITY_BITS, np.int64), np.full(len(mine), -1)
            for k in range(window + 1):
                other = mine - k if k else met[mine]
                some = np.flatnonzero(other >= 0)
                i, j = mine[some], other[some]
                yes = (sh[i] == sh[j]) & (component[i] != component[j])
                some, i, j = some[yes], i[yes], j[yes]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                yes = (differ < least[some]) & (differ * (of + part) <= (n[i] + n[j]) * (of - part)) & bounded(n[i], n[j], at[i], at[j], part, of)
                least[some[yes]], with_[some[yes]] = differ[yes], j[yes]
            i, j = mine[with_ >= 0], with_[with_ >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j]))], names=["a", "b"])
            first = max(0, len(sh) - max(window, 1))
            last = [k for k in (met[-1],) if 0 <= k < first] + list(range(first, len(sh)))
            held = [c[last] for c in (*columns, bits)]

    return rows.mapInArrow(run, "a long, b long").distinct()


def across_components(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``shared`` whose shingle is in sets of several components, with the component."""

    def across():
        placed = shared.join(found, shared["fp"] == found["node"], "left").select("shingle", "fp", "n", "at", F.coalesce("component", "fp").alias("component"))
        placed = settled(placed, "placed")
        split = placed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle")
        return placed.join(split, "shingle", "left_semi")

    return settled_alone(shared.sparkSession, across, "across")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, best): every set with its hubs, once each; ``best`` marks the hub at most of its shingles, one a set.

    Most sets link with that one, which makes their other pairs needless.
    """
    pairs = shared.where("hub IS NOT NULL").groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("times"))
    hubs = pairs.groupBy("fp").agg(F.max(F.struct("times", "hub"))["hub"].alias("most"))
    # a hub comes before its sets by (n, fp), so no pair comes twice
    return pairs.join(hubs, "fp").select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b"), (F.col("hub") == F.col("most")).alias("best"))


def apart_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    x, y = (found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab")
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(~F.coalesce("of_a", "a").eqNullSafe(F.coalesce("of_b", "b"))).select("a", "b")


def connected(shared: DataFrame, sets_of, part: int, of: int) -> DataFrame:
    """(node, component) of all sets linked to others, from the rows of ``shared_shingles``.

    ``sets_of`` gives a written table of (fp, members) that has all of a table of wanted ``fp``.
    """

    def united(links: DataFrame) -> DataFrame:
        return settled_alone(links.sparkSession, lambda: components(links), "found")

    tried = settled(hub_pairs(shared), "pairs")
    sets = sets_of(shared.select("fp").distinct())
    links = settled(verified(tried.where("best"), sets, part, of), "links")
    found = united(links)
    rest = settled(apart_pairs(tried.where("NOT best"), found), "pairs")
    more = settled(verified(rest, sets, part, of), "links")
    if not more.isEmpty():
        found = united(more.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    tried = tried.where("best").select("a", "b").unionAll(rest)
    rows = across_components(shared, found)
    odd = settled(parities(sets), "parities")

    for seed, steps in enumerate(SIZE_STEPS):
        pairs = settled(swept(rows, odd, seed, steps, part, of).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = settled(verified(pairs, sets, part, of), "links")
        if more.isEmpty():
            continue
        tried = tried.unionAll(pairs)
        found = united(more.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        rows = across_components(rows.drop("component"), found)

    # what is left is compared in full, a pair at the first shingle that both sets have here
    met = rows.groupBy("fp").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "shingle"))), 1, EARLIER).alias("met"))
    rows = rows.join(met, "fp").join(odd, "fp")
    rows = settled(rows.withColumn("met", F.transform(F.filter("met", lambda x: x["at"] < F.col("at")), lambda x: x["shingle"])), "across")
    bits = [f"p{k}" for k in range(PARITY_BITS // 64)]
    a, b = (rows.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "at", "component", "met", *bits)]) for side in "ab")
    may = bounded(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"), part, of)
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in bits), F.lit(0))
    may = may & (differ * (of + part) <= (F.col("n_a") + F.col("n_b")) * (of - part)) & ~F.arrays_overlap("met_a", "met_b")
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("component_a") != F.col("component_b")) & (F.col("fp_a") < F.col("fp_b")) & may)
    pairs = pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = settled(verified(settled(pairs, "pairs"), sets, part, of), "links")
    if more.isEmpty():
        return found
    return components(more.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, part: int = PART, of: int = OF, bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when ``of`` x intersection >= ``part`` x union of their shingle sets.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = settled(scan(rows, words), "scan")
    documents = scanned.where("kind IS NULL").select("id", "n", "fp", "proof")
    clash = documents.where("n > 0").groupBy("fp").agg(F.min("proof").alias("x"), F.max("proof").alias("y")).where("x != y")
    if not clash.isEmpty():
        raise RuntimeError("two different shingle sets have one fingerprint")
    shingles = documents.agg(F.sum("n")).head()[0] or 0
    order = spark.sparkContext.broadcast(global_order(scanned, shingles))
    shared = settled(shared_shingles(prefix_rows(rows, order, words, part, of), part, of), "shared")

    def sets_of(wanted):
        sets = settled(wanted_sets(rows, settled(wanted, "wanted"), order, words, bits), "sets")
        order.destroy()  # all that needs it is written
        return sets

    found = connected(shared, sets_of, part, of)

    group = documents.join(found, documents["fp"] == found["node"], "left").select("id", "n", F.coalesce("component", "fp").alias("component"))
    group = settled(group, "groups")
    least = settled(group.where("n > 0").groupBy("component").agg(F.min("id").alias("least")), "least")
    named = group.where("n > 0").join(least, "component").select("id", "n", F.col("least"))
    alone = group.where("n = 0").select("id", "n", F.col("id").alias("least"))
    return named.unionAll(alone).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose document has the least id of its component."""
    found = near_duplicates(df, id_col, text_col, **options)
    first = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__first")).distinct()
    return df.join(first, df[id_col].eqNullSafe(first["__first"]), "left_semi")


def keep_one_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every group of near duplicates: of the least id (a null one after all others), then of the least hash of the text.

    ``keep_one`` keeps all rows of an id; here equal rows count as copies too.  Rows without words stay.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("hash"))
    found = near_duplicates(df.select(row.alias("doc_id"), text.alias("text")), **options)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    mine = [spare_name(df.columns, c) for c in ("first_none", "first_id", "first_hash", "first_n", "first_row")]
    first = first.select(*[F.col(f"doc_id.{c}") for c in ("none", "id", "hash")], "n").toDF(*mine[:4])
    kept = df.join(first, F.xxhash64(text).eqNullSafe(F.col(mine[2])) & id_.eqNullSafe(F.col(mine[1])))
    kept = kept.withColumn(mine[4], F.when(F.col(mine[3]) == 0, F.monotonically_increasing_id()))
    return kept.dropDuplicates([mine[1], mine[2], mine[4]]).select([F.col(f"`{c}`") for c in df.columns])
