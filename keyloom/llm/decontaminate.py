"""Benchmark decontamination: words of documents inside passages of benchmark items.

A window is ``window`` consecutive words of an item, or a shorter item as a whole.  It is a
set of shingles that must all occur in a document, so its necessary prefix in an order by
rarity is its rarest shingle alone (a required overlap of n out of n shingles leaves a prefix
of n - n + 1).  Documents are probed with those prefix shingles only; a hit fixes where the
window would lie, which must fit between the text's ends (length and position bounds), and
is then verified word for word over the whole window.

Rarity is the number of occurrences in all documents, counted in a pass of its own.

The index holds one block of items at a time, of at most ``block_words`` words: that is the
bound of what is broadcast.  A larger benchmark takes several passes, whose hits are united.

Defined results: null or empty texts have no words; an item without words has no window and a
null item counts as such; equal windows of several items hit for each of them; rows with equal
item ids are one item; a null item id is not an item; an empty table of documents or items
gives no hits.  Documents are judged row by row.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.textops import ALNUM, blocks, buffers, byte_table, map_arrow, spare_name, span_hashes, window_hashes, word_spans
from keyloom.session import settled

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 2_000_000
FOLD = byte_table()
#: Lower case, and a blank for everything that is not part of a word.
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(data, starts, ends, FOLD)


def _sieve(hashes: np.ndarray) -> np.ndarray:
    """A small table that lets through all given hashes and few others."""
    table = np.zeros(1 << 18, bool)
    table[hashes & np.uint64((1 << 18) - 1)] = True
    return table


def _through(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(sieve[hashes & np.uint64((1 << 18) - 1)])


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        holders: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                holders[tuple(words[i : i + size])].add(item)
        self.words = list(holders)
        self.items = [sorted(x) for x in holders.values()]
        # shorter windows have shingles of their own length, so each size is a class of its own
        self.sizes = [min(shingle, len(w)) for w in self.words]
        self.shingles = [window_hashes(_hash_words(list(w)), s) for w, s in zip(self.words, self.sizes)]

    def vocabulary(self) -> dict[int, np.ndarray]:
        """Distinct shingles by size."""
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for s, h in zip(self.sizes, self.shingles):
            by[s].append(h)
        return {s: np.unique(np.concatenate(h)) for s, h in by.items()}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By size: prefix shingle -> windows and the place of the shingle in them."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (s, h) in enumerate(zip(self.sizes, self.shingles)):
            at = min(range(len(h)), key=lambda i: (counts.get((s, int(h[i])), 0), int(h[i])))
            if counts.get((s, int(h[at])), 0):  # a shingle no document has: no occurrence
                out[s][int(h[at])].append((k, at))
        return {s: dict(x) for s, x in out.items()}


def _document_words(column: pa.Array):
    """By block: index of the first text, raw bytes, word spans, hashes, words before each text."""
    data, offsets = buffers(column)
    for i, j, part, at in blocks(data, offsets):
        starts, ends, first = word_spans(part, at, ALNUM)
        yield i, j, part, starts, ends, span_hashes(part, starts, ends, FOLD), first


def shingle_counts(texts: DataFrame, vocabulary: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Occurrences of the given shingles over all documents; as many rows as given shingles at most."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        sieves = {s: _sieve(h) for s, h in known.items()}
        totals = {s: np.zeros(len(h), np.int64) for s, h in known.items()}
        for batch in batches:
            for _, _, _, _, _, hashes, first in _document_words(batch.column(0)):
                for s, mine in known.items():
                    h = window_hashes(hashes, s)
                    at = _through(sieves[s], h)
                    place = np.minimum(np.searchsorted(mine, h[at]), len(mine) - 1)
                    ok = mine[place] == h[at]
                    # a shingle may not reach over the end of its text
                    ok &= at + s <= first[np.searchsorted(first, at, "right").clip(max=len(first) - 1)]
                    totals[s] += np.bincount(place[ok], minlength=len(mine))
        for s, mine in known.items():
            some = np.flatnonzero(totals[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), s, np.int32)), pa.array(mine[some].view(np.int64)), pa.array(totals[s][some])], names=["size", "shingle", "n"]
            )

    counted = texts.mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    return {(r["size"], r["shingle"] & (2**64 - 1)): r["n"] for r in counted.collect()}


def _matches(windows: Windows, prefixes, raw: bytes, starts, ends, hashes, first, sieves, ordered):
    """(text, first word, window) of every occurrence in a block."""
    plain = None
    for s, table in prefixes.items():
        h = window_hashes(hashes, s)
        at = _through(sieves[s], h)
        place = np.minimum(np.searchsorted(ordered[s], h[at]), len(ordered[s]) - 1)
        at = at[ordered[s][place] == h[at]]
        if not len(at):
            continue
        plain = plain or raw.translate(PLAIN)
        text = np.searchsorted(first, at, "right") - 1
        for p, t, key in zip(at.tolist(), text.tolist(), h[at].tolist()):
            low, high = int(first[t]), int(first[t + 1])
            for k, offset in table[key]:
                words = windows.words[k]
                begin = p - offset
                if begin < low or begin + len(words) > high:
                    continue
                if all(plain[starts[begin + i] : ends[begin + i]] == w for i, w in enumerate(words)):
                    yield t, begin, k


def hits(df: DataFrame, items: list[tuple[str, str]], text_col: str, window: int, shingle: int, added: list[str]) -> DataFrame:
    """``df`` with three more columns: words, [begin, end) runs of hit words, ids of items with occurring windows."""
    found = Windows(items, window, shingle)
    counts = shingle_counts(df.select(text_col), found.vocabulary()) if found.words else {}
    shared = df.sparkSession.sparkContext.broadcast((found, found.prefixes(counts)))
    at = df.columns.index(text_col)
    names = [*df.columns, *added]
    run_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batch):
        windows, prefixes = shared.value
        ordered = {s: np.sort(np.array(list(t), np.uint64)) for s, t in prefixes.items()}
        sieves = {s: _sieve(h) for s, h in ordered.items()}
        n_words = np.zeros(batch.num_rows, np.int64)
        runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        seen: list[set[str]] = [set() for _ in range(batch.num_rows)]
        for i, j, part, starts, ends, hashes, first in _document_words(batch.column(at)):
            n_words[i:j] = np.diff(first)
            spans = defaultdict(list)
            for t, begin, k in _matches(windows, prefixes, part.tobytes(), starts, ends, hashes, first, sieves, ordered):
                spans[t].append((begin - int(first[t]), begin - int(first[t]) + len(windows.words[k])))
                seen[i + t].update(windows.items[k])
            for t, mine in spans.items():
                runs[i + t] = [{"begin": a, "end": b} for a, b in united(mine)]
        new = [pa.array(n_words), pa.array(runs, run_type), pa.array([sorted(x) for x in seen], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{added[0]}` long, `{added[1]}` array<struct<begin:long,end:long>>, `{added[2]}` array<string>").fields])
    return map_arrow(df, run, schema)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, block_words: int):
    """Lists of (id, text) of at most ``block_words`` words each (one longer item: alone)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    block: list[tuple[str, str]] = []
    words = 0
    for row in items.where("item IS NOT NULL").orderBy("item", "text").toLocalIterator():  # a block at a time on the driver
        n = len(words_of(row["text"]))
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row["item"], row["text"]))
        words += n
    yield block


def mark(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``df`` with ``n_words``, ``hit_runs`` (runs of hit words) and ``hit_items`` added.

    A new name that ``df`` already has gets an underscore at its end.
    """
    added: list[str] = []
    for name in ("n_words", "hit_runs", "hit_items"):
        added.append(spare_name([*df.columns, *added], name))
    out = None
    for block in item_blocks(benchmark, item_col, item_text, block_words):
        if out is None:
            out = hits(df, block, text_col, window, shingle, added)
            continue
        out = settled(out, "marked")  # several blocks: the runs so far are united with those of the next
        more = [spare_name(out.columns, a + "_more") for a in added]
        out = hits(out, block, text_col, window, shingle, more)
        out = out.withColumn(added[1], union_runs(F.concat(F.col(added[1]), F.col(more[1])))).withColumn(added[2], F.array_sort(F.array_union(added[2], more[2]))).drop(*more)
    return out


def union_runs(runs):
    """Sorted disjoint runs out of any."""
    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["begin"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(runs), empty, step)


def n_hit(runs):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without any hit word, with their own columns."""
    marked = mark(df, benchmark, text_col, **options)
    runs = marked.columns[len(df.columns) + 1]
    return marked.where(F.size(F.col(f"`{runs}`")) == 0).select([F.col(f"`{c}`") for c in df.columns])


