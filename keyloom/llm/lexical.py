"""Ranked lexical search by the Best Position Algorithm.

A document's score for an item sums, over the item's terms, an integer impact that falls
with the term's commonness and the document's length.  Documents are dealt into shards.  A shard has one
impact list per term, its documents by falling impact.  The lists of an item are
read side by side; a document met for the first time is looked up in all of them (direct
access), which marks its places there as seen.  A list's best position is the last place up to
which every place is seen, often far beyond the last one read.  No unseen document can
score more than the sum of the impacts at the best positions, so the shard is left
once that sum is strictly below the k-th best score so far; ties are thus read to the end.

Blocks of items of at most ``block_words`` words are searched one after the other; that bounds the
vocabulary, whose document frequencies pass the driver and are sent to the tasks.  A
block's index (the block's terms in each document) is written once to the shared scratch
folder, so its counts and the search read the texts one time only.

Defined results: a null or empty text has no terms and is not counted among the documents; an
item without terms finds nothing; rows with equal item ids are one item with the terms of
all; a null item id is no item; documents are judged row by row, repeated rows and null ids
(last among equal scores) included; an empty table of documents or items gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyloom.llm.decontaminate import PLAIN, item_blocks, words_of
from keyloom.llm.textops import row_batches
from keyloom.session import settled

BEST = 10
BLOCK_WORDS = 200_000
SHARD_ROWS = 8192
SEGMENT = 1 << 22
#: Sorted accesses of the first round, over all lists of an item; later rounds double.
FIRST_READS = 128


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    plain = raw.translate(PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SEGMENT)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def block_index(df: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times): number of terms of every document that has any, and those in the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n long, terms array<int>, times array<long>").fields])

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in row_batches(batch, 500):
                keep, sizes, terms, times = [], [], [], []
                for i, raw in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
                    found: Counter = Counter()
                    for words in _words(raw or b""):
                        found.update(words)
                    if not found:
                        continue
                    mine = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                    keep.append(i)
                    sizes.append(found.total())
                    terms.append([t for t, _ in mine])
                    times.append([c for _, c in mine])
                cells = [part.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "n", "terms", "times"])

    return rows.mapInArrow(run, schema)


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents holding each term of the vocabulary, over the whole index."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the vocabulary at most
        out[r["term"]] = r["df"]
    return out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n n_docs) div n_terms, rounding down."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * n_docs // n_terms
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shard:
    """Impact lists of some documents, and every document's places in them."""

    def __init__(self, ids: list, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.offsets, self.terms = ids, offsets, terms
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        self.impact = impacts(weights[terms], tf, n[doc], n_docs, n_terms)
        order = np.lexsort((doc, -self.impact, terms))
        #: Along the lists: document and impact of every place; by document: the places.
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.slot = np.full(len(weights), False)

    def search(self, terms: np.ndarray, best: list[tuple], k: int) -> tuple[list[tuple], int]:
        """``best`` with this shard's documents, sorted and cut to k, and how many documents were looked up.

        Entries are (-score, id is null, id).
        """
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        begin, end = self.begin[terms], self.begin[terms + 1]
        if not len(terms):
            return best, 0
        self.slot[terms] = True
        met = np.zeros(len(self.ids), bool)
        seen = np.zeros(len(self.list_doc), bool)
        at, reads, looked = 0, max(1, FIRST_READS // len(terms)), 0
        reach = begin.copy()  # one past the best position of each list
        while True:
            rows = begin[:, None] + np.arange(at, at + reads)
            docs = np.unique(self.list_doc[rows[rows < end[:, None]]])
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                looked += len(docs)
                size = self.offsets[docs + 1] - self.offsets[docs]
                owner = np.repeat(np.arange(len(docs)), size)
                entry = np.arange(len(owner)) + np.repeat(self.offsets[docs] - (np.cumsum(size) - size), size)
                mine = self.slot[self.terms[entry]]
                entry, owner = entry[mine], owner[mine]
                seen[self.place[entry]] = True
                score = np.zeros(len(docs), np.int64)
                np.add.at(score, owner, self.impact[entry])
                least = -best[-1][0] if len(best) >= k else 1
                new = [(-int(s), self.ids[d] is None, self.ids[d]) for s, d in zip(score, docs) if s >= least]
                if new:
                    best = sorted(best + new)[:k]
            at += reads
            reads *= 2
            for i in range(len(terms)):
                while reach[i] < end[i] and seen[reach[i]]:
                    ahead = seen[reach[i] : min(reach[i] + 1024, end[i])]
                    reach[i] += len(ahead) if ahead.all() else int(ahead.argmin())
            open_lists = reach < end
            if not open_lists.any():
                break
            if len(best) >= k and self.list_impact[np.maximum(reach[open_lists] - 1, begin[open_lists])].sum() < -best[-1][0]:
                break
        self.slot[terms] = False
        return best, looked


def search_block(df: DataFrame, items: list[tuple[str, str]], id_col: str, text_col: str, best: int, shard_rows: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every task for each item of one block."""
    wanted: dict[str, set[bytes]] = defaultdict(set)
    for item, text in items:
        wanted[item].update(words_of(text))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    index = settled(block_index(df, vocabulary, id_col, text_col), "lexical-index")
    whole = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).head()
    n_docs, n_terms = whole["docs"], whole["terms"] or 1
    df_of = document_frequencies(index, len(vocabulary))
    weights = np.array([term_weight(n_docs, int(x)) if x else 0 for x in df_of], np.int64)
    queries = [(item, np.array(sorted(vocabulary[t] for t in words if weights[vocabulary[t]] > 0), np.int64)) for item, words in sorted(wanted.items())]
    shared = df.sparkSession.sparkContext.broadcast((weights, [q for q in queries if len(q[1])]))
    id_type = index.schema["id"].dataType

    def run(batches):
        weights, queries = shared.value
        found: list[list[tuple]] = [[] for _ in queries]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part in row_batches(batch, shard_rows):
                terms = part.column(2)
                offsets = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                cells = (part.column(0).to_pylist(), part.column(1).to_numpy(), offsets, terms.flatten().to_numpy(), part.column(3).flatten().to_numpy())
                shard = Shard(*cells, weights, n_docs, n_terms)
                for i, (_, mine) in enumerate(queries):
                    found[i], _ = shard.search(mine, found[i], best)
        if kind is not None:
            flat = [(item, x) for (item, _), hits in zip(queries, found) for x in hits]
            cells = [pa.array([i for i, _ in flat], pa.string()), pa.array([x[2] for _, x in flat], kind), pa.array([-x[0] for _, x in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["item", "doc_id", "score"])

    return index.mapInArrow(run, T.StructType([T.StructField("item", T.StringType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))


def lexical_search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0."""
    parts = [search_block(df, block, id_col, text_col, best, shard_rows) for block in item_blocks(items, item_col, item_text, block_words)]
    hits = reduce(DataFrame.unionAll, parts)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("item").cast(items.schema[item_col].dataType).alias("item_id"), "rank", "doc_id", "score")
