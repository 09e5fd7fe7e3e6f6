"""Source divergence audit: how far the word use of every source lies from others of its language.

One ``bytes.translate`` lowers the letters of a text and blanks everything that is no part of a
term, ``bytes.split`` cuts it, and a Counter per document says which terms it has and how
often.  A task adds these up by (language, source), so what is shuffled is one row per task, group and term.

A language keeps the terms of at least ``least_docs`` of its documents.  A group gives a kept
term the probability p = 1 + floor(scale (count + prior) / (N + prior V)), in integers; V is
the number of kept terms of the language and N the group's occurrences of them.  Sums over
*all* kept terms are taken block by block of terms: a block's counts and the language's
sources meet in one task, as a matrix in which a missing count has the group's probability of nothing.

Defined results: a null text, language or source is an empty one; a group without terms takes
part with N = 0; a language without kept terms has value 0 for every pair and no term rows;
repeated rows are documents of their own; an empty table gives no rows.  Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.textops import row_batches
from keyloom.session import settled

SCALE = 1_000_000_000
PRIOR = 5
LEAST_DOCS = 30
TOP_TERMS = 50
#: Terms of one block of the pair sums, and entries and bytes a task gathers before it hands them on.
BLOCK_TERMS = 2048
HELD_ENTRIES = 400_000
HELD_BYTES = 1 << 28
SEGMENT = 1 << 22

#: Lower case; a blank for everything but letters and bytes of non-ASCII characters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def segments(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    plain = raw.translate(TABLE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SEGMENT)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counter(raw: bytes) -> Counter:
    """How often each term occurs in one text."""
    found: Counter = Counter()
    for words in segments(raw):
        found.update(words)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, documents, occurrences), added up within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, times) in held.items():
            n = len(times)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n),
                        pa.array([source] * n),
                        pa.array(list(times), pa.binary()),
                        pa.array([docs[t] for t in times], pa.int64()),
                        pa.array(list(times.values()), pa.int64()),
                    ],
                    names=["lang", "source", "term", "docs", "n"],
                )

    for batch in batches:
        for part in row_batches(batch, 200):
            texts = part.column(2).cast(pa.large_binary())
            for lang, source, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts.to_pylist()):
                if not raw:
                    continue
                docs, times = held.setdefault((lang, source), (Counter(), Counter()))
                mine = term_counter(raw)
                docs.update(mine.keys())
                times.update(mine)
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size > HELD_BYTES or sum(len(t) for _, t in held.values()) > HELD_ENTRIES:
                yield from handed()
                held.clear()
                size = 0
    yield from handed()


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, docs, n): documents of the group with the term, and occurrences."""
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, docs long, n long")
    return counted.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)); decimals, as the product may pass 64 bits."""
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + PRIOR * terms).cast("decimal(20,0)"))


def _block_distances(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of one block, for every ordered pair of sources."""
    sources = groups.column("g_source").to_pylist()
    base = groups.column("base").to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    terms = counts.column("term").dictionary_encode().combine_chunks()
    grid = np.tile(base, (len(terms.dictionary) if counts.num_rows else 0, 1))
    if counts.num_rows:
        grid[terms.indices.to_numpy(), [place[s] for s in counts.column("source").to_pylist()]] = counts.column("p").to_numpy()
    names, others, values = [], [], []
    for i, s in enumerate(sources):
        far = np.abs(grid - grid[:, i : i + 1]).sum(axis=0)
        names += [s] * (len(sources) - 1)
        others += sources[:i] + sources[i + 1 :]
        values.append(np.delete(far, i))
    value = np.concatenate(values) if values else np.zeros(0, np.int64)
    lang = pa.array([key[0].as_py()] * len(names), pa.string())
    return pa.table([lang, pa.array(names, pa.string()), pa.array(others, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def divergence(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language by its distance, the sum of |p - q| over
    all kept terms.  Part ``term``: the group's terms by how much more it uses them than the language, the first ``top_terms``.
    """
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(df, lang_col, source_col, text_col)
    everywhere = counted.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    kept = settled(everywhere.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    # as many rows as there are groups
    found = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").count().withColumnRenamed("count", "terms")
    totals = kept.groupBy("lang").agg(F.sum("n").alias("all_n"))
    groups = found.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").join(totals, "lang", "left")
    groups = settled(groups.fillna(0, ["group_n", "terms", "all_n"]), "groups")

    rated = kept.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("n"), F.col("group_n"), F.col("terms")))
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("long")
    counts = rated.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p")
    base = F.when(F.col("terms") > 0, _probability(F.lit(0).cast("long"), F.col("group_n"), F.col("terms"))).otherwise(F.lit(0)).cast("long")
    stages = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("source").alias("g_source"), base.alias("base"))
    parts = counts.groupBy("lang", "block").cogroup(stages.groupBy("lang", "block")).applyInArrow(_block_distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    lang_p = _probability(F.col("lang_n"), F.col("all_n"), F.col("terms"))
    above = rated.select("lang", "source", F.col("term").alias("item"), (F.col("p") - lang_p).alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    first = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(shown).unionAll(first.withColumn("part", F.lit("term")).select(shown))
