"""Line dedup: a line found in several documents stays only in the first of them.

One pass fills two Bloom filters, of line keys seen in one document and in two or more; the
second filter goes to all tasks.  Only lines it suspects are shuffled: their keys are
grouped, which confirms a repeat exactly and finds its first document.

A line's key is the line without white space at both ends, A-Z lower-cased.  Keys under
``min_chars`` code points never repeat.  Defined results: a null or empty text is one empty
line and stays empty; rows with equal ids are one document (all of them keep or lose a line
alike); null ids are one document that comes after all others; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bloom import CHUNK_DDL, TwiceFilter, may_contain, twice_bits
from keyloom.llm.textops import WHITE, spare_name

MIN_CHARS = 10
FILTER_BITS = 1 << 26


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None where it is too short to count."""
    key = line.strip(WHITE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key.lower()


def _texts(column: pa.Array):
    for x in column:
        yield x.as_py().encode() if x.is_valid else b""


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def suspected(rows: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(id, hash, key) of every line whose key two documents may hold; ``rows`` has id, text and a hash of the text."""

    def fill(batches):
        seen = TwiceFilter(bits)
        last = object()
        for batch in batches:
            found = []
            for i, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if i != last:  # rows of one id next to each other are one document
                    held, last = set(), i
                fresh = _keys(text, min_chars) - held
                held |= fresh
                found.append(_hashes(fresh))
            seen.add(np.concatenate(found) if found else np.zeros(0, np.uint64))
        yield seen.chunks()

    def found(batch, at, out):
        of = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(out, pa.binary())], names=["id", "hash", "key"])

    twice = rows.sparkSession.sparkContext.broadcast(twice_bits(rows.mapInArrow(fill, CHUNK_DDL), bits))

    def pick(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(_texts(batch.column(1))):
                keys = list(_keys(text, min_chars))
                if keys:
                    hit = may_contain(twice.value, bits, _hashes(keys))
                    out += [keys[k] for k in np.flatnonzero(hit)]
                    at += [i] * int(hit.sum())
                if len(out) > 20_000:
                    yield found(batch, at, out)
                    at, out = [], []
            if out:
                yield found(batch, at, out)

    return rows.mapInArrow(pick, T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("hash long, key binary").fields]))


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """(id, hash, keys): digests of the lines each text loses, so a list is bounded by its text; ``rows`` has id, text and hash."""
    lines = suspected(rows, min_chars, bits)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    first = lines.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where("first != last").select("key", "first")
    lost = lines.join(first, "key").where(~(F.col("first.id").eqNullSafe(F.col("id"))))
    digest = F.unhex(F.substring(F.sha2("key", 256), 1, 32))
    return lost.groupBy("id", "hash").agg(F.collect_set(digest).alias("keys"))


def _digest(key: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(key).digest()[:16]


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with repeated lines gone from its texts, and ``n_lines`` (before) and ``n_dropped`` added.

    A new name that ``df`` already has gets an underscore at its end.
    """
    n_lines = spare_name(df.columns, "n_lines")
    n_dropped = spare_name([*df.columns, n_lines], "n_dropped")
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), text_hash.alias("hash"))
    mine = [spare_name(df.columns, c) for c in ("lost_id", "lost_hash", "lost_keys")]
    lost = repeated_lines(rows, min_chars, bits).toDF(*mine)
    keys = mine[2]
    both = df.join(lost, text_hash.eqNullSafe(F.col(mine[1])) & F.col(f"`{id_col}`").eqNullSafe(F.col(mine[0])), "left")
    at, of = df.columns.index(text_col), len(df.columns)
    kind = pa.string()
    schema = T.StructType([*df.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def run(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for text, held in zip(batch.column(at), batch.column(of)):
                lines = text.as_py().encode().split(b"\n") if text.is_valid else [b""]
                kept = lines
                if held.is_valid:
                    out = set(held.as_py())
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in out]
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode() if text.is_valid else None)
            columns = [*batch.columns[:at], pa.array(texts, kind), *batch.columns[at + 1 : of]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return both.select([*[F.col(f"`{c}`") for c in df.columns], F.col(keys)]).mapInArrow(run, schema)
