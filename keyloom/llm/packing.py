"""Vector best-fit packing of token sequences.

A sequence is a bin with several capacities: tokens, documents, and attention cost (the sum
of squared piece lengths, as each piece attends to itself).  Pieces come longest first; of
the open bins that can take one under every capacity, the one is chosen whose residual
capacities fit it most closely (least weighted norm of residual minus demand) or, with
``rule="dot"``, are most aligned with it (greatest weighted dot product).

Pieces are dealt evenly over tasks by a hash and packed in runs of ``run_pieces``, so no task
holds more, at any size, and a run wastes less than one sequence.

Defined results: a null or empty text is the end id alone; rows with equal ids are separate
documents; an empty table gives no pieces.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.textops import row_batches
from keyloom.llm.tokens import encoder
from keyloom.session import settled

RUN_PIECES = 16_384


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.02)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece."""
    full = np.array([tokens, documents, attention], float)
    weight = np.array(weights)
    demand = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / full
    order = np.argsort(-lengths, kind="stable")
    # a piece needs some of every capacity: bins with less left than the least piece are closed
    least = demand.min(axis=0) if len(lengths) else full
    room = np.zeros((3, 256))
    number = np.zeros(256, np.int64)
    n_open = n_bins = 0
    out, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    slack = 1e-12
    for i in order:
        d = demand[i]
        r = room[:, :n_open]
        fits = (r[0] >= d[0] - slack) & (r[1] >= d[1] - slack) & (r[2] >= d[2] - slack)
        some = np.flatnonzero(fits)
        if len(some):
            left = r[:, some] - d[:, None]
            at = some[np.argmin(weight @ (left * left))] if rule == "norm" else some[np.argmax((weight * d) @ r[:, some])]
        else:
            if n_open == room.shape[1]:
                room, number = np.concatenate([room, np.zeros_like(room)], 1), np.concatenate([number, np.zeros_like(number)])
            at, n_open = n_open, n_open + 1
            room[:, at], number[at] = 1.0, n_bins
            filled.append(0)
            n_bins += 1
        k = number[at]
        out[i], offset[i] = k, filled[k]
        filled[k] += int(lengths[i])
        room[:, at] -= d
        if (room[:, at] < least - slack).any():  # closed: the last open bin takes its place
            n_open -= 1
            room[:, at], number[at] = room[:, n_open], number[n_open]
    return out, offset


def cut_pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``limit``."""
    head = n if n <= limit else n % limit
    return ([(0, head)] if head else []) + [(s, limit) for s in range(head, n, limit)]


def document_pieces(df: DataFrame, tokenizer: str, end_id: int, limit: int, id_col: str, text_col: str, remembered: int | None = None) -> DataFrame:
    """A row per piece: uid, doc_id, piece, start, length, ids_crc32."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        encode, n = encoder(tokenizer, remembered), 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in row_batches(batch, 500):
                owner, cells = [], []
                for i, ids in enumerate(encode.encode_all(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (s, m) in enumerate(cut_pieces(len(ids), limit)):
                        owner.append(i)
                        cells.append((base + n, k, s, m, zlib.crc32(ids[s : s + m].tobytes())))
                        n += 1
                uid, piece, start, length, crc = zip(*cells) if cells else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid, pa.int64()), part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    return rows.mapInArrow(run, T.StructType([T.StructField("uid", T.LongType()), rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), *longs]))


def pack_pieces(pieces: DataFrame, tokens: int, documents: int, attention: int, rule: str, run_pieces: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``uid`` and ``length``."""
    columns = [c for c in pieces.columns if c != "uid"]
    at = columns.index("length")
    schema = T.StructType([pieces.schema[c] for c in columns] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []

        def pack(table: pa.Table):
            nonlocal used
            bins, offset = best_fit(table.column(at).to_numpy(), tokens, documents, attention, rule)
            first, used = base + used, used + (int(bins.max()) + 1 if len(bins) else 0)
            table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offset))
            return table.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= run_pieces:
                yield from pack(pa.Table.from_batches(held))
                held = []
        if held:
            yield from pack(pa.Table.from_batches(held))

    dealt = pieces.repartition(F.xxhash64("uid")).sortWithinPartitions(F.xxhash64("uid"), "uid")
    return dealt.select(columns).mapInArrow(run, schema)


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = 2048,
    documents: int = 2048,
    attention: int | None = None,
    rule: str = "norm",
    run_pieces: int = RUN_PIECES,
    remembered: int | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``tokens`` tokens and ``documents`` pieces.

    ``attention`` bounds the sum of squared lengths in a sequence; by default it is
    ``tokens`` squared, which every sequence meets.  A smaller bound also shortens the pieces.
    ``remembered`` bounds the entries of the tokenizer's lookups, where a task has little memory.
    """
    if attention is None:
        attention = tokens * tokens
    limit = min(tokens, int(attention**0.5))
    pieces = settled(document_pieces(df, tokenizer, end_id, limit, id_col, text_col, remembered), "pieces")
    return pack_pieces(pieces, tokens, documents, attention, rule, run_pieces)
