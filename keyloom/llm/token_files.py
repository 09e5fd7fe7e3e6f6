"""Token ids in compact binary blocks.

Ids are ranked by frequency over the whole corpus, so common ones need one byte.  A value
takes one to four little-endian bytes; its length minus one is two bits of a control byte,
and control bytes are kept apart from the data: numpy looks up four lengths per control byte
in a table and gathers all values of a block at once.

A token file is a folder: ``ranks`` (the id of every rank) and ``blocks``, Parquet rows of
whole documents in ascending order of their ids:

    part, block   place of the block; parts and the blocks in them ascend
    start         tokens of its part before it
    doc_ids, lengths, control_sizes   per document
    control, data                     of its documents, end to end

Defined results: a null or empty text is a document of the end id alone; rows with equal ids
are separate documents, ordered by a hash of their ids; null ids come first; an empty table
gives a folder without blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.textops import row_batches
from keyloom.llm.tokens import encoder, vocabulary_size
from keyloom.session import scratch_dir

BLOCK_TOKENS = 1 << 20

#: Bytes of the four values a control byte stands for.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All values of documents of the given lengths; each begins with a fresh control byte."""
    sizes = LENGTHS[control].ravel()
    groups = -(-lengths // 4)
    if (groups * 4 != lengths).any():  # leave out the unused slots of each document's last control byte
        begin = np.cumsum(groups * 4) - groups * 4
        used = np.zeros(len(sizes) + 1, np.int8)
        np.add.at(used, begin, 1)
        np.add.at(used, begin + lengths, -1)
        sizes = sizes[np.cumsum(used[:-1]) > 0]
    ends = np.cumsum(sizes, dtype=np.int64)
    at = ends - sizes
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, 4):
        more = sizes > k
        if more.any():
            out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, n, ids, tie): the ids of every text and the end id, as little-endian integers of the width given.

    ``tie`` is a hash of them, to order rows of one id.
    """
    width = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for part in row_batches(batch, 500):
                ids = [np.append(x, np.uint32(end_id)).astype(width) for x in encode.encode_all(part.column(1).to_pylist())]
                raw = [x.tobytes() for x in ids]
                tie = [xxhash.xxh3_64_intdigest(x) >> 1 for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(raw, pa.binary()), pa.array(tie, pa.int64())], names=["id", "n", "ids", "tie"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *T.StructType.fromDDL("n int, ids binary, tie long").fields])), width


def frequency_ranks(tokens: DataFrame, width: str, size: int) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; ``size`` bounds what is collected."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=size) if len(x.as_buffer()) > 8 * size else 0
            joined = np.frombuffer(b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= 8 * size), width)
            total += np.bincount(joined, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token", "n"])

    counted = tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.collect()
    counts = np.zeros(size, np.int64)
    counts[[r["token"] for r in found]] = [r["n"] for r in found]
    order = np.lexsort((np.arange(size), -counts))
    return order[: int((counts > 0).sum())].astype(np.uint32)


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode all texts and write them to ``path``, which must not exist."""
    spark = df.sparkSession
    kept = scratch_dir(spark, "tokens")
    tokens, width = encode_documents(df, tokenizer, end_id, id_col, text_col)
    tokens.write.option("compression", "zstd").parquet(kept)  # encoding is the costly part: done once
    tokens = spark.read.schema(tokens.schema).parquet(kept)
    ranks = frequency_ranks(tokens, width, max(vocabulary_size(tokenizer), end_id + 1))
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranks)), "token": ranks.astype(np.int64)}), "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(of)  # one entry per id of the vocabulary

    id_field = tokens.schema["id"]
    ordered = tokens.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "ids")
    names = ["part", "block", "start", "doc_ids", "lengths", "control_sizes", "control", "data"]
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_field.dataType)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("control_sizes", T.ArrayType(T.IntegerType())),
            T.StructField("control", T.BinaryType()),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def assemble(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        lengths: list[int] = []
        controls: list[bytes] = []
        datas: list[bytes] = []
        id_type = None

        def row():
            cells = [[part], [block], [start], [ids], [lengths], [[len(c) for c in controls]], [b"".join(controls)], [b"".join(datas)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        held = 0
        for batch in batches:
            id_type = batch.column(0).type
            for i, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and held + n > block_tokens:
                    yield row()
                    block, start, held = block + 1, start + held, 0
                    ids, lengths, controls, datas = [], [], [], []
                ids.append(i)
                lengths.append(n)
                control, data = pack_values(shared.value[np.frombuffer(raw.as_buffer(), width)])
                controls.append(control)
                datas.append(data)
                held += n
        if held:
            yield row()

    blocks = ordered.select("id", "n", "ids").mapInArrow(assemble, schema)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's place in the whole and its ids, from the files."""
    return _read(spark, path, lambda ids: pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), T.StructField("ids", T.ArrayType(T.LongType())))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), the checksum over ids as little-endian 32-bit integers."""
    return _read(spark, path, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), T.StructField("ids_crc32", T.LongType()))


def _read(spark: SparkSession, path: str, digest, last: T.StructField) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for r in sizes.orderBy("part").collect():  # a row per written partition
        before[r["part"]] = total
        total += r["n"]
    ranks = [r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # the vocabulary at most
    shared = spark.sparkContext.broadcast((before, np.array(ranks, np.uint32)))
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def run(batches):
        starts, tokens = shared.value
        for batch in batches:
            for row in row_batches(batch, 1):
                part, start, ids, lengths, control, data = (c[0] for c in row.columns)
                lengths = np.array(lengths.as_py(), np.int64)
                values = tokens[unpack_values(np.frombuffer(control.as_buffer(), np.uint8), np.frombuffer(data.as_buffer(), np.uint8), lengths)]
                at = np.cumsum(lengths) - lengths
                documents = np.split(values, at[1:])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(at + start.as_py() + starts[part.as_py()]), pa.array(lengths), digest(documents)], names=schema.names)

    return blocks.select("part", "start", "doc_ids", "lengths", "control", "data").mapInArrow(run, schema)
