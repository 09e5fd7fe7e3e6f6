"""Binary artefacts in the raw zone: cut into chunks, with a marker per artefact.

An artefact is bytes under a name, of any length.  Its chunks are Parquet rows, so Spark writes
and reads them from all executors, a cell never holds more than a chunk, and a range of
a large artefact reads the row groups of its own chunks only.  The marker row of an artefact is written after its
chunks and says how many there are and their checksums; without one an artefact does not count.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.zones import raw_path

CHUNK_BYTES = 8 << 20


def _chunks(parts: DataFrame, chunk_bytes: int) -> DataFrame:
    """(name, part, chunk, content): every part cut into chunks."""
    last = F.greatest(F.ceil(F.octet_length("content") / chunk_bytes) - 1, F.lit(0))
    cut = parts.select("name", "part", "content", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    piece = F.substring(F.col("content"), (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return cut.select("name", "part", "chunk", piece.alias("content"))


def write_artefacts(artefacts: DataFrame, root: str, source: str, day: date | None = None, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Write (name, content) rows once under the source and day, and return the folder.

    An artefact longer than a cell comes as several rows with a ``part`` number, from 0.  An
    existing folder is an error: raw data is never replaced.
    """
    path = raw_path(root, source, day or date.today(), "artefacts")
    parts = artefacts if "part" in artefacts.columns else artefacts.withColumn("part", F.lit(0))
    parts = parts.select("name", F.col("part").cast("long").alias("part"), "content")
    spark = parts.sparkSession
    _chunks(parts, chunk_bytes).write.mode("errorifexists").option("parquet.block.size", str(4 * chunk_bytes)).parquet(f"{path}/chunks")
    # checksums of what was written, not of what was to be written
    written = spark.read.parquet(f"{path}/chunks")
    size = F.octet_length("content").cast("long")
    listed = written.groupBy("name").agg(F.sum(size).alias("length"), F.count("*").alias("chunks"), F.bit_xor(F.xxhash64("part", "chunk", "content")).alias("checksum"))
    listed.write.mode("errorifexists").parquet(f"{path}/markers")
    return path


def list_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, chunks, checksum) of the artefacts that were written whole."""
    return spark.read.parquet(f"{path}/markers")


def damaged_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """Artefacts whose chunks are not those their marker tells of."""
    chunks = spark.read.parquet(f"{path}/chunks")
    now = chunks.groupBy("name").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("part", "chunk", "content")).alias("found"))
    joined = list_artefacts(spark, path).join(now, "name", "left")
    return joined.where(~(F.col("chunks").eqNullSafe(F.col("n")) & F.col("checksum").eqNullSafe(F.col("found")))).select("name")


def read_chunks(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, begin, content): the chunks of the artefacts (given ones only) and where each begins."""
    from pyspark.sql.window import Window

    chunks = spark.read.parquet(f"{path}/chunks")
    if names is not None:
        chunks = chunks.where(F.col("name").isin(list(names)))
    # places come from the lengths alone: contents don't pass the window
    sizes = chunks.select("name", "part", "chunk", F.octet_length("content").cast("long").alias("size"))
    before = Window.partitionBy("name").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return chunks.join(begins, ["name", "part", "chunk"]).select("name", "begin", "content")


def read_range(spark: SparkSession, path: str, name: str, begin: int, length: int) -> DataFrame:
    """(begin, content): the bytes [begin, begin + length) of one artefact, by chunk."""
    end = begin + length
    chunks = read_chunks(spark, path, [name]).where((F.col("begin") < end) & (F.col("begin") + F.octet_length("content") > begin))
    first = F.greatest(F.lit(begin) - F.col("begin"), F.lit(0))
    size = F.least(F.lit(end) - F.col("begin"), F.octet_length("content").cast("long")) - first
    return chunks.select((F.col("begin") + first).alias("begin"), F.substring(F.col("content"), (first + 1).cast("int"), size.cast("int")).alias("content"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all artefacts; for those that fit a cell."""
    ordered = F.sort_array(F.collect_list(F.struct("begin", "content")))
    joined = F.aggregate(ordered, F.lit("").cast("binary"), lambda whole, x: F.concat(whole, x["content"]))
    return read_chunks(spark, path).groupBy("name").agg(joined.alias("content"))
