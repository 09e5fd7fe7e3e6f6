"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Vectors are scaled to length one and grouped around centroids.  What is left after the centroid
is taken off is turned by a random rotation and kept as the signs of its components, with two
correction scalars: its length and the inner product of the sign vector with what it stands
for.  From these bits comes an estimate of the inner product with a query and a bound of the
estimate's error; the vectors whose upper bound reaches the k-th best lower bound are reranked on the original components.

The index holds every vector.  It is cut into cells, a centroid and a band of angles to
it, which are dealt out in blocks of bounded size.  A query has a floor, its k-th best cosine among a bounded
sample, and goes to every cell that an angle within that floor can reach (triangle inequality on
the sphere); nothing else is left out, so what can be missed is only what the error bounds miss.

Equal vectors enter once, with their k + 1 least ids; queries with equal vectors are searched once.

Fitted on the sample: centroids.  Its size is ``SAMPLE`` vectors, and ``SAMPLE_BYTES`` at most.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows with a null id or, where lengths differ, vectors of another length than the commonest one
(the shorter of two as common).  Repeated rows count once; an id with several vectors is as
many candidates and as many queries, each without that id.  Equal scores go to the smaller
id; vectors count as equal by a 128-bit fingerprint.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyloom.session import settled, small_table

NEAREST = 5
SAMPLE = 8192
SAMPLE_BYTES = 1 << 24
BLOCK_BYTES = 1 << 23
CHUNK_BYTES = 1 << 25
BANDS = 36
MOST_CENTROIDS = 256
#: Deviations of the estimate that its bound allows for; about one estimate in 1,000 is further below the truth.
EPSILON = 3.0
SLACK = 1e-5
TILE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines of rows with one vector, in double precision."""
    with np.errstate(all="ignore"):
        dots, sizes = (vectors * query).sum(axis=1), np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
        out = dots / sizes
    odd = ~(np.isfinite(out) & np.isfinite(sizes)) | (sizes < 1e-200)  # squares too large or too small for a double
    if odd.any():
        out[odd] = unit(vectors[odd]) @ unit(query[None])[0]
    return out


@dataclass
class Model:
    """Centroids of length one, the rotation, and the sample with its fingerprints."""

    centroids: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    names: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, names: np.ndarray, clusters: int, seed: int = 7, rounds: int = 8) -> Model:
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        centroids = sample[rng.permutation(len(sample))[:clusters]]
        for _ in range(rounds):
            near = (sample @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, sample)
            sizes = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(sizes > 1e-9, sums / np.maximum(sizes, 1e-9), centroids)
        rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
        return cls(centroids, rotation.astype(np.float32), sample, names)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, angle to the centroid, packed signs, length of the rest, correction of the signs."""
        x = unit(vectors)
        near_by = x @ self.centroids.T
        cluster = near_by.argmax(axis=1)
        angle = np.arccos(np.clip(near_by[np.arange(len(x)), cluster], -1, 1))
        cell = cluster * BANDS + np.minimum((angle / np.pi * BANDS).astype(np.int64), BANDS - 1)
        rest = x - self.centroids[cluster]
        length = np.linalg.norm(rest, axis=1)
        turned = rest.astype(np.float32) @ self.rotation.T
        bits = np.packbits(turned > 0, axis=1)
        fit = np.abs(turned).sum(axis=1, dtype=np.float64) / np.sqrt(x.shape[1]) / np.maximum(length, 1e-30)
        return cell, angle, bits, length, np.where(length > 1e-12, np.clip(fit, 1e-6, 1), 1)

    def floors(self, queries: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
        """A cosine that the k-th nearest other vector has at least (-1 where the sample is too small)."""
        if len(self.sample) <= k:
            return np.full(len(queries), -1.0)
        near_by = unit(queries) @ self.sample.T
        near_by[(names[:, None, :] == self.names[None]).all(axis=2)] = -2
        return np.maximum(np.partition(near_by, -k, axis=1)[:, -k] - SLACK, -1)

    def reachable(self, queries: np.ndarray, floors: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which cells (their angles between ``least`` and ``most``) a query may have near vectors in."""
        angle = np.arccos(np.clip(unit(queries) @ self.centroids.T, -1, 1))[:, cells // BANDS]
        reach = np.arccos(np.clip(floors, -1, 1))[:, None] + 1e-6
        return (angle - reach <= most) & (angle + reach >= least)

    def search(self, cluster: int, block: dict, queries: np.ndarray, names: np.ndarray, floors: np.ndarray, k: int):
        """(query, row of the block, exact cosine) of the k + 1 best rows of a block for each query."""
        center, d = self.centroids[cluster], queries.shape[1]
        signs = np.unpackbits(block["bits"], axis=1, count=d).astype(np.float32) * 2 - 1
        length, fit = block["length"], block["fit"]
        doubt = np.sqrt((1 - fit**2) / fit**2) / np.sqrt(max(d - 1, 1)) * EPSILON * length
        units = unit(queries)
        for at in range(0, len(queries), TILE):
            rest = units[at : at + TILE] - center
            turned = rest.astype(np.float32) @ self.rotation.T
            inner = (signs @ turned.T).astype(np.float64) * (length / fit / np.sqrt(d))[:, None]
            away = np.linalg.norm(rest, axis=1)
            estimate = 1 - (length[:, None] ** 2 + away**2) / 2 + inner
            bound = doubt[:, None] * away + SLACK
            lower, upper = estimate - bound, estimate + bound
            own = (block["names"][:, None, :] == names[None, at : at + TILE]).all(axis=2)
            lower[own] = -2
            limit = floors[at : at + TILE]
            if len(lower) >= k:
                limit = np.maximum(limit, np.partition(lower, -k, axis=0)[-k])
            chosen = (upper >= limit) | own
            for j in range(chosen.shape[1]):
                rows = np.flatnonzero(chosen[:, j])
                if len(rows) > 8 * k:  # the exact k-th best of the best estimates raises the limit
                    first = rows[np.argpartition(-estimate[rows, j], 4 * k)[: 4 * k]]
                    sure = cosines(block["vectors"][first[~own[first, j]]], queries[at + j])
                    if len(sure) >= k:
                        rows = rows[(upper[rows, j] >= np.partition(sure, -k)[-k]) | own[rows, j]]
                score = cosines(block["vectors"][rows], queries[at + j])
                best = np.lexsort((block["first"][rows], -score))[: k + 1]
                yield at + j, rows[best], score[best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, a, b): vectors that take part, in their own order of rows, with fingerprints."""
    wide = df.schema[vector_col].dataType.elementType
    vec = F.col(f"`{vector_col}`").cast("array<float>" if isinstance(wide, T.FloatType) else "array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    return rows.withColumn("a", F.xxhash64("vec")).withColumn("b", F.xxhash64(F.lit(1), F.reverse("vec")))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _names(table) -> np.ndarray:
    return np.stack([table.column("a").to_numpy(), table.column("b").to_numpy()], axis=1)


def fitted(distinct: DataFrame, d: int, rows: int, sample: int) -> Model:
    """A model from the vectors with the least fingerprints: a uniform, bounded sample."""
    size = max(64, min(sample, SAMPLE_BYTES // (8 * d)))
    drawn = distinct.select("vec", "a", "b").orderBy("a", "b").limit(size).toArrow()
    clusters = int(np.clip(rows**0.5 / 4, 1, min(MOST_CENTROIDS, max(1, drawn.num_rows // 8))))
    return Model.fit(_matrix(drawn.column("vec"), d), _names(drawn), clusters)


def code_index(distinct: DataFrame, shared, d: int) -> DataFrame:
    """Every distinct vector with its cell, code and correction scalars."""
    schema = T.StructType([*distinct.schema.fields, *T.StructType.fromDDL("cell long, angle double, bits binary, length double, fit double").fields])

    def run(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, angle, bits, length, fit = model.encode(_matrix(batch.column("vec"), d))
            new = [pa.array(cell), pa.array(angle), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.fieldNames())

    return distinct.mapInArrow(run, schema)


def _searcher(shared, d: int, k: int):
    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"qa": [], "qb": [], "ids": [], "score": []}
        if rows.num_rows and queries.num_rows:
            ids = rows.column("ids").combine_chunks()
            block = {
                "bits": np.stack([np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()]),
                "length": rows.column("length").to_numpy(),
                "fit": rows.column("fit").to_numpy(),
                "vectors": _matrix(rows.column("vec"), d),
                "names": _names(rows),
                "first": ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]],
            }
            names = np.stack([queries.column("qa").to_numpy(), queries.column("qb").to_numpy()], axis=1)
            listed = ids.to_pylist()
            for j, best, score in shared.value.search(key[0].as_py() // BANDS, block, _matrix(queries.column("qvec"), d), names, queries.column("floor").to_numpy(), k):
                found["qa"] += [int(names[j, 0])] * len(best)
                found["qb"] += [int(names[j, 1])] * len(best)
                found["ids"] += [listed[i] for i in best]
                found["score"] += score.tolist()
        return pa.table([pa.array(found["qa"], pa.int64()), pa.array(found["qb"], pa.int64()), pa.array(found["ids"], pa.list_(pa.int64())), pa.array(found["score"], pa.float64())], names=list(found))

    return search


def nearest(df: DataFrame, queries: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors of every row where ``queries`` holds.

    ``queries`` is an SQL condition on the column ``id``.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    shapes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("q")).orderBy(F.col("n").desc(), "d").head()
    d, n_rows, n_queries = (shapes["d"], shapes["n"], shapes["q"]) if shapes else (1, 0, 0)
    rows = rows.where(F.size("vec") == d)

    # equal vectors once, with their least ids; dense_rank lets a task drop all but those before the shuffle
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = settled(ranked.groupBy("a", "b").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids")), "distinct-vectors")
    asked = rows.where(queries)
    if not n_queries:
        return small_table(spark, [], "query_id long, rank int, vec_id long, score double")
    model = fitted(distinct, d, n_rows, sample)
    shared = spark.sparkContext.broadcast(model)  # bounded: centroids, rotation, sample
    index = settled(code_index(distinct, shared, d), "code-index")

    block_rows = max(64, BLOCK_BYTES // (8 * d))
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).orderBy("cell").collect()  # MOST_CENTROIDS * BANDS at most
    counts = np.array([-(-c["n"] // block_rows) for c in cells])
    cell, least, most = (np.array([c[x] for c in cells]) for x in ("cell", "least", "most"))
    chunks = -(-n_queries // max(64, CHUNK_BYTES // (8 * d)))

    asked_once = asked.groupBy("a", "b").agg(F.first("vec").alias("vec"))
    routed = T.StructType([*T.StructType.fromDDL("cell long, block long, chunk long, qa long, qb long, floor double").fields, T.StructField("qvec", rows.schema["vec"].dataType)])

    def route(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                names, vectors = _names(part), _matrix(part.column("vec"), d)
                floors = model.floors(vectors, names, k)
                q, c = np.nonzero(model.reachable(vectors, floors, cell, least, most))
                times = counts[c]
                q, c = np.repeat(q, times), np.repeat(c, times)
                block = np.arange(len(c)) - np.repeat(np.cumsum(times) - times, times)
                cells_out = [pa.array(cell[c]), pa.array(block), pa.array(names[q, 0].view(np.uint64) % np.uint64(chunks)).cast(pa.int64())]
                cells_out += [pa.array(names[q, 0]), pa.array(names[q, 1]), pa.array(floors[q]), part.column("vec").take(pa.array(q))]
                yield pa.RecordBatch.from_arrays(cells_out, names=routed.fieldNames())

    sent = asked_once.mapInArrow(route, routed)
    blocks = small_table(spark, [(int(c), int(b)) for c, b in zip(cell, counts)], "cell long, blocks long")
    dealt = index.join(blocks, "cell").withColumn("block", F.pmod("a", "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    dealt = dealt.select("cell", "block", "chunk", "a", "b", "ids", "vec", "bits", "length", "fit")
    on = ["cell", "block", "chunk"]
    hits = dealt.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(_searcher(shared, d, k), "qa long, qb long, ids array<long>, score double")
    best = Window.partitionBy("qa", "qb").orderBy(F.col("score").desc(), F.col("ids")[0])
    hits = settled(hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"), "hits")

    found = asked.select(F.col("id").alias("query_id"), "a", "b").distinct().join(hits, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb")))
    each = found.select("query_id", "a", "b", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    order = Window.partitionBy("query_id", "a", "b").orderBy(F.col("score").desc(), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
