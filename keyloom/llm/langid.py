"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (byte n-grams inside and at the edges of words,
hashed to a fixed number of buckets), followed by a linear layer and a softmax.  Both are
trained by stochastic gradient descent in numpy on a bounded, stratified sample of labelled
rows; a part of the sample that training does not see sets the temperature of the
probabilities and the score below which a prediction should be rejected.  Prediction reads
whole texts where they lie.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and never
accepted; so is every text when no labelled rows exist.  Ties go to the label first in order.
Repeated rows are judged alike, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.textops import blocks, buffers, mix, spare_name

BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
_EVEN = np.uint64(0x9E3779B97F4A7C15)

#: Letters in lower case, everything else a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, and the text it belongs to.

    An n-gram may have a blank at its ends only, and lies within one text, whose own ends count as blanks.
    """
    n_texts = len(offsets) - 1
    # two blanks between texts, so that n-grams that meet both texts have a blank inside
    spread = np.full(len(data) + 2 * (n_texts + 1), 32, np.uint8)
    owner = np.repeat(np.arange(n_texts), np.diff(offsets))
    spread[np.arange(len(data)) + 2 * (owner + 1)] = FOLD[data]
    text_of = np.repeat(np.arange(n_texts + 1), np.append(np.diff(offsets) + 2, 2)).clip(max=max(n_texts - 1, 0))
    letter = spread != 32
    wide = spread.astype(np.uint64)
    found, owners = [], []
    for n in SIZES:
        m = len(spread) - n + 1
        name = wide[:m].copy()
        for k in range(1, n):
            name = name << np.uint64(8) | wide[k : k + m]
        ok = letter[:m] | letter[n - 1 :] if n == 2 else letter[:m].copy()
        if n > 2:
            ok = letter[1 : 1 + m].copy()
            for k in range(2, n - 1):
                ok &= letter[k : k + m]
        at = np.flatnonzero(ok)
        found.append((mix(name[at] * _EVEN + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(text_of[at + (~letter[at] if n <= 2 else 1)])  # the text of its first letter
    return np.concatenate(found), np.concatenate(owners)


def bags(column: pa.Array, texts: int = 64, size: int = 1 << 18):
    """(first row, matrix texts x buckets of subword shares) for runs of a column's texts."""
    data, offsets = buffers(column)
    for i, j, part, at in blocks(data, offsets, size):
        for a in range(0, j - i, texts):
            b = min(a + texts, j - i)
            bucket, owner = subwords(part[at[a] : at[b]], at[a : b + 1] - at[a])
            counts = np.bincount(owner * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS).astype(np.float32)
            yield i + a, counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray  # buckets x dimension
    weight: np.ndarray  # dimension x labels
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embedding) @ self.weight + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (at, share) in enumerate(rows):
        out[k, at] = share
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], dimension: int = 16, steps: int = 800, rate: float = 1.0, seed: int = 5) -> Model:
    """Stochastic gradient descent over sparse rows (buckets, shares), 32 at a step."""
    rng = np.random.default_rng(seed)
    model = Model(
        labels,
        rng.normal(0, 0.1, (BUCKETS, dimension)).astype(np.float32),
        rng.normal(0, 0.1, (dimension, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * 32 // len(rows)))])
    for k in range(steps):
        batch = order[32 * k : 32 * k + 32]
        x = dense([rows[i] for i in batch])
        hidden = x @ model.embedding
        p = softmax(hidden @ model.weight + model.bias)
        p[np.arange(len(batch)), y[batch]] -= 1
        p /= len(batch)
        step = np.float32(rate * (1 - k / steps))
        back = p @ model.weight.T
        model.weight -= step * (hidden.T @ p)
        model.bias -= step * p.sum(axis=0)
        # shares are small numbers, so embeddings take longer steps
        model.embedding -= 50 * step * (x.T @ back)
    return model


def calibrate(model: Model, x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, precision: float) -> None:
    """Temperature of least log loss, and the least score above which ``precision`` holds."""
    z = np.concatenate([model.logits(dense(x[k : k + 64])) for k in range(0, len(x), 64)])
    best = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())
    model.temperature = float(best)
    p = softmax(z / best)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    model.reject_below = float(score[order[good[-1]]]) if len(good) else 1.0


def held_out(id_col: str) -> Column:
    """Rows that training must not see: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int) -> DataFrame:
    """(label, buckets, shares) of at most ``per_label`` rows a label, chosen by a hash of the text."""
    from pyspark.sql.window import Window

    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & ~held_out(id_col)).select(F.col(f"`{lang_col}`").alias("label"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where(F.length("text") > 0).withColumn("hash", F.xxhash64("text", F.lit(3)))
    # the hash to cut at per label, found without moving texts: ties may only add copies of one text
    ranked = rows.select("label", "hash").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("hash")))
    cuts = {r["label"]: r["hash"] for r in ranked.where(F.col("rank") <= per_label).groupBy("label").agg(F.max("hash").alias("hash")).collect()}  # a row per language
    if not cuts:
        return rows.limit(0).select("label", F.array().cast("array<int>").alias("buckets"), F.array().cast("array<float>").alias("shares"))
    limit = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    chosen = rows.where(F.col("hash") <= limit[F.col("label")]).dropDuplicates(["label", "hash"]).select("label", "text")

    def run(batches):
        for batch in batches:
            label, buckets, shares = [], [], []
            names = batch.column(0).to_pylist()
            for first, x in bags(batch.column(1)):
                for k, row in enumerate(x):
                    at = np.flatnonzero(row)
                    label.append(names[first + k])
                    buckets.append(at.astype(np.int32))
                    shares.append(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "buckets", "shares"])

    return chosen.mapInArrow(run, "label string, buckets array<int>, shares array<float>")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 500, precision: float = 0.995, **options) -> Model | None:
    """A model from at most ``per_label`` distinct texts of each language; every fifth only calibrates it."""
    found = labelled_sample(docs, id_col, text_col, lang_col, per_label).toArrow()
    if not found.num_rows:
        return None
    names = found.column("label").to_pylist()
    rows = [(np.array(b.values.to_numpy(zero_copy_only=False)), np.array(s.values.to_numpy(zero_copy_only=False))) for b, s in zip(found.column("buckets"), found.column("shares"))]
    labels = sorted(set(names))
    # an order that does not depend on how tasks delivered the rows
    order = sorted((k for k in range(len(rows)) if len(rows[k][0])), key=lambda k: (names[k], rows[k][0].tobytes(), rows[k][1].tobytes()))
    y = np.array([labels.index(names[k]) for k in order])
    rows = [rows[k] for k in order]
    test = np.arange(len(rows)) % 5 == 4
    if not len(rows):
        return None
    model = train([r for r, t in zip(rows, test) if not t], y[~test], labels, **options)
    if test.any():
        calibrate(model, [r for r, t in zip(rows, test) if t], y[test], precision)
    return model


def has_letter(raw: bytes) -> bool:
    return raw.translate(None, LETTERS) != raw or any(c.isalpha() for c in raw.decode())


LETTERS = bytes([*range(65, 91), *range(97, 123)])


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df``'s rows without the text, with ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    A new name that ``df`` already has gets an underscore at its end.
    """
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name != text_col]
    added: list[str] = []
    for name in ("lang_pred", "score", "accepted"):
        added.append(spare_name([*(f.name for f in fields), *added], name))
    schema = T.StructType([*fields, *T.StructType.fromDDL("`{}` string, `{}` double, `{}` boolean".format(*added)).fields])
    names = schema.names

    def run(batches):
        m: Model | None = shared.value
        for batch in batches:
            column = batch.column(at)
            data, offsets = buffers(column)
            raw = data.tobytes()
            lang = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            known = np.array([has_letter(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], bool)
            if m is not None:
                for first, x in bags(column):
                    p = m.probabilities(x)
                    rows = first + np.flatnonzero(known[first : first + len(x)])
                    lang[rows] = np.array(m.labels, object)[p.argmax(axis=1)][rows - first]
                    score[rows] = p.max(axis=1)[rows - first]
            accepted = known & (score >= (m.reject_below if m else 2))
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(accepted)], names=names)

    return df.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``accepted``."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict(rows, model)
