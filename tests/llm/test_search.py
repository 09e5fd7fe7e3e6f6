"""Nearest vectors and ranked lexical search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import lexical, onebit
from keyloom.llm.decontaminate import words_of

IDS = "id % 50 = 0"


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    names, m = [i for i, _ in good], np.array([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for j, q in enumerate(names):
        if q % 50 == 0:
            scores = (m * m[j]).sum(axis=1)
            out[q] = sorted(((-round(float(s), 9), i) for s, i in zip(scores, names) if i != q))[:k]
    return out


def found_nearest(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def mixed_vectors(n, d, seed):
    """Tight groups, isolated vectors, and one vector for a third of the rows."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, d))
    rows = []
    for i in range(n):
        kind = i % 3
        v = centers[0] if kind == 0 else centers[rng.integers(6)] + 0.1 * rng.standard_normal(d) if kind == 1 else rng.standard_normal(d)
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("d", [1, 3, 20])
def test_nearest_equals_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(onebit, "BLOCK_BYTES", 8 * d * 200)  # several blocks a cell, several chunks of queries
    monkeypatch.setattr(onebit, "CHUNK_BYTES", 8 * d * 10)
    rows = mixed_vectors(1500, d, d)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want, got = brute_nearest(rows), found_nearest(onebit.nearest(df, IDS))
    assert got.keys() == want.keys()
    if d == 20:
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        if d > 1 and q % 3 == 0:  # copies of the common vector: exact, by ids
            assert [i for _, i in got[q]][:5] == [i for i in range(0, 1500, 3) if i != q][:5]


def test_nearest_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, []), (100, None), (8, [1.0, 1.0, 1.0]), (1, [2.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, a int")
    got = found_nearest(onebit.nearest(df, IDS))
    assert {q: [i for _, i in hits] for q, hits in got.items()} == {0: [1, 50, 9], 50: [0, 1, 9]}
    assert onebit.nearest(df.limit(0), IDS).count() == 0
    assert onebit.nearest(df.where("vec_id = 1"), IDS).count() == 0
    assert onebit.nearest(df.where("vec_id = 0"), IDS).count() == 0


def test_nearest_with_huge_and_tiny_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [1.0, 1.0])]
    got = found_nearest(onebit.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), IDS))
    assert got[0] == [(-1.0, 2), (-round(3 / math.sqrt(10), 9), 1)]


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = onebit.unit(rng.standard_normal((4000, 64))), rng.standard_normal((20, 64))
    model = onebit.Model.fit(x[:500], np.zeros((500, 2), np.int64), 1)
    _, _, bits, length, fit = model.encode(x)
    block = {"bits": bits, "length": length, "fit": fit, "vectors": x, "names": np.arange(8000).reshape(-1, 2), "first": np.arange(4000)}
    hits = 0
    for j, rows, score in model.search(0, block, q, -np.ones((20, 2), np.int64), np.full(20, -1.0), 5):
        exact = x @ onebit.unit(q)[j]
        hits += len(set(rows[:5]) & set(np.argsort(-exact)[:5]))
        assert np.allclose(score, exact[rows])
    assert hits >= 99


def brute_search(docs, items, best=10):
    docs = [(i, Counter(words_of(t))) for i, t in docs if words_of(t)]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(words_of(text))
    out = {}
    for item, terms in wanted.items():
        scored = []
        for i, c in docs:
            n = c.total()
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scored)[:best], 1):
            out[item, rank] = (i, -s)
    return out


def found_search(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_lexical_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(900)]
    docs += [(1000 + i, "w7 w8 w9 rare") for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25)))) for i in range(30)] + [(40, "rare w7"), (41, "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    assert found_search(lexical.lexical_search(df, benchmark)) == want
    # several blocks of items, many small shards
    assert found_search(lexical.lexical_search(df, benchmark, block_words=60, shard_rows=37)) == want


def test_best_positions_stop_early():
    rng = np.random.default_rng(1)
    n = np.full(5000, 10, np.int64)
    tf = np.repeat(rng.integers(1, 9, 5000), 2).astype(np.int64)
    terms = np.tile(np.array([0, 1]), 5000)
    shard = lexical.Shard(list(range(5000)), n, np.arange(0, 10001, 2), terms, tf, np.array([5000, 3000]), 5000, 50000)
    best, looked = shard.search(np.array([0, 1]), [], 10)
    whole = sorted((-int(s), False, i) for i, s in enumerate(shard.impact.reshape(-1, 2).sum(axis=1)))[:10]
    assert best == whole and looked < 2500
    again, more = shard.search(np.array([0, 1]), [(-10**15, False, -i) for i in range(10)], 10)
    assert len(again) == 10 and more < 200  # a good start ends the search after the first reads


def test_lexical_on_odd_rows(spark, edge, empty):
    items = [(1, "the same LINE"), (1, "word"), (None, "one"), (2, None), (3, "w1 w2 w59"), (4, "漢字 one")]
    benchmark = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found_search(lexical.lexical_search(edge, benchmark)) == brute_search(rows, items)
    assert lexical.lexical_search(empty, benchmark).count() == 0
    assert lexical.lexical_search(edge, benchmark.limit(0)).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 1000)
    docs = [(1, "alpha beta " * 200_000 + "gamma"), (2, "gamma delta"), (3, "x" * 50_000)]
    items = [(1, "gamma alpha"), (2, "x" * 50_000)]
    got = lexical.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found_search(got) == brute_search(docs, items)
