"""Source divergence against a brute-force version."""

import random
import re
from collections import Counter

import pytest

from keyloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [(s, c) for x, s, c in docs if x == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)
        count = {s: Counter() for s, _ in mine}
        for s, c in mine:
            count[s].update({t: c[t] for t in kept if t in c})
        total = {s: sum(c.values()) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (count[s][t] + 5) // (total[s] + 5 * v) for t in kept} for s in count}
        q = {t: 1 + 10**9 * (sum(count[s][t] for s in count) + 5) // (sum(total.values()) + 5 * v) for t in kept}
        for s in count:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -f, r) for r, (f, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -f, r) for r, (f, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}é" if i % 7 == 0 else f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", "", None, "C"])
        rows.append((lang, source, ", ".join(rng.choices(words, [1 / (1 + (k + (3 if source == "a" else 0)) % 100) for k in range(100)], k=rng.randint(0, 40))).upper()))
    return rows + [("lone", "x", "few words only"), ("lone", "y", None), ("de", "z", "12 34")]


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rows = corpus(700, 4)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert found(divergence.divergence(df)) == brute(rows)
    assert found(divergence.divergence(df, least_docs=1, top_terms=3)) == brute(rows, 1, 3)


def test_odd_rows(spark, edge, empty):
    df = edge.withColumnRenamed("kept", "lang").withColumnRenamed("n_lines", "value")
    rows = [(str(r["lang"]).lower(), r["source"], r["text"]) for r in df.collect()]
    assert found(divergence.divergence(df, least_docs=2)) == brute(rows, 2)
    assert divergence.divergence(empty.withColumnRenamed("kept", "lang")).count() == 0


def test_long_texts_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SEGMENT", 100)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 3)
    rows = [("en", s, "Alpha beta-" * 3000 + t + "漢" * 5000) for s, t in (("a", "gamma"), ("b", "delta"), ("b", ""))]
    assert found(divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=1)) == brute(rows, 1)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(divergence._probability(F.lit(700_000_000_000).cast("long"), F.lit(9_000_000_000_000_000).cast("long"), F.lit(1000).cast("long")).alias("p"))
    assert one.head()["p"] == 1 + 10**9 * (700_000_000_000 + 5) // (9_000_000_000_000_000 + 5000)
