"""Containment of values against brute force."""

import random

import pytest

from keyloom.operators import containment
from keyloom.operators.containment import containing


def brute(rows):
    out = {}
    for v, w in rows:
        o = 0
        for u, x in rows:
            if v in u:
                o |= x
        out[v] = (w, o)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "value string, w0 long").repartition(3)
    return {r["value"]: (r["w0"], r["ow0"]) for r in containing(df, ["w0"]).collect()}


def merged(pairs):
    out = {}
    for v, w in pairs:
        out[v] = out.get(v, 0) | w
    return list(out.items())


def test_random_values(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abé1 ", k=rng.choice([0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))), 1 << rng.randint(0, 5)) for _ in range(400)]
    long = ["".join(rng.choices("abcdefgh ", k=rng.randint(30, 900))) for _ in range(60)]
    pairs += [(t, 64) for t in long]
    for t in long:  # parts of every length, and near parts
        for n in (1, 5, 8, 12, 16, 31, 33, 100, len(t) - 1):
            at = rng.randint(0, max(0, len(t) - n))
            pairs += [(t[at : at + n], 128), (t[at : at + n // 2] + "#" + t[at + n // 2 : at + n], 256)]
    rows = merged(pairs)
    assert found(spark, rows) == brute(rows)


def test_codes_with_a_common_format(spark, monkeypatch):
    rows = [(f"Customer#{i:09d}", 1) for i in range(300)] + [(str(i), 2) for i in range(300)] + [(f"https://www.example.org/items/{i}?ref=Customer#{i:09d}", 4) for i in range(200)]
    monkeypatch.setattr(containment, "BLOCK_BYTES", 500)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [("", 1)], [("", 1), ("x", 2)], [("a" * 5000, 1), ("a" * 4096, 2), ("a" * 4097, 4), ("b" + "a" * 5000, 8)]])
def test_edges(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_a_full_filter_and_a_small_sample_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = merged(("".join(rng.choices("ab", k=rng.randint(1, 40))), 1 << rng.randint(0, 3)) for _ in range(500))
    monkeypatch.setattr(containment, "FILTER_BITS", 64)
    monkeypatch.setattr(containment, "SAMPLE_BYTES", 100)
    assert found(spark, rows) == brute(rows)


def test_rare_windows_keep_the_join_small(spark):
    """Values of one format are not paired with each other: a window that only one of them has is taken."""
    import numpy as np
    import pyarrow as pa

    values = [f"Customer#{i:09d}" for i in range(2000)]
    (_, _, block), = containment.blocks(pa.array(values))
    h = block.hashes(16)
    rarity = np.bincount((h & np.uint64(containment.SLOTS - 1)).astype(np.int64), minlength=containment.SLOTS).astype(np.uint32)
    _, keys, _ = block.anchors(rarity)
    assert len(set(keys.tolist())) > 1900


def test_short_values_under_many_sets_with_little_memory(spark, monkeypatch):
    """More bit sets than a round takes, and windows written before a task's end."""
    rng = random.Random(3)
    rows = merged(("".join(rng.choices("01é ", k=rng.randint(0, 9))), 1 << rng.randint(0, 50)) for _ in range(600))
    monkeypatch.setattr(containment, "KEPT_WINDOWS", 50)
    monkeypatch.setattr(containment, "BLOCK_BYTES", 64)
    monkeypatch.setattr(containment, "SETS_A_ROUND", 2)
    assert found(spark, rows) == brute(rows)


def test_short_values_meet_in_one_grouping(spark):
    """Numbers are held by a great many others: they are grouped by their bytes, no pairs are joined."""
    rows = [(str(i), 1) for i in range(20000)]
    df = spark.createDataFrame(rows, "value string, w0 long")
    written = containing(df, ["w0"])
    assert {tuple(r) for r in written.collect()} == {(v, w, 1) for v, w in rows}
    assert "Join" not in written._jdf.queryExecution().executedPlan().toString()
