import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import suffix_dedup

from .conftest import EDGE


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        end = 0
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                for x in range(max(k, end), k + length):
                    gone[x] = True
                end = k + length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def ours(df, **options):
    got = suffix_dedup.drop_repeated_strings(df.select("doc_id", "text"), **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(x["end"] - x["begin"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in got), key=str)


def test_equals_brute_force(documents, texts):
    want = brute(list(texts.items()), 200)
    assert sum(x[2] for x in want) > 1000
    assert ours(documents) == want


@pytest.mark.parametrize("letters,length,gram", [("ab", 40, 12), ("abcdefghij ", 30, 8), ("a", 25, 8)])
def test_borders_periods_and_overlaps(spark, letters, length, gram):
    """Matches that end anywhere, with several partners each, and periodic text."""
    rng = random.Random(length)
    pool = ["".join(rng.choices(letters, k=rng.randint(5, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 20) :] + "".join(rng.choices("xyz", k=rng.randint(0, 3))) for _ in range(rng.randint(0, 7)))) for i in range(80)]
    rows += [(80, "ab" * 200), (81, "z" * 100), (82, "é" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(df, length=length, gram=gram) == brute(rows, length)


def test_edge_cases(edge, empty):
    assert ours(edge) == brute([(i, t) for i, t, _ in EDGE], 200)
    got = suffix_dedup.drop_repeated_strings(edge.withColumnRenamed("source", "kept_x"))
    assert got.columns[-3:] == ["kept_", "n_bytes", "removed"]
    assert suffix_dedup.drop_repeated_strings(empty).count() == 0


def test_texts_longer_than_a_segment(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=9000))
    rows = [(1, base[:4000] + "X" + base[4000:]), (2, base[100:3900] + base[5000:]), (3, "q" + base[2000:2300] + "q")]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 11)
    column = __import__("pyarrow").array([t for _, t in rows])
    starts = [(int(o), int(p)) for _, s, owner, place in suffix_dedup.pieces(column, 200) for o, p in zip(owner, place)]
    assert sorted(starts) == [(i, p) for i, (_, t) in enumerate(rows) for p in range(len(t) - 199)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 200)


def test_parts_are_made_of_wanted_blocks_only(monkeypatch):
    """Bytes are summed once a table, and nothing is named in blocks that are not wanted."""
    rng = random.Random(8)
    column = pa.array([" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(400)) for _ in range(5)])
    whole = list(suffix_dedup.level_rows(column, 0, 200, 64))
    names = np.concatenate([x[2] for x in whole])
    sums, named = [], []
    real_sums, real_spans = suffix_dedup.byte_sums, suffix_dedup.summed_spans
    monkeypatch.setattr(suffix_dedup, "byte_sums", lambda *a: sums.append(1) or real_sums(*a))

    def spans(s, a, b):
        out = real_spans(s, a, b)
        named.append(len(out))
        return out

    monkeypatch.setattr(suffix_dedup, "summed_spans", spans)
    chosen = names[:3]
    every = list(suffix_dedup.level_rows(column, 1, 200, 64, [lambda x: np.isin(x, chosen), lambda x: np.ones(len(x), bool)]))
    assert len(sums) == 2
    n = sum(int(x[4].sum()) for x in whole for x in [[c[np.isin(x[2], chosen)] for c in x]])
    assert sum(len(x[0]) for x in every) == n
    assert sum(named[2:]) <= 3 * n  # after the anchors and the whole blocks


def test_runs_of_one_text_are_united():
    texts = pa.array(["abcdefgh", None, "", "héllo", "xyz"])
    ranges = pa.array([[(4, 6), (1, 3), (3, 4)], None, [], [(0, 1), (1, 3)], [(0, 3)]], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
    kept, sizes, runs = suffix_dedup.without_runs(texts[1:], ranges[1:])
    assert kept.to_pylist() == [b"", b"", b"llo", b""]
    kept, sizes, runs = suffix_dedup.without_runs(texts, ranges)
    assert kept.to_pylist() == [b"agh", b"", b"", b"llo", b""] and sizes.to_pylist() == [8, 0, 0, 6, 3]
    assert [[(x["begin"], x["end"]) for x in r] for r in runs.to_pylist()] == [[(1, 6)], [], [], [(0, 3)], [(0, 3)]]
