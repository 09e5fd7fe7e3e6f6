import glob
import random
import re
import tempfile
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import components, ngram_join
from keyloom.session import SHUFFLE_CLEANUP, settled_clean

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts: list[tuple]):
    """[(id, set size, least id reachable)] by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(texts)), key=str)


def ours(df, **options):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **options).collect()), key=str)


def test_equals_brute_force(documents, texts):
    assert ours(documents) == brute(list(texts.items()))


def test_edge_cases(edge, empty):
    assert ours(edge) == brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert ours(empty) == []
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 12]))


def test_chains_borders_and_shared_passages(spark):
    """Pairs around the threshold, chains that only link end to end, one passage in many texts."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=70)
    texts = []
    for family in range(25):
        base = rng.choices(vocabulary, k=rng.randint(20, 160))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                cut = rng.randrange(len(words) // 4)
                words = words[cut:] + rng.choices(vocabulary, k=cut // 2)
            texts.append(" ".join(words))
            base = words if rng.random() < 0.5 else base
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40
    assert ours(df) == want


def test_tree_equals_set_overlap():
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.integers(0, 40), min_size=1, unique=True), st.lists(st.lists(st.integers(0, 40), min_size=1, unique=True), max_size=12))
    def check(probe, leaves):
        arrays = [np.array(sorted(x), np.uint64) for x in leaves]
        got = ngram_join.tree_links(np.array(sorted(probe), np.uint64), arrays, 75, 100, step=3)
        assert got.tolist() == [100 * len(set(probe) & set(x)) >= 75 * len(set(probe) | set(x)) for x in leaves]

    check()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 700), (700, 600)], "a long, b long")
    got = {tuple(r) for r in components.components(links).collect()}
    assert got == {(i, 0) for i in range(201)} | {(i, 500) for i in (500, 600, 700)}


def test_one_row_of_a_group(spark, edge, empty):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(4, "one"), (4, "one"), (4, a), (4, a + " end"), (9, a), (None, b), (None, b + " end"), (None, b), (None, c), (3, c), (7, ""), (7, ""), (8, None), (None, "alone")]
    kept = ngram_join.keep_one_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = sorted(((r["doc_id"], (r["text"] or "").split(" end")[0]) for r in kept), key=str)
    assert got == sorted([(4, "one"), (4, a), (None, b), (3, c), (7, ""), (7, ""), (8, ""), (None, "alone")], key=str)
    assert ngram_join.keep_one_row(edge).columns == edge.columns
    assert ngram_join.keep_one_row(empty).count() == 0


def test_a_written_step_leaves_no_shuffle_files(spark):
    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    before, mark = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    step = spark.range(1000).repartition("id")
    written = settled_clean(step)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == mark
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert written.count() == settled_clean(step).count() == 1000  # the step can be run again


def test_a_set_tries_its_best_hub_before_others(spark):
    """Of a set's hubs the one at most of its shingles comes first, and others only where they are in another component."""
    rows = [(1, 10, 5, 0, None), (1, 11, 5, 0, 10), (2, 11, 5, 1, 10), (3, 9, 5, 0, None), (3, 11, 5, 2, 9), (4, 12, 5, 0, 9)]
    shared = spark.createDataFrame(rows, "shingle long, fp long, n int, at int, hub long")
    pairs = ngram_join.hub_pairs(shared)
    assert sorted(map(tuple, pairs.collect())) == [(9, 11, False), (9, 12, True), (10, 11, True)]
    found = spark.createDataFrame([(11, 10), (10, 10), (12, 9), (9, 9)], "node long, component long")
    rest = ngram_join.apart_pairs(pairs.where("NOT best"), found)
    assert list(map(tuple, rest.collect())) == [(9, 11)]
    united = spark.createDataFrame([(11, 9), (10, 9), (12, 9), (9, 9)], "node long, component long")
    assert ngram_join.apart_pairs(pairs, united).isEmpty()
