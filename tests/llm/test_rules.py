from collections import Counter, defaultdict

import numpy as np

from keyloom.llm import decontaminate, lines, quality
from keyloom.llm.bloom import TwiceFilter, may_contain

WHITE = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    holders = defaultdict(set)

    def key(line):
        k = line.strip(WHITE)
        return k.encode().lower() if len(k) >= 10 else None

    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add((i is None, i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (i is None, i)]
        out.append((i, None if t is None else "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_lines(documents, texts, edge, empty):
    got = lines.drop_repeated_lines(documents.select("doc_id", "text"), bits=1 << 16)  # a full filter only suspects more
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(list(texts.items()))
    got = lines.drop_repeated_lines(edge)
    assert got.columns == [*edge.columns, "n_lines_", "n_dropped"]
    rows = [(r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()]
    assert sorted(rows, key=str) == brute_lines([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert lines.drop_repeated_lines(empty).count() == 0


def test_bloom_filter_misses_nothing():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    seen = TwiceFilter(1 << 16)
    seen.add(keys[:2000])
    seen.add(keys[1500:])
    assert may_contain(seen.twice.tobytes(), 1 << 16, keys[1500:2000]).all()
    assert may_contain(seen.once.tobytes(), 1 << 16, keys).all()
    assert may_contain(seen.twice.tobytes(), 1 << 16, keys[:1500]).mean() < 0.3


def brute_hits(rows, items, window):
    wins = defaultdict(set)
    for item, t in items:
        w = decontaminate.words_of(t)
        size = min(window, len(w))
        if item is not None and size:
            for i in range(len(w) - size + 1):
                wins[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in rows:
        w = decontaminate.words_of(t)
        hit, named = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (k := tuple(w[i : i + s])) in wins:
                    hit.update(range(i, i + s))
                    named |= wins[k]
        out.append((d, len(w), len(hit), sorted(named)))
    return sorted(out, key=str)


def our_hits(df, benchmark, **options):
    marked = decontaminate.mark(df, benchmark, **options)
    n, runs, items = marked.columns[len(df.columns) :]
    return sorted(((r["doc_id"], r[n], sum(x["end"] - x["begin"] for x in r[runs]), list(r[items])) for r in marked.collect()), key=str)


def test_decontamination(spark, documents, texts, edge, empty):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = brute_hits(list(texts.items()), items, 10)
    assert sum(bool(x[2]) for x in want) > 0
    assert our_hits(documents, benchmark) == want
    assert our_hits(documents, benchmark, block_words=300) == want  # a pass per block of items
    assert our_hits(documents, benchmark, window=6, shingle=1) == brute_hits(list(texts.items()), items, 6)
    odd = [(1, None), (2, "W3, w4!"), (3, "one"), (None, "end"), (3, "w10 w11 w12 W13 w14 w15 w16 w17 w18 w19 w20 w21"), (4, "é" * 3), (5, "漢字 x")]
    items = spark.createDataFrame(odd, "item_id long, text string")
    assert our_hits(edge, items) == brute_hits([(r["doc_id"], r["text"]) for r in edge.collect()], odd, 10)
    assert our_hits(edge, items, block_words=1) == our_hits(edge, items)
    assert decontaminate.mark(empty, items).count() == 0
    assert our_hits(edge, items.limit(0)) == brute_hits([(r["doc_id"], r["text"]) for r in edge.collect()], [], 10)
    assert decontaminate.drop_contaminated(edge, items).columns == edge.columns


def test_repeats_of_dense_text(spark):
    """Windows of one repeated word and texts that end in the middle of a window."""
    rows = [(1, "a " * 40), (2, "a " * 9), (3, "b a a a a a a a a a a c"), (4, "a a a a a b a a a a a")]
    items = spark.createDataFrame([(1, "a " * 12)], "item_id long, text string")
    got = our_hits(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), items)
    assert [x[2] for x in got] == [40, 0, 10, 0]


def brute_counts(t):
    b = (t or "").encode()
    w = b.split()
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(windows)
    covered = {k for i, x in enumerate(windows) if twice[x] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, documents, texts, edge, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(documents, labels).collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, t in texts.items():
        n, *rest = want = brute_counts(t)
        assert tuple(got[i])[1:6] == want
        assert got[i]["base_failed"] == (n < 20 or 100 * want[4] > 30 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    clean = [got[i]["kept"] for i, q in good.items() if q and not got[i]["base_failed"]]
    junk = [got[i]["kept"] for i, q in good.items() if not q]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1
    judged = quality.judge(edge, None)
    assert judged.columns == [*edge.columns, "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept_"]
    for r in judged.collect():
        assert tuple(r)[6:11] == brute_counts(r["text"]) and r["anomaly"] is None
    kept = quality.keep_good(edge, labels.limit(0))
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {9, 10, 11}
    assert quality.score_documents(empty, labels).count() == 0


def test_forest_sets_apart_what_lies_outside(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(5, 0.3, 900), rng.normal(0.1, 0.02, 900)])
    x[:60, 1] += rng.uniform(1, 2, 60)
    good = np.ones(900, bool)
    good[:60] = False
    forest = quality.grow(x, good, 100, 256, 3)
    assert forest.score(x[:60]).min() > forest.score(x[60:]).max()


def test_runs_are_united():
    assert decontaminate.united([(3, 5), (1, 3), (7, 9), (8, 10)]) == [(1, 5), (7, 10)]


def stuttered(texts, labels, times):
    """Good documents, and the same with every word repeated in a row."""
    good = [i for i, q in labels.items() if q == 1 and len(texts[i].split()) > 60][:5]
    return [(10**6 + i, " ".join(w for w in texts[i].split() for _ in range(times))) for i in good]


def test_stuttered_documents_go(spark, documents, texts):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = stuttered(texts, {r["doc_id"]: r["quality"] for r in labels.collect()}, 6)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [r for r in quality.score_documents(docs, labels).collect() if r["doc_id"] >= 10**6]
    assert len(got) == 5 and not any(r["base_failed"] or r["kept"] for r in got)


def test_good_labels_alone_give_a_forest(spark, documents, texts):
    """No labelled bad document passes the base rules, or none scores above the good ones."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = stuttered(texts, known, 6)
    plain = next(t for i, t in texts.items() if known.get(i) == 1 and len(t.split()) > 60)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([*rows, (-1, plain)], "doc_id long, text string"))
    good = labels.where("quality = 1")
    for some in (good, good.unionByName(spark.createDataFrame([(-1, 0)], labels.schema))):
        forest = quality.fit(docs, some)
        assert forest is not None and np.isfinite(forest.threshold)
        got = {r["doc_id"]: r for r in quality.judge(docs, forest).collect()}
        assert not any(got[i]["kept"] for i, _ in rows)
        assert np.mean([got[i]["kept"] for i, q in known.items() if q == 1 and not got[i]["base_failed"]]) > 0.98


def test_lost_lines_are_bounded_by_their_text(spark):
    """Many rows of one id or of none: no list holds the lines of others."""
    first = [(0, "\n".join(f"the repeated line number {k}" for k in range(80)))]
    rows = first + [(None if k % 2 else 5, f"the repeated line number {k}\nonly here is line {k}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lost = lines.repeated_lines(df.selectExpr("doc_id AS id", "text", "xxhash64(text) AS hash")).collect()
    assert len(lost) == 80 and all(len(r["keys"]) == 1 for r in lost)
    got = lines.drop_repeated_lines(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows)
