import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from keyloom.functions.vocabulary import Vocabulary, vocabulary_table
from keyloom.operators import merge
from keyloom.operators.profile import table_profile
from keyloom.sources.context import ContextStore, annotate, best_as_discovery, gate
from keyloom.sources.versions import VersionedTable
from keyloom.streaming.incremental import stream_merge


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stamp(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture
def loads(rows):
    ddl = "k int, v string, dt_ingest timestamp"
    target = rows([(1, "a", stamp(1)), (2, "b", stamp(2))], ddl)
    source = rows(
        [(1, "late", stamp(2)), (2, "new", stamp(3)), (2, "newer", stamp(4)), (3, "c", stamp(3)), (4, "none", None)], ddl
    )
    return source, target


def test_incremental_merge_rules(loads):
    source, target = loads
    # the late row and the row without a stamp stay out, the latest of two updates wins
    out = merge.incremental_merge(source, target, ["k"], "dt_ingest")
    assert got(out.select("k", "v")) == [(1, "a"), (2, "newer"), (3, "c")]
    first = merge.incremental_merge(source, None, ["k"], "dt_ingest")
    assert first.count() == source.count()
    assert merge.incremental_merge(source, target.where("k > 9"), ["k"], "dt_ingest").count() == 4  # empty target: first run, last per key
    back = merge.incremental_merge(source, target, ["k"], "dt_ingest", lookback=dt.timedelta(days=1))
    assert (1, "late") in got(back.select("k", "v"))


def test_incremental_merge_is_idempotent(loads):
    source, target = loads
    once = merge.incremental_merge(source, target, ["k"], "dt_ingest")
    twice = merge.incremental_merge(source, once, ["k"], "dt_ingest")
    assert got(once) == got(twice)


def test_high_water_mark_reaches_the_scan(spark, loads, tmp_path):
    source, target = loads
    source.write.parquet(str(tmp_path / "s"))
    newer = merge.newer_rows(spark.read.parquet(str(tmp_path / "s")), target, "dt_ingest")
    assert "GreaterThan(dt_ingest,2024-01-02" in newer._jdf.queryExecution().executedPlan().toString()


def test_schema_sync(rows):
    target = rows([(1, "gone"), (2, "gone")], "k int, dropped string")
    updates = rows([(2, 9)], "k int, added int")
    out = merge.merge_latest(target, updates, ["k"])
    assert out.columns == ["k", "added"] and got(out) == [(1, None), (2, 9)]


def test_only_touched_partitions_are_rewritten(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    ddl = "k int, v string, ano int"
    rows([(1, "a", 2020), (2, "b", 2021), (3, "c", 2021)], ddl).write.partitionBy("ano").parquet(path)
    untouched = sorted(p.name for p in (tmp_path / "t" / "ano=2020").iterdir())
    updates = rows([(2, "x", 2021), (2, "y", 2021), (9, "n", 2022)], ddl)
    for _ in range(2):
        merge.merge_touched_partitions(path, updates, ["k", "ano"], "ano", [F.col("v").desc()])
        assert got(spark.read.parquet(path).select("k", "v", "ano")) == [(1, "a", 2020), (2, "y", 2021), (3, "c", 2021), (9, "n", 2022)]
    assert sorted(p.name for p in (tmp_path / "t" / "ano=2020").iterdir()) == untouched
    merge.merge_touched_partitions(path, updates.where("k > 99"), ["k", "ano"], "ano")
    assert spark.read.parquet(path).count() == 4


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for n in range(1, 5):
        table.write(spark.range(n))
    assert table.versions() == [2, 3, 4] and table.read().count() == 4
    assert table.read(before=4).count() == 3
    # a version that is there already is not written again
    table.write(spark.range(99), version=4)
    assert table.read().count() == 4
    # a folder without the success marker is not a version
    spark.range(7).write.parquet(str(tmp_path / "t" / "v00000009"))
    (tmp_path / "t" / "v00000009" / "_SUCCESS").unlink()
    assert table.versions() == [2, 3, 4]


def discovery(rows, confidence, method="semantic", a="t1", b="t2"):
    ddl = "table_a string, column_a string, table_b string, column_b string, confidence double, discovery_method string"
    return rows([(a, "k", b, "id", confidence, method)], ddl)


def test_discoveries_keep_the_greatest_confidence(spark, rows, tmp_path):
    store = ContextStore(spark, str(tmp_path))
    store.put_discoveries(discovery(rows, 0.92))
    first = store.read("integration_discoveries").head()
    assert first["last_confirmed_at"] is None and first["discovered_at"] is not None
    store.put_discoveries(discovery(rows, 0.60, "content"))
    row = store.read("integration_discoveries").head()
    assert row["confidence"] == 0.92 and row["discovery_method"] == "content"
    assert row["discovered_at"] == first["discovered_at"] and row["last_confirmed_at"] is not None
    assert store.read("integration_discoveries").count() == 1


def test_review_states(spark, rows, tmp_path):
    store = ContextStore(spark, str(tmp_path))
    for b, confidence in (("x", 0.9), ("y", 0.8), ("z", 0.75), ("low", 0.5)):
        store.put_discoveries(discovery(rows, confidence, b=b))
    decide = lambda b, ok: rows([("t1", "k", b, "id", ok)], "table_a string, column_a string, table_b string, column_b string, is_valid boolean")
    store.review(decide("x", True))
    store.review(decide("y", False))
    assert [r["table_b"] for r in store.discoveries("t1").collect()] == ["x", "z"]
    assert [r["table_b"] for r in store.discoveries("t1", 0.85).collect()] == ["x"]
    assert [r["table_b"] for r in store.discoveries("z").collect()] == ["z"]
    # a new find does not undo a review
    store.put_discoveries(discovery(rows, 0.95, b="y"))
    assert store.discoveries("y").count() == 0
    packages = rows([("t1",), ("y",), ("other",)], "package string")
    assert got(gate(packages, store.read("integration_discoveries"))) == [
        ("other", "models/bronze/"), ("t1", "models/"), ("y", "models/bronze/"),
    ]


def test_vocabularies_annotations_profiles(spark, rows, tmp_path):
    store = ContextStore(spark, str(tmp_path))
    store.put_vocabulary(vocabulary_table(spark, Vocabulary()))
    created = store.vocabularies().head()["created_at"]
    store.put_vocabulary(vocabulary_table(spark, Vocabulary(groups={"saude": ["cnes"]}, builtin=False)))
    stored = store.vocabularies().collect()
    assert len(stored) == 1 and stored[0]["source"] == "user-defined" and stored[0]["created_at"] == created
    store.annotate("mir.t", ["cnes", "nr_empenho", "zzz"])
    assert [(r["column_name"], r["domain_group"]) for r in store.annotations("mir.t").collect()] == [
        ("cnes", "saude"), ("nr_empenho", "empenho"), ("zzz", None),
    ]
    df = rows([(1, "x"), (2, None)], "a int, b string")
    store.put_profile(table_profile(df, "t"))
    store.put_profile(table_profile(df.limit(1), "t"))
    row = store.profile("t").head()
    assert row["row_count"] == 1 and row["cardinality_per_col"] == {"a": 1, "b": 1} and row["profiled_at"] is not None
    assert annotate(spark, "t", ["uf"], Vocabulary()).head()["domain_group"] == "uf"


def test_persist_best_match(spark, rows, tmp_path):
    best = rows(
        [("a", "x", "b", "y", 0.94, "j", ["f"], [], ["t"]), ("a", None, "c", None, None, None, None, None, None)],
        "table_a string, column_a string, table_b string, column_b string, confidence double, justification string, "
        "evidence_for array<string>, evidence_against array<string>, required_transformations array<string>",
    )
    store = ContextStore(spark, str(tmp_path))
    store.put_discoveries(best_as_discovery(best))
    kept = store.read("integration_discoveries").collect()
    assert len(kept) == 1 and kept[0]["discovery_method"] == "semantic+content" and kept[0]["required_transforms"] == ["t"]


def run_stream(spark, root, schema, table, **options):
    stream_merge(spark, f"{root}/raw", schema, table, ["k"], "dt_ingest", f"{root}/check", **options).awaitTermination()


def test_stream_equals_batch(spark, loads, tmp_path):
    source, target = loads
    table = VersionedTable(spark, str(tmp_path / "staged"))
    target.coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    run_stream(spark, tmp_path, source.schema, table)
    source.coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    run_stream(spark, tmp_path, source.schema, table)
    assert got(table.read()) == got(merge.incremental_merge(source, target, ["k"], "dt_ingest"))
    before = table.versions()
    run_stream(spark, tmp_path, source.schema, table)  # nothing new
    assert table.versions() == before


def test_stream_upsert_takes_late_rows(spark, loads, tmp_path):
    source, target = loads
    table = VersionedTable(spark, str(tmp_path / "staged"))
    for part in (target, source):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        run_stream(spark, tmp_path, source.schema, table, skip_late=False)
    assert got(table.read().select("k", "v")) == [(1, "late"), (2, "newer"), (3, "c"), (4, "none")]


def test_stream_batches_do_not_change_the_result(spark, tmp_path):
    """Two files, the newer one first: one batch or two, the same table."""
    schema = "k int, dt_ingest timestamp, v string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    files = [[(1, at(5), "new"), (2, at(5), "x")], [(1, at(3), "old"), (3, at(2), "y")]]
    results = []
    for per_batch in (None, 1):
        root = tmp_path / f"run{per_batch}"
        table = VersionedTable(spark, str(root / "staged"))
        spark.createDataFrame([(9, at(1), "seed"), (1, at(1), "seed")], schema).coalesce(1).write.parquet(str(root / "raw"))
        run_stream(spark, root, spark.createDataFrame([], schema).schema, table)
        for f in files:
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(root / "raw"))
            time.sleep(1.1)  # file times order the batches
        run_stream(spark, root, spark.createDataFrame([], schema).schema, table, files_per_batch=per_batch)
        results.append(got(table.read().select("k", "v")))
    assert results[0] == results[1] == [(1, "new"), (2, "x"), (3, "y"), (9, "seed")]


def test_stream_on_a_table_with_versions(spark, tmp_path):
    schema = "k int, dt_ingest timestamp, v string"
    table = VersionedTable(spark, str(tmp_path / "staged"))
    for v in "ab":
        table.write(spark.createDataFrame([(1, dt.datetime(2024, 1, 1), v)], schema))
    spark.createDataFrame([(2, dt.datetime(2024, 1, 2), "c")], schema).write.parquet(str(tmp_path / "raw"))
    run_stream(spark, tmp_path, table.read().schema, table)
    assert got(table.read().select("k", "v")) == [(1, "b"), (2, "c")]


def test_repeated_keys_leave_one_row(spark, rows, tmp_path):
    store = ContextStore(spark, str(tmp_path))
    tags = "table_name string, column_name string, domain_group string, semantic_tags array<string>"
    store.put_annotations(rows([("t", "c", "x", None), ("t", "c", "y", None)], tags))
    assert store.annotations("t").count() == 1
    found = "table_a string, column_a string, table_b string, column_b string, confidence double, discovery_method string"
    store.put_discoveries(rows([("a", "x", "b", "y", 0.5, "s"), ("a", "x", "b", "y", 0.9, "c")], found))
    store.put_discoveries(rows([("a", "x", "b", "y", 0.7, "s"), ("a", "x", "b", "y", 0.8, "c")], found))
    kept = store.read("integration_discoveries").collect()
    assert [r["confidence"] for r in kept] == [0.9]
    store.review(rows([("a", "x", "b", "y", True), ("a", "x", "b", "y", False)], "table_a string, column_a string, table_b string, column_b string, is_valid boolean"))
    assert [r["is_validated"] for r in store.read("integration_discoveries").collect()] == [False]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from keyloom import session

    conf = SimpleNamespace(get=lambda key, default=None: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(SimpleNamespace(sparkContext=context, conf=conf))
