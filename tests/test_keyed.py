"""Commit records, versioned and keyed tables, and streams into them."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from keyloom.sources.commits import CommitLog, Conflict
from keyloom.sources.keyed import KeyedTable, append_copy
from keyloom.sources.versions import VersionedTable
from keyloom.streaming import incremental


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, None)
    assert log.add(1, {"by": "a"}) and not log.add(1, {"by": "b"}) and log.add(2, {"é": [1]})
    assert log.latest() == (2, {"é": [1]}) and log.get(1) == {"by": "a"} and log.numbers() == [1, 2]
    assert [p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json" or "tmp" in p.name] != []


def test_two_writers_of_a_versioned_table(spark, rows, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.write(rows([("seed",)], "v string"))

    def slow(current):
        if b.versions() == [1]:  # the other writer commits while this one works
            b.update(lambda now: now.unionAll(rows([("b",)], "v string")))
        return current.unionAll(rows([("a",)], "v string"))

    a.update(slow)
    assert got(a.read()) == [("a",), ("b",), ("seed",)] and a.versions() == [1, 2, 3]

    class Late(VersionedTable):
        def _commit(self, df, version, tag):
            VersionedTable(spark, self.path).write(rows([("other",)], "v string"))
            return super()._commit(df, version, tag)

    with pytest.raises(Conflict):
        Late(spark, str(tmp_path / "t")).write(rows([("mine",)], "v string"))
    assert got(a.read()) == [("other",)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == len(a.versions())


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=64)


def test_merge_touches_few_buckets(spark, table):
    table.merge(spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = table.log.latest()[1]["folders"]
    read = []
    original = table.bucket_paths
    table.bucket_paths = lambda record, buckets: read.append(original(record, buckets)) or read[-1]
    table.merge(spark.range(3).select(F.col("id").alias("k"), F.lit("new").alias("v")))
    after = table.log.latest()[1]["folders"]
    changed = {b for b in after if after[b] != before[b]}
    assert len(before) == 64 and 1 <= len(changed) <= 3
    assert [len(paths) for paths in read] == [len(changed)]  # all that the merge read
    assert got(table.read().groupBy("v").count()) == [("new", 3), ("old", 4997)]
    plan_files = table.read().inputFiles()
    assert sum(any(after[b] in f for b in changed) for f in plan_files) == len(changed)


def test_columns_follow_the_updates(spark, table, rows):
    table.merge(rows([(i, "x", i) for i in range(50)], "k int, gone string, n int"))
    table.merge(rows([(1, 7, "y")], "k int, n int, added string"))
    assert table.read().columns == ["k", "n", "added"]
    assert got(table.read().where("k < 3")) == [(0, 0, None), (1, 7, "y"), (2, 2, None)]
    # a wider type: every bucket is rewritten
    table.merge(rows([(2, 1.5, "z")], "k long, n double, added string"))
    assert dict(table.read().dtypes) == {"k": "bigint", "n": "double", "added": "string"}
    assert got(table.read().where("k < 4")) == [(0, 0.0, None), (1, 7.0, "y"), (2, 1.5, "z"), (3, 3.0, None)]


def test_repeats_tags_nulls_and_nothing(spark, table, rows):
    order = [F.col("v").desc()]
    assert table.read() is None
    one = table.merge(rows([(1, "a"), (1, "b"), (None, "n")], "k int, v string"), order, tag="first")
    assert table.merge(rows([(1, "zzz")], "k int, v string"), order, tag="first") == one and table.has("first")
    assert got(table.read()) == [(1, "b"), (None, "n")]
    assert table.merge(rows([], "k int, v string"), order) == one
    empty = KeyedTable(spark, table.path + "-empty", ["k"])
    empty.merge(rows([], "k int, v string"))
    assert empty.read().count() == 0 and empty.read().columns == ["k", "v"]


def test_old_versions_go(spark, table, rows, tmp_path):
    for i in range(6):
        table.merge(rows([(j, i) for j in range(i, 40)], "k int, v int"))
    assert table.versions() == [4, 5, 6] and table.read().count() == 40 and table.read(4).count() == 40
    assert got(table.read().where("k < 3")) == [(0, 0), (1, 1), (2, 2)]
    kept = {f for v in table.versions() for f in table.log.get(v)["folders"].values()}
    assert {p.name for p in tmp_path.joinpath("t").glob("data-*") if list(p.glob("__bucket=*"))} == kept


@pytest.mark.parametrize("other, expected", [(5, [(1, "mine"), (5, "theirs")]), (1, [(1, "mine"), (5, "seed")])])
def test_two_writers_of_a_keyed_table(spark, table, rows, other, expected):
    """The other writer commits in the middle: in another bucket, or in the same one."""
    ddl = "k int, v string, seen string"
    table.merge(rows([(1, "seed", None), (5, "seed", None)], ddl))
    rival = KeyedTable(spark, table.path, ["k"])
    worked = []

    def combine(old, new):
        if not worked:
            rival.merge(rows([(other, "theirs", None)], ddl))
        worked.append(1)
        seen = old.select("k", F.col("v").alias("was"))
        stay = old.join(new, "k", "left_anti")
        return stay.unionByName(new.join(seen, "k", "left").select("k", "v", F.col("was").alias("seen")))

    table.merge(rows([(1, "mine", None)], ddl), combine=combine)
    assert got(table.read().select("k", "v")) == expected
    # where both touched one bucket the work was done anew, from what the other had left
    assert len(worked) == (1 if other == 5 else 2)
    assert table.read().where("k = 1").head()["seen"] == ("seed" if other == 5 else "theirs")


def test_incremental_loads_by_the_recorded_mark(spark, table, rows):
    at = lambda day: dt.datetime(2024, 1, day)
    ddl = "k int, v string, t timestamp"
    table.load_newer(rows([(1, "a", at(1)), (2, "b", at(2)), (2, "b2", at(3)), (4, "none", None)], ddl), "t")
    assert table.mark("t") is not None and got(table.read().select("k", "v")) == [(1, "a"), (2, "b2"), (4, "none")]
    source = rows([(1, "late", at(2)), (2, "new", at(4)), (3, "c", at(5))], ddl)
    table.load_newer(source, "t")
    assert got(table.read().select("k", "v")) == [(1, "a"), (2, "new"), (3, "c"), (4, "none")]
    table.load_newer(source, "t", lookback=dt.timedelta(days=3, hours=1))
    assert got(table.read().select("k", "v")) == [(1, "late"), (2, "new"), (3, "c"), (4, "none")]


def test_append_copy(spark, rows, tmp_path):
    path = str(tmp_path / "copy")
    append_copy(rows([(1, "a")], "id int, nome string"), path)
    append_copy(rows([("2",), ("2",)], "id string"), path)
    assert got(spark.read.parquet(path)) == [(1, "a"), (2, None), (2, None)]
    with pytest.raises(ValueError):
        append_copy(rows([(1, 2)], "id int, more int"), path)


@pytest.mark.parametrize("kind", ["keyed", "versioned"])
def test_killed_and_restarted_stream_equals_one_run(spark, tmp_path, monkeypatch, kind):
    schema = "k int, dt_ingest timestamp, v string"
    types = spark.createDataFrame([], schema).schema
    at = lambda h: dt.datetime(2024, 1, 1, h)
    # the newer file comes first; what is left after the failure is below the table's mark by then
    files = [[(1, at(9), "new"), (2, at(9), "x")], [(1, at(3), "old"), (3, at(4), "y"), (5, at(1), "too late")], [(4, at(5), "z")]]
    results = []
    for fails in (False, True):
        root = tmp_path / f"run{fails}"
        table = KeyedTable(spark, str(root / "t"), ["k"], 4) if kind == "keyed" else VersionedTable(spark, str(root / "t"))

        def run():
            incremental.stream_merge(spark, f"{root}/raw", types, table, ["k"], "dt_ingest", f"{root}/check", files_per_batch=1).awaitTermination()

        spark.createDataFrame([(9, at(2), "seed"), (1, at(2), "seed")], schema).coalesce(1).write.parquet(f"{root}/raw")
        run()
        for f in files:
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{root}/raw")
            time.sleep(1.1)  # file times order the batches
        if fails:
            has = type(table).has
            calls = []

            def failing(self, tag):
                calls.append(tag)
                if len(calls) == 2:
                    raise RuntimeError("killed")
                return has(self, tag)

            monkeypatch.setattr(type(table), "has", failing)
            with pytest.raises(Exception):
                run()
            monkeypatch.undo()
            assert got(table.read().select("k", "v")) == [(1, "new"), (2, "x"), (9, "seed")]
        run()
        results.append(got(table.read().select("k", "v")))
    assert results[0] == results[1] == [(1, "new"), (2, "x"), (3, "y"), (4, "z"), (9, "seed")]
