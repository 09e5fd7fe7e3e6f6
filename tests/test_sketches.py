"""Profiles united from the sketches of loads."""

from pyspark.sql import functions as F

from keyloom.operators import sketches
from keyloom.operators.profile import column_profile, table_profile


def test_loads_unite_to_the_profile_of_the_whole(spark, tmp_path):
    df = spark.range(20_000).select(
        F.col("id"),
        (F.col("id") % 7).cast("string").alias("few"),
        F.when(F.col("id") % 10 < 4, F.col("id") % 3000).alias("some"),
        F.lit(None).cast("int").alias("none"),
        F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("hot"),
    )
    store = sketches.StoredSketches(spark, str(tmp_path / "s"))
    read = []
    for load in range(4):
        part = df.where(F.col("id") % 4 == load)
        store.add(f"2024-0{load}", part)
        read.append(part)
    store.add("2024-03", df.where("id % 4 = 3"))  # again: replaced, not added
    got = {r["column_name"]: r for r in store.profile().collect()}
    want = {r["column_name"]: r for r in column_profile(df).collect()}
    assert got.keys() == want.keys()
    for c in got:
        assert got[c]["row_count"] == want[c]["row_count"] and abs(got[c]["null_rate"] - want[c]["null_rate"]) < 1e-12
        assert abs(got[c]["unique_count"] - want[c]["unique_count"]) <= 0.03 * want[c]["unique_count"]
        assert (got[c]["dtype"], got[c]["family"], got[c]["cardinality"]) == (want[c]["dtype"], want[c]["family"], want[c]["cardinality"])
    assert got["hot"]["top_values"][0] == "often" and sorted(got["few"]["top_values"])[0] >= "0" and got["none"]["top_values"] == []
    counts = {(r["column_name"], r["value"]): r["n"] for r in sketches.confirmed(df, store.profile()).collect()}
    assert counts["hot", "often"] == 10_000
    mine, whole = store.table_profile("t").head(), table_profile(df, "t").head()
    assert (mine["row_count"], mine["quality_ok"]) == (whole["row_count"], whole["quality_ok"])


def test_a_profile_reads_sketches_only(spark, tmp_path):
    store = sketches.StoredSketches(spark, str(tmp_path / "s"))
    spark.range(10).write.parquet(str(tmp_path / "data"))
    store.add("a", spark.read.parquet(str(tmp_path / "data")))
    plan = store.profile()._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "s") in plan and str(tmp_path / "data") not in plan


def test_new_columns_and_empty_loads(spark, tmp_path):
    store = sketches.StoredSketches(spark, str(tmp_path / "s"))
    store.add("1", spark.createDataFrame([], "k int, v string"))
    assert [(r["row_count"], r["unique_count"], r["null_rate"]) for r in store.profile().collect()] == [(0, 0, 1.0)] * 2
    store.add("2", spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    store.add("3", spark.createDataFrame([(3, 1.5)], "k int, added double"))
    got = {r["column_name"]: (r["row_count"], r["unique_count"], round(r["null_rate"], 3)) for r in store.profile().collect()}
    assert got == {"k": (3, 3, 0.0), "v": (3, 1, 0.667), "added": (3, 1, 0.667)}
