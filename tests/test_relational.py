import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyloom.operators import joins, projection, relational


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_deduplicate_keeps_highest_version(rows):
    df = rows([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, None, "d")], "user_id int, version int, v string")
    out = relational.deduplicate(df, ["user_id"], [F.col("version").desc_nulls_last()])
    assert got(out) == [(1, 2, "b"), (2, 1, "c")]


def test_deduplicate_limits_groups_before_the_shuffle(rows):
    df = rows([(1, 1)], "k int, v int")
    plan = relational.deduplicate(df, ["k"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    exchange, limit = plan.index("Exchange hashpartitioning"), plan.rindex("WindowGroupLimit")
    assert limit > exchange, plan


def test_pivot_gives_zero_not_null(rows):
    df = rows([("S", "red"), ("S", "blue"), ("S", "red"), ("M", "red")], "size string, color string")
    assert got(relational.pivot(df, ["size"], "color", ["red", "blue"])) == [("M", 1, 0), ("S", 2, 1)]
    named = relational.pivot(df, ["size"], "color", ["red", "blue's x"], prefix="p_", quote=False)
    assert named.columns == ["size", "p_red", "p_blues_x"]


def test_unpivot(rows):
    df = rows([(1, "2024", "n", True, None)], "customer_id int, created_at string, name string, is_new boolean, age int")
    out = relational.unpivot(df, exclude=["Customer_ID", "created_at"], remove=["name"], field_name="prop", value_name="val")
    assert got(out) == [(1, "2024", "age", None), (1, "2024", "is_new", "true")]


def test_union_relations(rows):
    t1 = rows([(1, "a", "green"), (2, "b", "red")], "id int, name string, favorite_color string")
    t2 = rows([(1, 7), (3, 9)], "id int, favorite_number int")
    out = relational.union_relations({"t1": t1, "t2": t2})
    assert out.columns == [relational.SOURCE_COLUMN, "id", "name", "favorite_color", "favorite_number"]
    assert out.count() == 4
    assert got(relational.union_relations({"t1": t1, "t2": t2}, include=["ID"], where="id = 1", source_column=None)) == [(1,), (1,)]
    with pytest.raises(ValueError):
        relational.union_relations({"t1": t1}, include=["id"], exclude=["name"])
    with pytest.raises(ValueError):
        relational.union_relations({"t1": t1}, include=["nothing"])


def test_union_where_reaches_both_scans(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(10).write.parquet(str(tmp_path / name))
    frames = {n: spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")}
    plan = relational.union_relations(frames, where="id = 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(id), EqualTo(id,1)]") == 2


def test_symmetric_difference(rows):
    a = rows([(1, None), (1, None), (2, "x")], "k int, v string")
    b = rows([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert got(relational.symmetric_difference(a, b)) == [("a_minus_b", 1, None), ("b_minus_a", 3, "y")]


def test_date_spine_end_is_exclusive(rows):
    bounds = rows([("2018-01-01", "2018-01-10")], "start string, end string").selectExpr("timestamp(start) start", "timestamp(end) end")
    days = relational.date_spine(bounds, "day", out_type="date").orderBy("date_day").collect()
    assert len(days) == 9 and days[-1][0] == dt.date(2018, 1, 9)
    with pytest.raises(Exception, match="must lie after"):
        relational.date_spine(bounds.select(F.col("end").alias("start"), "end"), "day").collect()


def test_number_series(spark):
    assert [r[0] for r in relational.number_series(spark, 10).collect()] == list(range(1, 11))
    with pytest.raises(ValueError):
        relational.number_series(spark, 0)


def test_column_values(spark, rows):
    df = rows([("a",), ("b",), ("b",), (None,), (None,), (None,)], "v string")
    assert [r["value"] for r in relational.column_values(df, "v", max_records=2).collect()] == [None, "b"]
    assert [r["value"] for r in relational.column_values_or(spark, "no_such_table", "v", ["x"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        relational.column_values_or(spark, "no_such_table", "v")


def test_single_value(rows):
    df = rows([("2017-01-01", 1.5)], "d string, f double")
    assert got(relational.single_value(df)) == [("2017-01-01",)]
    assert got(relational.single_value(df.where("f > 9"), "none")) == [("none",)]
    assert got(relational.single_value(df.where("f > 9"))) == [(None,)]


def test_star(rows):
    df = rows([(1, 2, 3)], "field_1 int, field_2 int, field_3 int")
    assert df.select(projection.star(df, ["FIELD_3"], "p_", "_s")).columns == ["p_field_1_s", "p_field_2_s"]
    assert projection.star(df, df.columns) == []
    assert projection.keep_columns(df, ["field_3", "zzz", "field_1"]).columns == ["field_3", "field_1"]


def test_blank_to_null_and_json(rows):
    df = rows([("", " ", 1)], "a string, b string, c int")
    assert got(projection.blank_to_null(df)) == [(None, " ", 1)]
    nested = df.select(F.struct("c").alias("s"), F.array("c").alias("l"), "c")
    assert got(projection.nested_to_json(nested)) == [('{"c":1}', "[1]", 1)]


def test_validation_gate(rows):
    df = rows([("1", "5"), (None, "5"), ("x", "50")], "code string, n string")
    rules = projection.column_rules(df, {"code": {"required": True, "type": "int"}, "n": {"type": "int", "max": 10}})
    good, bad = projection.validation_gate(df, rules)
    assert got(good) == [("1", "5")]
    assert got(bad.select("code", F.array_join("faults", ","))) == [("x", "code:type,n:max"), (None, "code:required")]
    assert tuple(projection.gate_summary(df, rules).head()) == (3, 1, 2)
    missing = projection.column_rules(df, {"other": {"required": True}})
    assert projection.validation_gate(df, missing)[0].count() == 0


def test_match_rate(rows):
    side = lambda vs: rows([(v,) for v in vs], "v string")
    rate = lambda a, b: joins.match_rate(side(a), "v", side(b), "v").head()["match_rate"]
    assert rate(["ABC", "DEF", "GHI"], ["ABC", "DEF", "GHI", "XYZ"]) == 1.0
    assert rate(["ABC", "ZZZ"], ["ABC"]) == 0.5
    assert rate(["a-b", "a-b", None, "q"], [" AB "]) == pytest.approx(2 / 3)
    assert rate([None], ["x"]) == 0.0


def test_common_groups(rows):
    a, b = rows([(1, 2020), (2, 2021)], "k int, y int"), rows([(9, 2021), (8, 2022)], "k int, y int")
    left, right = joins.common_groups(a, F.col("y"), b, F.col("y"))
    assert got(left) == [(2, 2021)] and got(right) == [(9, 2021)]


def test_enrich_keeps_unmatched_rows(rows):
    a = rows([(1, 2020, "x"), (2, 2020, "y"), (None, 2020, "z")], "ug int, ano int, v string")
    b = rows([(1, 2020, "p"), (1, 2020, "q")], "ug int, ano int, ptres string")
    assert got(joins.enrich(a, b, {"ug": "ug", "ano": "ano"}, ["ptres"])) == [
        (1, 2020, "x", "p"),
        (1, 2020, "x", "q"),
        (2, 2020, "y", None),
        (None, 2020, "z", None),
    ]
