import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import checks
from keyloom.operators.neighbours import with_next
from keyloom.operators.suite import RowRule, TableRule, run_suite


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def ids(rows):
    return rows([(i,) for i in (-1, 0, 5, 11, None)], "id int")


def test_accepted_range(ids):
    assert got(checks.accepted_range(ids, "id", -1, 11)) == []
    assert got(checks.accepted_range(ids, "id", -1, 11, inclusive=False)) == [(-1,), (11,)]
    assert got(checks.accepted_range(ids, "id", 0, where="id <> -1")) == []
    assert got(checks.accepted_range(ids, "id")) == []


def test_at_least_one(rows):
    df = rows([(1, None), (1, "a"), (2, None)], "g int, v string")
    assert got(checks.at_least_one(df, "v", ["g"])) == [(2, 0)]
    assert got(checks.at_least_one(df, "v")) == []
    assert got(checks.at_least_one(df.where("g = 2"), "v")) == [(0,)]


def test_not_constant(rows):
    df = rows([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "g int, v string")
    assert got(checks.not_constant(df, "v", ["g"])) == [(1, 1)]
    assert got(checks.not_constant(df, "v")) == []
    assert got(checks.not_constant(df.where("g = 1"), "v")) == [(1,)]


def test_cardinality_equality(rows):
    a, b = rows([(1,), (1,), (2,)], "x int"), rows([(1,), (2,), (2,)], "y int")
    assert got(checks.cardinality_equality(a, "x", b, "y")) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got(checks.cardinality_equality(a, "x", a, "x")) == []


def failures(check):
    return check.failures().head()[0]


def test_row_counts(rows):
    a, b = rows([("x",)] * 3 + [("only_a",)] + [(None,)], "g string"), rows([("x",)] * 2 + [(None,)], "g string")
    # a group on one side only, and the NULL group, pass unless strict
    assert failures(checks.equal_rowcount(a, b, ["g"])) == 1
    assert failures(checks.equal_rowcount(a, b)) == 2
    assert failures(checks.equal_rowcount(a, a)) == 0
    assert failures(checks.equal_rowcount(a, b, ["g"], strict=True)) == 4
    assert failures(checks.fewer_rows_than(b, a)) == 0
    assert failures(checks.fewer_rows_than(a, b)) == 2
    assert failures(checks.fewer_rows_than(a, a)) == 1


def test_equality(rows):
    a = rows([(1, 1.00004, "x"), (1, 1.00004, "x"), (2, 2.0, "y")], "id int, n double, ignored string")
    b = rows([(1, 1.00001, "q"), (2, 2.0, "q")], "id int, n double, ignored string")
    assert failures(checks.equality(a, b, compare_columns=["id"])) == 0
    assert failures(checks.equality(a, b, exclude_columns=["IGNORED"], precision=4)) == 0
    assert failures(checks.equality(a, b, exclude_columns=["ignored"], precision=8)) == 2
    # two rows on one side only: two failures plus the imbalance of two
    assert failures(checks.equality(a, b.where("id = 9"), compare_columns=["id"])) == 4
    with pytest.raises(ValueError):
        checks.equality(a, b, compare_columns=["id"], exclude_columns=["n"])
    with pytest.raises(ValueError):
        checks.equality(a, b.drop("n"))


def test_expression_is_true(rows):
    df = rows([(0.5, 0.5), (0.4, 0.5), (None, 1.0)], "col_a double, col_b double")
    assert got(checks.expression_is_true(df, "col_a + col_b = 1")) == [(0.4, 0.5)]
    assert got(checks.expression_is_true(df, "= 0.5", column="col_a", where="col_a > 0.45")) == []


def test_strings_and_values(rows):
    df = rows([("a",), ("   ",), ("",), (None,)], "s string")
    assert got(checks.not_empty_string(df, "s")) == [("",), ("",)]
    assert got(checks.not_empty_string(df.where("s <> ''"), "s", trim=False)) == []
    cities = rows([("Madrid",), ("Madrid",), ("Paris",), (None,)], "city string")
    assert got(checks.not_accepted_values(cities, "city", ["Madrid", "Berlin"])) == [("Madrid",)]
    assert got(checks.accepted_values(cities, "city", ["Paris"])) == [("Madrid", 2)]
    assert got(checks.unique(cities, "city")) == [("Madrid", 2)]
    assert got(checks.not_null(cities, "city")) == [(None,)]
    assert got(checks.unique_combination(cities, ["city"])) == [("Madrid",)]
    assert got(checks.assert_equal(rows([(1, 1), (1, 2), (None, 3)], "a int, b int"), "a", "b")) == [(1, 2)]


def test_not_null_proportion(rows):
    df = rows([(1, None), (1, 2), (2, 3), (2, 4)], "g int, v int")
    assert got(checks.not_null_proportion(df, "v", 0.75, 0.75)) == []
    assert got(checks.not_null_proportion(df, "v", 0.9)) == [(0.75,)]
    assert got(checks.not_null_proportion(df, "v", 0.9, groups=["g"])) == [(1, 0.5)]


def test_recency(rows):
    df = rows([("2024-05-09 00:00:00", 1), ("2024-05-10 06:00:00", 2)], "t string, g int").withColumn("t", F.expr("timestamp(t)"))
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    assert got(checks.recency(df, "t", "day", 1, now)) == []
    late = checks.recency(df, "t", "day", 1, now, groups=["g"])
    assert [r["g"] for r in late.collect()] == [1]
    # yesterday midnight is fresh by date, stale by time
    assert got(checks.recency(df, "t", "day", 1, now, ignore_time=True, groups=["g"])) == []


def test_relationships(rows):
    a, b = rows([(1,), (4,), (4,), (5,), (None,)], "id int"), rows([(1,), (None,)], "id int")
    assert got(checks.relationships_where(a, "id", b, "id", "id <> 5")) == [(4, None), (4, None)]


def plain_ranges(data, gaps, zero):
    """The same check, spelled out over sorted lists."""
    out = []
    groups = {}
    for g, lo, hi in data:
        groups.setdefault(g, []).append((lo, hi))
    key = lambda v: (v is None, v if v is not None else 0)
    less = lambda x, y, strict: x is not None and y is not None and (x < y if strict else x <= y)
    for g, items in groups.items():
        items.sort(key=lambda r: (key(r[0]), key(r[1])))
        for i, (lo, hi) in enumerate(items):
            last = i == len(items) - 1
            nxt = None if last else items[i + 1][0]
            ok_len = less(lo, hi, not zero)
            if hi is None or nxt is None:
                ok_gap = last
            else:
                ok_gap = {"allowed": hi <= nxt, "not_allowed": hi == nxt, "required": hi < nxt}[gaps]
            if not (ok_len and ok_gap):
                out.append((g, lo, hi, nxt, last))
    return sorted(out, key=str)


@pytest.mark.parametrize("gaps", ["allowed", "not_allowed", "required"])
@pytest.mark.parametrize("zero", [False, True])
def test_ranges_against_brute_force(rows, gaps, zero):
    rng = random.Random(3)
    data = []
    for i in range(600):
        g = 1 if i % 3 else rng.randrange(5)  # one group holds most rows
        lo = rng.choice([None] + list(range(40))) if rng.random() < 0.5 else i
        hi = None if rng.random() < 0.05 else (lo or 0) + rng.choice([0, 1, 1, 2, -1])
        data.append((g, lo, hi))
    df = rows(data, "g int, lo int, hi int")
    found = checks.mutually_exclusive_ranges(df, "lo", "hi", partition_by="g", gaps=gaps, zero_length=zero)
    columns = ["partition_by_col", "lower_bound", "upper_bound", "next_lower_bound", "is_last_record"]
    assert got(found.select(columns)) == plain_ranges(data, gaps, zero)


def test_ranges_arguments(rows):
    df = rows([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        checks.mutually_exclusive_ranges(df, "a", "b", gaps="some")
    assert got(checks.mutually_exclusive_ranges(df, "a", "coalesce(b, 9)")) == []


def test_sequences_against_brute_force(rows):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2]), rng.randrange(300) * 2) for _ in range(500)] + [(2, None)]
    expected = []
    for g in (1, 2):
        values = sorted(v for k, v in data if k == g and v is not None)
        expected += [(g, b, a) for a, b in zip(values, values[1:]) if b != a + 2]
    df = rows(data, "col_a int, my_even_sequence int")
    found = checks.sequential_values(df, "my_even_sequence", 2, groups=["col_a"])
    assert found.columns == ["col_a", "my_even_sequence", "previous_my_even_sequence"]
    assert got(found) == sorted(expected, key=str)


def test_hourly_sequence(rows):
    hours = [dt.datetime(2021, 1, 1, h) for h in (0, 1, 2, 4)]
    df = rows([(h,) for h in hours], "my_timestamp timestamp")
    assert got(checks.sequential_values(df, "my_timestamp", 1, datepart="hour")) == [(hours[3], hours[2])]


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "ddl,data",
    [
        ("v string", [f"Customer#{i:018d}" for i in range(0, 900, 3)]),  # a long common prefix
        ("v date", [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(300)]),
        ("v double", [-INF, *[i / 7 for i in range(300)], INF]),
    ],
)
def test_next_value_over_ranges(rows, ddl, data):
    df = rows([(v,) for v in data] + [(None,)], ddl).repartition(5)
    found = {r["v"]: (None if r["next"] is None else (r["next"]["v"],)) for r in with_next(df, [], "v").collect()}
    expected = dict(zip(data, [(v,) for v in data[1:] + [None]]))
    assert found == {**expected, None: None}


def test_next_value_with_nan(rows):
    df = rows([(1, 1.0), (1, NAN), (1, 3.0), (2, NAN), (3, None), (3, 2.0)], "k int, v double")
    found = {(r["k"], str(r["v"])): r["next"] and str(r["next"]["v"]) for r in with_next(df, ["k"], "v").collect()}
    assert found == {(1, "1.0"): "3.0", (1, "3.0"): "nan", (1, "nan"): None, (2, "nan"): None, (3, "2.0"): "None", (3, "None"): None}


def test_a_hot_group_is_spread_over_ranges(spark):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1)
    df = spark.range(9000).select(hot.alias("k"), F.col("id").alias("v"))
    found = with_next(df, ["k"], "v").where("k = 0").selectExpr("v", "next.v AS n").collect()
    assert all(r["n"] == (r["v"] + 3 if r["v"] < 8997 else None) for r in found) and len(found) == 3000


def test_rows_are_repeated_in_shares(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, 100_000)], "k int, n long")
    assert got(checks.repeated(df, "n").groupBy("k").count()) == [(1, 3), (3, 100_000)]
    assert got(checks.repeated(df, "n", most=2).groupBy("k").count()) == [(1, 3), (3, 100_000)]


def test_one_value_repeated_very_often(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 29_000, 7).otherwise(F.col("id")).alias("v"))
    failing = checks.sequential_values(df, "v").groupBy("v").count().collect()
    assert sorted(tuple(r) for r in failing) == [(7, 28_999), (29_000, 1)]


def test_equality_with_very_large_numbers(rows):
    a = rows([(1e21,), (NAN,), (1.234,), (None,)], "x double")
    b = rows([(1e21,), (1.2344,), (None,), (None,)], "x double")
    left = checks.equality(a, b, precision=2).rows.collect()
    assert len(left) == 1 and str(left[0]["x"]) == "nan"


def test_suite_tells_rules_of_one_name_apart(rows):
    df = rows([(None, None)], "a int, b int")
    rules = [RowRule("not_null", "a", F.col("a").isNotNull()), RowRule("not_null", "b", F.col("b").isNotNull(), severity="warn")]
    assert got(run_suite(df, rules)) == [("not_null", "a", 1, "fail"), ("not_null", "b", 1, "warn")]


def test_column_set_and_non_empty(spark, rows):
    df = rows([(1, 2)], "Field_1 int, field_2 int")
    assert got(checks.column_set(spark, df, ["FIELD_1", "field_3"])) == [("FIELD_2", None), (None, "FIELD_3")]
    assert got(checks.non_empty(df)) == []
    assert got(checks.non_empty(df.where("field_2 = 0"), "t")) == [("t: load returned zero rows",)]


def test_suite_fuses_row_rules_into_one_scan(rows):
    df = rows([(1, "a"), (2, None), (2, "")], "id int, s string")
    rules = [
        RowRule("positive", "id", checks.in_range("id", 1)),
        RowRule("text", "s", checks.has_text("s"), severity="warn"),
        RowRule("present", "s", F.col("s").isNotNull(), error_if="> 5"),
        TableRule("unique", "id", checks.unique(df, "id")),
    ]
    assert got(run_suite(df, rules)) == [
        ("positive", "id", 0, "pass"),
        ("present", "s", 1, "warn"),
        ("text", "s", 1, "warn"),
        ("unique", "id", 1, "fail"),
    ]
    plan = run_suite(df, rules[:3])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
