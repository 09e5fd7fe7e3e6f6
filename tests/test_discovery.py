import pytest
from pyspark.sql import functions as F

from keyloom.functions.vocabulary import Vocabulary
from keyloom.operators import profile
from keyloom.plans import discovery, models


@pytest.fixture
def text(rows):
    return lambda name, values: rows([(v,) for v in values], f"{name} string")


def evidence(text, a, b):
    tables = discovery.two_tables("a", text("x", a), "b", text("y", b))
    return discovery.with_content(tables, discovery.column_pairs(tables)).head()


def test_same_format_is_promoted(text):
    years = ["2020", "2021", "2022"] * 30
    found = evidence(text, years, years)
    assert found["format_match"] and found["format_a"] == "exercicio" and found["promoted"]


def test_different_format(text):
    found = evidence(text, ["2020", "2021"] * 30, ["12.345.678/0001-90"] * 60)
    assert not found["format_match"] and found["format_b"] == "cnpj"


def test_overlap_and_no_overlap(text):
    codes = ["ABC", "DEF", "GHI"] * 30
    found = evidence(text, codes, codes)
    assert found["overlap_rate"] == 1.0 and found["promoted"]
    found = evidence(text, ["AAA", "BBB"] * 30, ["XXX", "YYY"] * 30)
    assert found["overlap_rate"] == 0.0 and not found["promoted"]


def test_derived_key_by_substring(text):
    short = ["NE000123", "NE000456"] * 20
    long = ["123456789002023NE000123", "123456789002023NE000456"] * 20
    found = evidence(text, short, long)
    assert found["substring_match_rate"] == 1.0 and found["promoted"] and found["content_score"] == 0.8


def test_content_score_boundary(rows):
    df = rows([(0.7, 0.2), (0.0, 0.625), (0.0, 0.62)], "o double, s double")
    scores = [r[0] for r in df.select(discovery.content_score(F.lit(False), F.col("o"), F.col("s")).alias("c")).collect()]
    assert scores == [0.5, 0.5, 0.496]


def test_renamed_key_is_found_by_content(rows):
    codes = [f"REG{i:05d}" for i in range(50)]
    a, b = rows([(c,) for c in codes], "chave_x string"), rows([(c,) for c in codes], "id_y string")
    best = discovery.candidates(discovery.two_tables("a", a, "b", b)).head()
    assert best["discovery_method"] == "content" and best["content_score"] >= 0.5
    assert best["evidence_for"][0] == "Content-promoted: content_score=1.000 >= 0.5"
    assert "Format mismatch: 'None' vs 'None'" in best["evidence_against"]
    assert best["required_transformations"] == ["Investigate substring/concatenation transform to align keys"]


def test_same_name_key(rows):
    codes = [f"2023NE{i:06d}" for i in range(50)]
    a = rows([(c,) for c in codes], "nr_empenho string")
    b = rows([(c,) for c in codes[:30]], "num_empenho string")
    ranked = discovery.candidates(discovery.two_tables("a", a, "b", b))
    best = ranked.head()
    assert best["discovery_method"] == "semantic" and best["semantic"] >= 0.75
    assert best["match_rate"] == 0.6 and best["cardinality"] == "high (near-unique)" and best["pattern_a"] == "empenho"
    # 0.35 * 0.857 + 0.30 * 0.6 + 0.20 + 0.15
    assert best["score"] == pytest.approx(round(0.35 * best["semantic"] + 0.3 * 0.6 + 0.2 + 0.15, 4))
    assert best["evidence_for"][1:] == [
        "Both columns belong to domain group 'empenho'",
        "Moderate match rate: 60.0%",
        "Both match domain pattern 'empenho'",
    ]
    decided = discovery.decide(ranked, [("a", "b"), ("a", "c")]).orderBy("table_b").collect()
    assert decided[0]["justification"].startswith("High name similarity (0.86): 'nr_empenho' ~ 'num_empenho' | Both columns")
    assert decided[1]["summary"] == "No candidate keys found above threshold." and decided[1]["column_a"] is None


def test_no_false_key(rows):
    a = rows([(f"A{i}",) for i in range(50)], "col_x string")
    b = rows([(f"Z{i}",) for i in range(50)], "nome string")
    assert discovery.candidates(discovery.two_tables("a", a, "b", b)).count() == 0


def test_name_evidence_against(rows):
    a = rows([("0001", 1)] * 3 + [(None, 2)] * 2, "codigo string, n int")
    b = rows([(1.5,), (None,), (None,)], "codigo double")
    found = {(r["column_a"], r["column_b"]): r for r in discovery.candidates(discovery.two_tables("a", a, "b", b)).collect()}
    row = found["codigo", "codigo"]
    assert row["evidence_against"] == [
        "Low match rate: 0.0%",
        "Incompatible dtypes: object vs float64",
        "High null rate in codigo: 40.0%",
        "High null rate in codigo: 66.7%",
    ]
    assert row["required_transformations"] == ["Cast codigo (float64) to object before join"]


def test_overlap_matrix_against_sets(rows):
    a = rows([(i, f"k-{i % 7}") for i in range(40)], "n int, s string")
    b = rows([(float(i), f"K{i % 5}", i % 2 == 0) for i in range(30, 60)], "d double, s string, f boolean")
    found = {(r["column_a"], r["column_b"]): r for r in discovery.overlap_matrix(discovery.two_tables("a", a, "b", b)).collect()}
    numbers = found["n", "d"]
    assert (numbers["unique_a"], numbers["unique_b"], numbers["intersection"]) == (40, 30, 10)
    assert numbers["match_rate_a_in_b"] == 0.25
    texts = found["s", "s"]
    assert (texts["unique_a"], texts["unique_b"], texts["intersection"]) == (7, 5, 5)
    assert texts["sample_matches"] == ["K0", "K1", "K2", "K3", "K4"]
    assert found["n", "f"]["intersection"] == 0


def test_more_columns_than_one_bit_word(rows):
    width = 70
    a = rows([tuple(range(i, i + width)) for i in range(3)], ", ".join(f"a{i} int" for i in range(width)))
    b = rows([(69,), (71,), (500,)], "b int")
    found = {r["column_a"]: r["intersection"] for r in discovery.overlap_matrix(discovery.two_tables("a", a, "b", b)).where("table_b = 'b'").collect()}
    assert {k: v for k, v in found.items() if v} == {"a67": 1, "a68": 1, "a69": 2}


def test_value_index_has_no_cross_join(rows):
    a, b = rows([(1,)], "x int"), rows([(1,)], "y int")
    plan = discovery.overlap_matrix(discovery.two_tables("a", a, "b", b))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_map_tables_uses_content_for_distant_tables(rows):
    codes = [(f"REG{i:05d}", i) for i in range(50)]
    a = rows(codes, "chave string, zz int")
    b = rows(codes, "qwerty string, mnbv int")
    c = rows(codes, "chave string, zz int")
    found = discovery.map_tables(discovery.Tables({"a": a, "b": b, "c": c})).where("rank = 1").collect()
    by_pair = {(r["table_a"], r["table_b"]): r for r in found}
    assert by_pair["a", "c"]["discovery_method"] == "semantic" and by_pair["a", "c"]["column_a"] == "chave"
    assert by_pair["a", "b"]["discovery_method"] == "content" and by_pair["a", "b"]["column_b"] == "qwerty"


def test_affinity_can_ignore_housekeeping_columns(rows):
    a, b = rows([(1, 2)], "load_id int, abc int"), rows([(1, 2)], "load_id int, xyz int")
    score = lambda **o: discovery.affinity(discovery.two_tables("a", a, "b", b, **o)).head()
    assert score()["affinity"] > score(ignore=["LOAD_ID"])["affinity"]


def test_coverage(rows):
    a, b = rows([(1, 2, 3)], "cd_orgao int, foo int, bar int"), rows([(1,)], "uf int")
    got = discovery.coverage(discovery.two_tables("a", a, "b", b)).head()
    assert (got["total_columns"], got["recognized"], got["coverage"], got["passes_threshold"]) == (4, 2, 0.5, False)
    assert got["unrecognized_columns"] == ["foo", "bar"]


def test_auto_pairs_wants_key_like_columns(rows):
    a = rows([(i, i % 2) for i in range(40)], "id_a int, id_flag int")
    b = rows([(i,) for i in range(40)], "id_b int")
    found = discovery.auto_pairs(discovery.two_tables("a", a, "b", b)).collect()
    assert [(r["column_a"], r["column_b"]) for r in found] == [("id_a", "id_b")]


def test_column_profile(rows):
    df = rows([("a", 1), ("a", 2), ("b", None), (None, None)], "s string, n int")
    got = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    s = got["s"]
    assert (s["unique_count"], s["null_rate"], s["uniqueness_rate"], s["top_values"]) == (2, 0.25, pytest.approx(2 / 3), ["a", "b"])
    assert got["n"]["null_rate"] == 0.5 and got["n"]["cardinality"] == "high (near-unique)"
    empty = profile.column_profile(df.where("n > 99")).collect()
    assert {(r["null_rate"], r["uniqueness_rate"], tuple(r["top_values"])) for r in empty} == {(1.0, 0.0, ())}
    rough = {r["column_name"]: r["unique_count"] for r in profile.column_profile(df, approx=True).collect()}
    assert rough == {"s": 2, "n": 2}


def test_table_profile(rows):
    df = rows([(1, "x"), (2, None), (3, "y")], "nr_empenho int, cd_orgao string")
    got = profile.table_profile(df, "t").head()
    assert (got["row_count"], got["quality_ok"], got["cardinality_per_col"]) == (3, True, {"nr_empenho": 3, "cd_orgao": 2})
    assert got["exercicio_distribution"] is None
    empty = profile.table_profile(df.where("nr_empenho > 9"), "t").head()
    assert (empty["row_count"], empty["quality_ok"], empty["cardinality_per_col"]) == (0, True, {"nr_empenho": 0, "cd_orgao": 0})
    years = rows([("2022",), ("2022",), ("2023",), (None,)], "ano_exercicio string")
    got = profile.table_profile(years, "t").head()
    assert got["exercicio_distribution"] == {"2022": 2, "2023": 1, "nan": 1} and got["quality_ok"] is False


def test_years(rows):
    df = rows([("2022",)] * 2 + [("2023",)] * 3 + [("x",)], "v string")
    assert profile.year_map(df, "v").head()[0] == {"2022": 2, "2023": 3}
    assert profile.year_column(df).head()[0] == "v"
    assert profile.year_column(rows([("Recife",), ("Natal",)], "v string")).head()[0] is None
    assert profile.year_column(rows([("1234",), ("2020",)], "v string")).head()[0] is None
    named = rows([("2020", 7)], "v string, ANO int")
    assert profile.year_column(named, Vocabulary().groups).head()[0] == "ANO"


def test_pattern_profile(rows):
    df = rows([(i, f"{i:05d}", None) for i in range(300)], "k int, code string, nothing string")
    got = {r["column_name"]: r for r in profile.pattern_profile(df, ["code", "nothing"], order_by=["k"]).collect()}
    # two patterns fit five digits; the first in order wins
    assert got["code"]["best_pattern"] == "orgao" and got["code"]["pattern_scores"]["uo"] == 1.0
    assert got["code"]["sample_values"] == [f"{i:05d}" for i in range(5)] and got["code"]["avg_length"] == 5.0
    assert got["nothing"]["best_pattern"] is None and got["nothing"]["avg_length"] is None


def test_samples_skip_nulls_with_and_without_order(rows):
    data = [(i, None if i % 2 else f"v{i:03d}") for i in range(100)]
    df = rows(data, "k int, v string")
    expected = [f"v{i:03d}" for i in range(0, 20, 2)]
    for order in ([], ["k"]):
        got = {r["column_name"]: r["sample"] for r in profile.column_samples(df, ["k", "v"], 10, order).collect()}
        assert got == {"k": [str(i) for i in range(10)], "v": expected}


def test_samples_do_not_shuffle_the_table(spark):
    plan = profile.column_samples(spark.range(10), ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "hashpartitioning" not in plan


def test_derived_key_and_panel(rows):
    a = rows([("Customer#000000007",), ("Customer#000000008",)], "name string")
    b = rows([(7,), (9,)], "k int")
    from keyloom.functions.strings import digits, pad_left

    got = models.derived_key_rate(a, "name", b, "k", digits, lambda c: pad_left(c, 9)).head()
    assert (got["rows_a"], got["rate_before"], got["rate_after"]) == (2, 0.0, 0.5)

    facts = rows([(1, 10, "A"), (2, 5, "A"), (3, 7, None)], "num int, valor int, ug string")
    plans = rows([(1, "p"), (1, "q"), (1, "q")], "num int, plano string")
    panel = models.execution_panel(facts, plans, {"num": "num"}, {"ug": "ug"}, "num", F.col("valor"), "plano")
    assert sorted((tuple(r) for r in panel.collect()), key=str) == [("A", 2, 35, 2), (None, 1, 7, 0)]


@pytest.mark.parametrize("n", [100, 10_000])
def test_growth_and_order_do_not_lose_a_key(spark, n):
    """The same keys, one table sorted the other way."""
    a = spark.range(n).select(F.format_string("%06d", F.col("id")).alias("chave_x"))
    b = spark.range(n).select(F.format_string("%06d", n - 1 - F.col("id")).alias("id_y"))
    best = discovery.candidates(discovery.two_tables("a", a, "b", b)).head()
    assert (best["column_a"], best["column_b"], best["match_rate"]) == ("chave_x", "id_y", 1.0)


def test_types_do_not_hide_a_key_in_either_order(spark):
    words = spark.range(60).select(F.col("id").cast("string").alias("kkkk"), F.lit("z").alias("uuuu"))
    numbers = spark.range(60).select(F.col("id").alias("qqqq"), F.lit("y").alias("wwww"))
    for first, second in ((words, numbers), (numbers, words)):
        best = discovery.map_tables(discovery.two_tables("a", first, "b", second)).where("rank = 1").head()
        assert best is not None and {best["column_a"], best["column_b"]} == {"kkkk", "qqqq"}


def test_inside_counts_against_brute_force(rows):
    data = {"x": ["ab", "b", "abc", ""], "y": ["zabz", "abc", "q"], "z": ["a", "zz", "éb"]}
    frames = {k: rows([(v,) for v in vs], f"{k} string") for k, vs in data.items()}
    tables = discovery.Tables(frames)
    cids = [c for c, *_ in tables.columns]
    sets, words = discovery.value_sets(tables, cids)
    got = {(tables.columns[r["inner"]][1], tables.columns[r["outer"]][1]): r["held"] for r in discovery.inside_counts(sets, words, cids).collect()}
    want = {(i, o): sum(any(v in w for w in data[o]) for v in set(data[i])) for i in data for o in data if i != o}
    assert got == {k: n for k, n in want.items() if n}


def test_values_are_counted_before_they_become_text(spark):
    """The first grouping is of native values, so rows that repeat a value are not turned into text one by one."""
    df = spark.range(1000).selectExpr("id % 5 AS k", "IF(id % 4 = 0, NULL, id % 3 + 0.5D) AS x", "IF(id % 2 = 0, '7', 'b') AS s", "date_from_unix_date(CAST(id % 2 AS INT)) AS d")
    tables = discovery.Tables({"t": df})
    cids = [c[0] for c in tables.columns]
    counted = discovery.value_counts(tables, cids)
    got = {(tables.columns[r["cid"]][3].name, r["value"], r["number"]): r["n"] for r in counted.collect()}
    want = {("k", str(i), True): 200 for i in range(5)} | {("x", f"{i}.5", True): 250 for i in range(3)} | {("x", None, True): 250}
    want |= {("s", "7", False): 500, ("s", "b", False): 500, ("d", "1970-01-01", False): 500, ("d", "1970-01-02", False): 500}
    assert got == want
    sets, _ = discovery.value_sets(tables, cids)
    assert {(r["value"], r["number"], r["w0"]) for r in sets.where("value = '7' OR value = '4'").collect()} == {("7", False, 4), ("4", True, 1)}
    numbers = discovery.value_counts(discovery.Tables({"t": df.select("k")}), [0])._jdf.queryExecution().optimizedPlan().toString()
    top, below = numbers.split("\n", 1)
    assert top.startswith("Aggregate") and "as string)" in top and "as string)" not in below


def test_column_facts_weigh_all_rows(spark):
    rows = [("12345", 1)] * 6 + [("x", None)] * 3 + [(None, 2)] * 3
    tables = discovery.two_tables("a", spark.createDataFrame(rows, "code string, n int"), "b", spark.createDataFrame([], "e string"))
    cids = [c[0] for c in tables.columns]
    got = {r["cid"]: r.asDict() for r in discovery.column_facts(tables, cids, discovery.value_counts(tables, cids)).collect()}
    assert got[0] == {"cid": 0, "pattern": "orgao", "avg_length": (6 * 5 + 3) / 9, "present": 9, "rows": 12}
    assert got[1] == {"cid": 1, "pattern": None, "avg_length": 1.0, "present": 9, "rows": 12}
    assert got[2] == {"cid": 2, "pattern": None, "avg_length": None, "present": 0, "rows": 0}
