import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import names, numbers, similarity, strings
from keyloom.functions.vocabulary import Vocabulary, load_vocabulary, vocabulary_table


def values(df, column):
    """One column's values over literal rows, in row order."""
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_name_forms(rows):
    assert names.name_form("  Nr_Empenho ", "match") == "nr_empenho"
    assert names.name_form("CD.ORGAO", "match") == "cd_orgao"
    assert names.name_form("numEmpenho", "staged") == "numempenho"
    assert names.name_form("numEmpenho", "staged", snake=True) == "num_empenho"
    slugs = {"": "", "!Hell0 world-hi": "hell0_world_hi", "0Hell0 world-hi": "_0hell0_world_hi"}
    for text, slug in slugs.items():
        assert names.name_form(text, "slug") == slug
    samples = [*slugs, "  Nr_Empenho ", "CD.ORGAO", "a__b--c", "ação 1"]
    df = rows([(s,) for s in samples], "v string")
    for form in names.FORMS:
        assert values(df, names.name_form_col(F.col("v"), form)) == [names.name_form(s, form) for s in samples]


def test_rename_clash(rows):
    with pytest.raises(ValueError):
        names.rename_columns(rows([(1, 2)], "`a.b` int, `a b` int"))


def test_normalize_and_codes(rows):
    df = rows([(" abc ",), ("def",), ("12.345-6",), ("78/90",)], "v string")
    assert values(df, strings.normalize_text(F.col("v"))) == ["ABC", "DEF", "123456", "7890"]
    df = rows([("123",), ("45",), ("1234567",), ("-5",), ("+77",), ("",)], "v string")
    assert values(df, strings.pad_left(F.col("v"), 6)) == ["000123", "000045", "1234567", "-00005", "+00077", "000000"]
    df = rows([("AB-123",), ("456/CD",)], "v string")
    assert values(df, strings.digits(F.col("v"))) == ["123", "456"]
    assert values(rows([("000",), ("0012",)], "v string"), strings.strip_zeros(F.col("v"))) == ["", "12"]


def test_whole_doubles_read_like_integers(rows):
    df = rows([(1.0,), (2.5,), (None,), (1e20,)], "v double")
    assert values(df, strings.plain_text(F.col("v"), df.schema["v"].dataType)) == ["1", "2.5", None, "1.0E20"]


def test_identifiers(rows):
    df = rows([("12345600001" + "2023NE000123",), ("nonsense",)], "v string")
    parts = values(df, strings.parse_identifier(F.col("v")))
    assert tuple(parts[0]) == ("123456", "00001", "2023", "NE", "000123")
    assert set(parts[1]) == {None}
    assert values(df, strings.shorten_identifier(F.col("v"))) == ["2023NE000123", None]


def test_urls(rows):
    data = [
        ("https://a.example.com/x/y?utm_medium=mail&utm_source=s#f", "a.example.com", "x/y", "mail"),
        ("a.example.com?utm_medium=", "a.example.com", "", None),
        ("android-app://app.example/z", "app.example", "/app.example/z", None),
        ("example.com", "example.com", "example.com", None),
    ]
    df = rows(data, "u string, h string, p string, m string")
    url = F.col("u")
    got = df.select(strings.url_host(url), strings.url_path(url), strings.url_parameter(url, "utm_medium")).collect()
    assert [tuple(r) for r in got] == [d[1:] for d in data]


def test_surrogate_key(rows):
    import hashlib

    df = rows([("a", None, 1)], "x string, y string, z int")
    cols = [F.col(c) for c in "xyz"]
    expected = hashlib.md5(b"a-_dbt_utils_surrogate_key_null_-1").hexdigest()
    assert values(df, strings.surrogate_key(cols)) == [expected]
    assert values(df, strings.surrogate_key(cols, "")) == [hashlib.md5(b"a--1").hexdigest()]


def test_arithmetic(rows):
    df = rows([(1, None, 3)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    assert values(df, numbers.safe_add(cols)) == [4]
    assert values(df, numbers.safe_subtract(cols)) == [-2]
    with pytest.raises(ValueError):
        numbers.safe_add([])
    df = rows([(7, 2), (7, 0), (0, 5), (None, 1)], "n int, d int")
    assert values(df, numbers.safe_divide(F.col("n"), F.col("d"))) == [3.5, None, 0.0, None]
    df = rows([(-1.0,), (0.0,), (9.9,), (10.0,), (99.0,), (100.0,)], "v double")
    assert values(df, numbers.width_bucket(F.col("v"), F.lit(0), F.lit(100), F.lit(10))) == [0, 1, 1, 2, 10, 11]


def test_haversine(rows):
    df = rows([(48.864716, 2.349014, 52.379189, 4.899431)], "a double, b double, c double, d double")
    points = [F.col(c) for c in "abcd"]
    assert round(values(df, numbers.haversine(*points, unit="km"))[0]) == 430
    assert round(values(df, numbers.haversine(*points))[0]) == 267
    with pytest.raises(ValueError):
        numbers.haversine(*points, unit="m")


def test_name_similarity(rows):
    df = rows([("nr_empenho", "nr_empenho"), ("nr_empenho", "cd_orgao"), ("nr_empenho", "num_empenho")], "a string, b string")
    same, low, near = values(df, similarity.name_similarity(F.col("a"), F.col("b")))
    assert same == 1.0 and low < 0.5 and near >= 0.75


def test_type_compatibility_has_a_direction(rows):
    df = rows([("int64", "object"), ("object", "int64"), ("float64", "int64"), ("date", "date"), ("date", "object")], "a string, b string")
    assert values(df, similarity.types_compatible(F.col("a"), F.col("b"))) == [True, False, True, True, False]


def test_cardinality_labels(rows):
    df = rows([(0.96,), (0.95,), (0.5,)], "u double")
    assert values(df, similarity.cardinality_label(F.col("u"))) == ["high (near-unique)", "medium", "low (repetitive)"]


def test_vocabulary_groups(rows):
    df = rows([("nr_empenho",), ("CD.ORGAO",), ("coluna_desconhecida_xyz",), ("l_linenumber",), ("uf_origem",)], "v string")
    vocabulary = Vocabulary()
    assert values(df, vocabulary.group_of(F.col("v"))) == ["empenho", "orgao", None, "empenho", "uf"]
    assert values(df, vocabulary.group_of(F.col("v"), min_partial_len=4)) == ["empenho", "orgao", None, None, None]
    wider = vocabulary.overlay([{"xyz": ["coluna_desconhecida"], "orgao": ["nada"]}])
    assert values(df, wider.group_of(F.col("v"))) == ["empenho", None, "xyz", "empenho", "uf"]


def test_vocabulary_file(spark, tmp_path):
    assert load_vocabulary(spark).builtin and load_vocabulary(spark, str(tmp_path / "none.json")).builtin
    good = tmp_path / "good.json"
    good.write_text('{"domain_name": "d", "semantic_groups": {"g": ["a", "b"]}}')
    loaded = load_vocabulary(spark, str(good))
    assert (loaded.name, dict(loaded.groups), dict(loaded.patterns)) == ("d", {"g": ["a", "b"]}, {})
    for text in ("{", '{"domain_name": "d"}', '{"domain_name": "d", "semantic_groups": []}'):
        bad = tmp_path / "bad.json"
        bad.write_text(text)
        with pytest.raises(ValueError):
            load_vocabulary(spark, str(bad))
    row = vocabulary_table(spark, loaded).head()
    assert row["semantic_groups"] == {"g": ["a", "b"]} and row["source"] == "user-defined"
    assert len(vocabulary_table(spark, Vocabulary()).head()["semantic_groups"]) == 16


def test_months_are_counted_by_boundary(rows):
    df = rows([("2024-01-31", "2024-02-01")], "a string, b string").selectExpr("timestamp(a) a", "timestamp(b) b")
    assert values(df, numbers.date_diff("month", F.col("a"), F.col("b"))) == [1]
    assert math.isclose(values(df, numbers.date_diff("day", F.col("a"), F.col("b")))[0], 1)


def test_text_ratio_equals_the_definition(spark):
    from difflib import SequenceMatcher

    import random

    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("ab", "ba"), ("abcbdab", "bdcaba"), ("éa_b", "b_éa")]
    pairs += [tuple("".join(rng.choices("abc_", k=rng.randint(0, 14))) for _ in "xy") for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").repartition(4).select("a", "b", similarity.text_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in got.collect():
        assert r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio(), r
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(similarity.text_ratio(F.col("a"), F.col("b"))).head()[0] is None


def test_fixed_text_rounds_as_the_binary_value(spark):
    import random

    rng = random.Random(8)
    numbers_ = [0.0, 0.125, 0.375, 0.345, 0.355, 2.675, 1.005, 0.5, 0.25, 0.05, 99.95, 100.0, 1234.25, 1e-9, 0.999, 12345678.5, 4.0, 8.0, 0.0005]
    numbers_ += [round(rng.random() * rng.choice([1, 100, 5000]), rng.choice([1, 2, 3, 9])) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in numbers_], "x double").select("x", *[numbers.fixed_text(F.col("x"), p).alias(f"p{p}") for p in (1, 2, 3)])
    for r in df.collect():
        assert (r["p1"], r["p2"], r["p3"]) == (f"{r['x']:.1f}", f"{r['x']:.2f}", f"{r['x']:.3f}"), r
