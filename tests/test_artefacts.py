"""Artefacts in chunks, pages of several shapes, derived keys."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from keyloom.plans.derived import default_transforms, derived_key_search
from keyloom.plans.discovery import Tables, overlap_matrix
from keyloom.sources import artefacts, pages

DAY = date(2024, 1, 31)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip_over_the_cell_limit(spark, tmp_path):
    big = bytes(i * 7 % 251 for i in range(10_000))
    rows = [("big.bin", 0, big[:4000]), ("big.bin", 1, big[4000:]), ("empty", 0, b""), ("text", 0, "é\n\0".encode())]
    path = artefacts.write_artefacts(spark.createDataFrame(rows, "name string, part int, content binary"), str(tmp_path), "src", DAY, chunk_bytes=999)
    assert path.endswith("/raw/src/2024-01-31/artefacts")
    assert {r["name"]: (r["length"], r["chunks"]) for r in artefacts.list_artefacts(spark, path).collect()} == {"big.bin": (10_000, 5 + 7), "empty": (0, 1), "text": (4, 1)}
    assert {r["name"]: bytes(r["content"]) for r in artefacts.read_whole(spark, path).collect()} == {"big.bin": big, "empty": b"", "text": "é\n\0".encode()}
    for begin, length in ((0, 10), (3990, 2100), (9990, 100), (20_000, 5)):
        found = artefacts.read_range(spark, path, "big.bin", begin, length).orderBy("begin").collect()
        assert b"".join(bytes(r["content"]) for r in found) == big[begin : begin + length]
    assert artefacts.damaged_artefacts(spark, path).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        artefacts.write_artefacts(spark.createDataFrame(rows, "name string, part int, content binary"), str(tmp_path), "src", DAY)


def test_damage_is_seen(spark, tmp_path):
    path = artefacts.write_artefacts(spark.createDataFrame([("a", b"x" * 50), ("b", b"y")], "name string, content binary"), str(tmp_path), "s", DAY, chunk_bytes=10)
    spark.createDataFrame([("a", 0, 9, b"z")], "name string, part long, chunk long, content binary").write.mode("append").parquet(f"{path}/chunks")
    assert got(artefacts.damaged_artefacts(spark, path)) == [("a",)]


def test_pages_of_several_shapes(spark, tmp_path):
    bodies = [
        {"page": 1, "hasNext": True, "data": {"items": [{"id": 1, "v": 1.5}, {"id": 2, "tags": ["x"]}]}},
        {"page": 2, "hasNext": True, "data": {"items": {"id": 3, "v": 2, "sub": {"a": None}}}},
        {"page": 3, "hasNext": True, "data": None},
        {"page": 4, "hasNext": False, "error": "none"},
    ]
    for i, body in enumerate(bodies):
        (tmp_path / f"p{i}.json").write_text(json.dumps(body, indent=1))
    landed = pages.read_pages(spark, str(tmp_path))
    assert dict(landed.dtypes)["page"] == "bigint" and "error" in landed.columns
    rows = pages.page_records(landed, "data.items")
    assert got(rows.select("id", "v", "tags")) == sorted([(1, 1.5, None), (2, None, ["x"]), (3, 2.0, None)], key=str)
    assert got(pages.page_records(landed, "data.items", "id string, more int")) == [("1", None), ("2", None), ("3", None)]
    assert pages.page_completeness(landed, "page", "hasNext").head()["complete"] is True
    single = pages.read_pages(spark, str(tmp_path / "p1.json"))
    assert pages.page_records(single, "data.items").columns == ["id", "sub", "v"]


def test_derived_key_search(rows):
    a = rows([("NE-000123",), ("NE-000456",), ("NE-000456",), ("x",), (None,)], "k string")
    b = rows([(123,), (456,), (789,)], "n int")
    best = derived_key_search(a, "k", b, "n").where("rank = 1").head()
    assert (best["transform_a"], best["transform_b"], best["rows_a"], best["hits"], best["match_rate"]) == ("digits_no_leading_zeros", "as_is", 4, 3, 0.75)
    assert derived_key_search(a.limit(0), "k", b, "n").count() == 0
    mine = derived_key_search(a, "k", b, "n", {"tail": lambda c: F.substring(c, -3, 3), **default_transforms()})
    assert mine.where("transform_a = 'tail' AND transform_b = 'as_is'").head()["hits"] == 3


def test_overlap_of_many_columns(spark):
    """Several hundred columns, and the least shared values of each pair."""
    wide = lambda n, prefix, step: spark.range(40).select(*[((F.col("id") * step + i) % 97).cast("string").alias(f"{prefix}{i}") for i in range(n)])
    out = overlap_matrix(Tables({"a": wide(130, "a", 1), "b": wide(90, "b", 3)}))
    assert out.count() == 130 * 90
    row = out.where("column_a = 'a5' AND column_b = 'b7'").head()
    shared = {str((i + 5) % 97) for i in range(40)} & {str((3 * i + 7) % 97) for i in range(40)}
    assert row["intersection"] == len(shared) and row["sample_matches"] == sorted(shared)[:5]
