import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from keyloom.session import scratch_dir
from keyloom.sources import delimited, pages, zones


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_delimited_text_keeps_codes(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('cd_contrato;vl;nome\n001;1.5;"a;b"\n002;;c\n', encoding="utf-8")
    df = delimited.read_delimited(spark, str(path), sep=";", columns=["nome", "cd_contrato", "zzz"])
    assert df.columns == ["nome", "cd_contrato"] and got(df) == [("a;b", "001"), ("c", "002")]
    typed = delimited.read_delimited(spark, str(path), sep=";", types={"vl": "double"})
    assert [r["vl"] for r in typed.collect()] == [1.5, None]


def test_encoding(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("nome,n\nação,1\n".encode("latin-1"))
    assert got(delimited.read_delimited(spark, str(path), encoding="iso-8859-1")) == [("ação", "1")]


def test_skip_rows_in_every_file_and_later_splits(spark, tmp_path):
    for i in range(3):
        body = "".join(f"{i}{j:04d},v{j}\n" for j in range(400))
        (tmp_path / f"f{i}.csv").write_text(f"# made by {i}\n\ncode,v\n{body}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = delimited.read_delimited(spark, str(tmp_path), skip_rows=2)
        assert df.columns == ["code", "v"] and df.count() == 1200
        assert df.where("code = 'code' or code like '#%'").count() == 0
        assert df.agg(F.count_distinct("code")).head()[0] == 1200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dump(spark, tmp_path):
    path = tmp_path / "d.csv.gz"
    path.write_bytes(gzip.compress(b"a,b\n1,x\n2,y\n"))
    config = {"type": "dump", "file_path": str(path), "columns": ["b"]}
    assert got(delimited.read_source(spark, config)) == [("x",), ("y",)]
    with pytest.raises(ValueError):
        delimited.read_source(spark, {**config, "format": "sql"})
    with pytest.raises(ValueError):
        delimited.read_source(spark, {"type": "other"})


def test_pages(spark, tmp_path):
    for i, more in ((1, True), (2, True), (3, False)):
        body = {"page": i, "payload": {"data": [{"id": i * 10 + j, "v": "x"} for j in range(2)]}, "hasNext": more}
        (tmp_path / f"p{i}.json").write_text(json.dumps(body, indent=1))
    landed = pages.read_pages(spark, str(tmp_path))
    assert got(pages.page_records(landed, "payload.data").select("id")) == [(10,), (11,), (20,), (21,), (30,), (31,)]
    assert pages.page_records(landed, "payload").columns == ["data"]
    assert tuple(pages.page_completeness(landed, "page", "hasNext").head()) == (3, 3, 1, 3, True)
    gap = landed.where("page <> 2")
    assert pages.page_completeness(gap, "page", "hasNext").head()["complete"] is False
    cut = landed.where("page <> 3")
    assert pages.page_completeness(cut, "page", "hasNext").head()["complete"] is False


def test_raw_zone_is_written_once(spark, tmp_path):
    path = zones.write_raw(spark.range(3), str(tmp_path), "src", "response", date(2024, 1, 2))
    assert path.endswith("/raw/src/2024-01-02/response") and zones.read_raw(spark, path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        zones.write_raw(spark.range(9), str(tmp_path), "src", "response", date(2024, 1, 2))


def test_artefacts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    rows = zones.read_artefacts(spark, str(tmp_path), "*.pdf").collect()
    assert [(r["length"], bytes(r["content"])) for r in rows] == [(5, b"12345")]


def test_staging(spark, rows, tmp_path):
    df = rows([(1, 2)], "`Nr.Empenho` int, ` UG ` int")
    for _ in range(2):
        assert zones.stage(df, str(tmp_path), "My Source", date(2024, 5, 6)) == "my_source_20240506"
    assert zones.list_staged(spark, str(tmp_path)) == ["my_source_20240506"]
    back = zones.read_staged(spark, str(tmp_path), "my_source_20240506")
    assert back.columns == ["nr_empenho", "ug"] and back.count() == 1
    assert zones.list_staged(spark, str(tmp_path / "none")) == []


def test_load_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    for i, (rows_, ok) in enumerate([(10, True), (20, True), (30, False)]):
        zones.record_load(spark, path, "src", "t", "s", rows_, ok, F.timestamp_seconds(F.lit(i)))
    good = zones.usable_tables(spark.read.parquet(path)).collect()
    assert [(r["table_name"], r["row_count"]) for r in good] == [("t", 20)]


def test_table_lookup(spark, rows):
    for name in ("data_events_20180101", "data_events_20180102", "data_events_tmp"):
        spark.range(1).createOrReplaceTempView(name)
    listed = zones.catalog_tables(spark)
    found = zones.find_tables(listed, "%", "DATA_EVENTS_%", exclude="%_tmp")
    assert sorted(zones.relations(spark, found)) == ["data_events_20180101", "data_events_20180102"]
    assert zones.find_tables_by_prefix(listed, "%", "data_events_2018").count() == 2


def test_metadata_and_sample(spark, rows):
    df = rows([(i, None if i == 0 else f"v{i}") for i in range(20)], "k int, v string")
    got_ = {r["column_name"]: r for r in zones.table_metadata(df, "t", {"v": "Value"}, ["k"]).collect()}
    assert got_["v"]["sample_values"] == ["v1", "v2", "v3", "v4", "v5"] and got_["v"]["description"] == "Value"
    assert got_["k"]["row_count"] == 20 and got_["k"]["dtype"] == "int"
    first = got(zones.seeded_sample(df, ["k"], 5))
    assert first == got(zones.seeded_sample(df.repartition(3), ["k"], 5)) and len(first) == 5
    assert got(zones.seeded_sample(df, ["k"], 5, seed=1)) != first
    assert zones.seeded_sample(df, ["k"], 500).count() == 20


def test_result_sink(spark, rows, tmp_path):
    path = zones.write_result(rows([(1, ["a"])], "k int, e array<string>"), str(tmp_path / zones.result_name("a", "b")))
    assert path.endswith("identificar_chave_a__b.json") and spark.read.json(path).head()["e"] == ["a"]


def test_scratch_is_shared_and_fresh(spark):
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
