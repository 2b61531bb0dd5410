"""One file from many partitions: round trips, sheets that go on, failed and empty writes."""

from __future__ import annotations

import datetime
import os
import zipfile
import zlib
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators.tidy import ROW
from tessella.sources import sink, tables, xlsx


def _wide(spark, n, parts=5):
    """n rows dealt in no order, of several types."""
    rows = spark.range(n).repartition(parts, F.hash("id"))
    return rows.select(F.col("id").alias(ROW), F.concat(F.lit('é<&"\n'), "id").alias("text"), F.expr("if(id % 7 = 0, null, id * 2)").alias("n"), (F.col("id") / 4).alias("x"), F.expr("id % 2 = 0").alias("b"))


@pytest.mark.parametrize(("first", "second"), [(b"", b""), (b"a", b""), (b"", b"bc"), (b"some text", b"\x00" * 100_000)])
def test_joined_checksums(first, second):
    assert sink.joined_crc(zlib.crc32(first), zlib.crc32(second), len(second)) == zlib.crc32(first + second)


def test_workbook_of_many_partitions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "deep/a.xlsx")
    df = _wide(spark, 20_000)
    assert tables.save(df, path, "xlsx") == path
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None and [x for _, x in xlsx.sheets(book)] == ["xl/worksheets/sheet1.xml"]
    want = [(r[ROW], r["text"], r["n"], r["x"], r["b"]) for r in df.orderBy(ROW).collect()]
    got = tables.read_table(spark, path).orderBy(ROW)
    assert [tuple(r) for r in got.collect()] == want
    assert got.columns == [ROW, "text", "n", "x", "b"]
    assert os.listdir(tmp_path / "deep") == ["a.xlsx"]


def test_sheets_go_on_and_keep_every_row(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    sink.save(spark.range(0, 1000, 1, 7).toDF("n"), path, "xlsx", sheet_rows=101)
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        names = xlsx.sheets(book)
    cells = tables.read_cells(spark, path)
    rows = cells.where("row > 1").orderBy("sheet_no", "row").select("v_str").collect()
    assert [int(r[0]) for r in rows] == list(range(1000))
    heads = cells.where("row = 1").select("sheet", "v_str", "bold").collect()
    assert sorted(x[0] for x in heads) == sorted(x for x, _ in names) and all(x[1] == "n" and x[2] for x in heads)
    assert cells.agg(F.max("row")).first()[0] <= 101


def test_values_that_sheets_lack(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    moment, old = datetime.datetime(2020, 2, 29, 13, 30), datetime.date(1801, 2, 3)
    row = (float("nan"), float("inf"), Decimal("1.50"), moment, old, None, "a\x01b", "", "x" * 40_000)
    df = spark.createDataFrame([row], "nan double, inf double, dec decimal(5,2), t timestamp, old date, none int, c string, empty string, long string")
    sink.save(df, path, "xlsx")
    found = {(r["row"], r["col"]): (r["py_type"], r["v_str"]) for r in tables.read_cells(spark, path).collect()}
    assert (2, 1) not in found and (2, 6) not in found
    assert found[2, 2] == ("str", "inf") and found[2, 3] == ("float", "1.5") and found[2, 4] == ("datetime", str(moment))
    assert found[2, 5] == ("str", "1801-02-03") and found[2, 7] == ("str", "ab") and found[2, 8] == ("str", "") and found[2, 9] == ("str", row[-1])


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_empty_table_and_repeated_names(spark, tmp_path, kind):
    path = str(tmp_path / f"a.{kind}")
    df = spark.range(3).select("id", F.col("id").alias("id"))
    tables.save(df.limit(0), path, kind)
    assert tables.read_cells(spark, path).where("row = 1").count() == 2 and tables.read_cells(spark, path).where("row > 1").count() == 0
    tables.save(df, path, kind)
    assert tables.read_cells(spark, path).where("row > 1").count() == 6


@pytest.mark.parametrize(("kind", "encoding"), [("csv", "utf-8"), ("csv", "utf-16"), ("csv-bom", "utf-8")])
def test_csv_of_many_partitions(spark, tmp_path, kind, encoding):
    path = str(tmp_path / "a.csv")
    df = _wide(spark, 20_000)
    tables.save(df, path, kind, encoding)
    got = pd.read_csv(path, encoding="utf-8-sig" if kind == "csv-bom" else encoding)
    assert got.text.tolist() == [f'é<&"\n{i}' for i in range(20_000)] and got.n.isna().sum() == len(range(0, 20_000, 7))


def test_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.range(0, 40_000, 1, 4).select(F.expr("if(id = 35000, raise_error('stop'), id)").alias("n"))
    with pytest.raises(Exception, match="stop"):
        sink.save(df, path, "xlsx")
    assert os.listdir(tmp_path) == []
    sink.save(spark.range(2), path, "xlsx")
    before = os.stat(path).st_size
    with pytest.raises(Exception, match="stop"):
        sink.save(df, path, "xlsx")
    assert os.stat(path).st_size == before


def test_files_are_not_appended_to_and_width_is_checked(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    sink.save(spark.range(2), path)
    with pytest.raises(Exception, match="a.csv"):
        spark.range(3).write.format(sink.NAME).mode("append").save(path)
    assert open(path).read().split() == ["id", "0", "1"]
    with pytest.raises(ValueError, match="columns"):
        sink._Workbook(["c"] * 16_385, 10)
