"""CSV files: records over line ends, doubled quotes, splits in any place, dialects."""

from __future__ import annotations

import csv
import io
import random

import pandas as pd
import pytest

from tessella.operators.tidy import ROW
from tessella.sources import csv_records, tables


def texts(n: int, seed: int, end: str) -> str:
    """A CSV text of n rows with quoted line ends, doubled quotes, separators in quotes, quotes within fields and empty ones."""
    rng = random.Random(seed)
    words = ["plain", "two\nlines", "a\r\nb", 'He said "hi", twice', "", "x,y", '"', "é\nß\n\nü", "tail\n", ' "not a quote', 'in"ner', "7"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "note"])
    for i in range(n):
        writer.writerow([i, rng.choice(words), rng.choice(words)])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    """Files are cut every hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def same(spark, path, encoding="utf-8", **reading) -> pd.DataFrame:
    """Rows as pandas reads them, in order."""
    found = tables.read_csv(spark, str(path)).orderBy(ROW)
    want = pd.read_csv(path, encoding=encoding, **reading)
    assert found.columns[:-1] == list(want.columns)
    rows = [tuple(None if v is None else str(v) for v in r[:-1]) for r in found.collect()]
    assert rows == [tuple(None if pd.isna(v) else str(v) for v in r) for r in want.itertuples(index=False)]
    assert [r[ROW] for r in found.collect()] == list(range(len(want)))
    return want


def test_two_records_of_the_issue(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"two\nlines"\n2,"He said ""hi"", twice"\n3,x\n')
    assert len(same(spark, path)) == 3


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin1"])
def test_records_across_splits(small_splits, tmp_path, end, encoding):
    path = tmp_path / "a.csv"
    path.write_bytes(texts(60, 1, end).encode(encoding))
    lines = csv_records.file_lines(small_splits, str(path), "\n")
    at = csv_records.layout(lines, csv_records.Dialect())
    assert lines.rdd.getNumPartitions() > 8 and any(at.inside) and at.rows == 61 and at.width == at.widest == 3
    same(small_splits, path, encoding.removesuffix("-sig"))


def test_a_quoted_field_longer_than_splits(small_splits, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"' + "line, of text\n" * 60 + '"\n2,b\n\n3,"c\n"\n')
    assert len(same(small_splits, path)) == 3


@pytest.mark.parametrize("seed", range(6))
def test_walk_against_the_csv_module(seed):
    """Where lines stand, and how wide records are, as a reader that goes through the whole text has it."""
    rng = random.Random(seed)
    text = "h1,h2\n" + "".join(rng.choice(['"', '""', ",", "a", "\n", "b "]) for _ in range(400))
    try:
        want = [r for r in csv.reader(io.StringIO(text, newline=""), strict=False)]
    except csv.Error:
        return
    inside, found, own, width = False, [], [], 0
    for line in text.split("\n"):
        if not inside and not line.strip():
            continue
        inside, n = csv_records.walk(line.encode(), inside, b",", b'"')
        own.append(line)
        width += n
        if not inside:
            found.append(("\n".join(own), width + 1))
            own, width = [], 0
    if inside:
        found.append(("\n".join(own), width + 1))
    want = [r for r in want if r]
    assert [w for _, w in found] == [len(r) for r in want]
    assert [csv_records.fields(t, csv_records.Dialect()) for t, _ in found[:-1]] == want[:-1]


def test_types_of_records_over_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,x,when,b,t,t,\n1,1.5,2020-01-02,true,"a\nb",u,\n,2,,false,,v,w\n')
    found = tables.read_csv(spark, str(path))
    assert found.dtypes == [("n", "int"), ("x", "double"), ("when", "date"), ("b", "boolean"), ("t", "string"), ("t.1", "string"), ("_c6", "string"), (ROW, "bigint")]
    assert [r["t"] for r in found.orderBy(ROW).collect()] == ["a\nb", None]


def test_a_row_wider_than_the_header_refuses_a_separator(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b;c\n" + "1,2;3\n" * 5000 + "1,2,3,4;5\n" * 20_000)
    assert set(tables.read_csv(spark, str(path)).columns) == {ROW, "a,b", "c"}


def test_a_quote_that_is_never_closed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,x\n2,"open\n3,y\n')
    assert [tuple(r)[:2] for r in tables.read_csv(spark, str(path)).orderBy(ROW).collect()] == [(1, "x"), (2, '"open'), (3, "y")]


@pytest.mark.parametrize("separator", ["^", "~", " ", ":", "#"])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_dialects(spark, tmp_path, separator, quote):
    path = tmp_path / "a.csv"
    rows = [["id", "name", "when"]] + [[str(i), f"{quote}left{separator}right, {i}{quote}" if i % 3 else f"n{i}", "2020"] for i in range(50)]
    path.write_text("\n".join(separator.join(r) for r in rows) + "\n")
    assert csv_records.detect(csv_records.file_lines(spark, str(path), "\n")) == csv_records.Dialect(separator, quote)
    same(spark, path, sep=separator, quotechar=quote)


def test_no_dialect(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("word\none\ntwo\n")
    assert csv_records.detect(csv_records.file_lines(spark, str(path), "\n")) is None
    assert [r["word"] for r in tables.read_csv(spark, str(path)).orderBy(ROW).collect()] == ["one", "two"]


@pytest.mark.parametrize("cell", ["1", '"1\n1"'])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_names_that_are_blank_or_repeated(spark, tmp_path, cell, encoding):
    path = tmp_path / "a.csv"
    path.write_text(f",id,Id,id.1,,b c\n{cell},2,3,4,5,6\n0,2,3,4,5,7\n", encoding=encoding)
    table = tables.read_csv(spark, str(path))
    assert table.columns[:6] == ["_c0", "id", "Id.1", "id.1.1", "_c4", "b c"]
    assert [tuple(r)[1:6] for r in table.orderBy(ROW).collect()] == [(2, 3, 4, 5, 6), (2, 3, 4, 5, 7)]
    assert table.select("`Id.1`", "_c4").count() == 2
