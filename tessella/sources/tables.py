"""Reading CSV and workbooks as tables or cells; writing results."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import CELLS, cells_from_table
from ..operators.tidy import ROW
from . import csv_records, sink, xlsx

# Encodings and separators in the order in which they are tried.
ENCODINGS = ["utf-16", "utf-8", "latin1"]
SEPARATORS = ["\t", ",", ";", "|"]
PROBE = 65_536


def _stored(spark: SparkSession, path: str):  # noqa: ANN202
    """File system and path of a file in any store that the session reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def check_input(path: str, spark: SparkSession | None = None) -> str:
    """The suffix, .csv or .xlsx; errors for others and for missing files. Without a session, local files only."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".csv", ".xlsx"):
        raise ValueError(f"{path}: neither .csv nor .xlsx")
    if spark is None:
        there = os.path.exists(path)
    else:
        store, at = _stored(spark, path)
        there = store.exists(at)
    if not there:
        raise FileNotFoundError(path)
    return suffix


def read_head(spark: SparkSession, path: str, size: int = PROBE) -> tuple[bytes, bool]:
    """The first bytes of a file in any store, and whether they are all of it."""
    store, at = _stored(spark, path)
    stream = store.open(at)
    try:
        head = bytes(stream.readNBytes(size + 1))
    finally:
        stream.close()
    return head[:size], len(head) <= size


def guesses(head: bytes, whole: bool = True) -> Iterator[tuple[str, str]]:
    """Each encoding and separator that read the head as more than one column, with no row wider than the first."""
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding) if whole else head.decode(encoding, "ignore" if encoding == "latin1" else "strict")
        except UnicodeError:
            cut = head[: len(head) - 4] if not whole else b""
            try:
                text = cut.decode(encoding, "strict") if cut else ""
            except UnicodeError:
                continue
        if encoding == "utf-16" and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue  # without a mark almost any bytes read as something
        for separator in SEPARATORS:
            try:
                widths = [len(x) for x in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if x]
            except csv.Error:
                continue
            widths = widths if whole else widths[:-1] or widths
            if widths and widths[0] > 1 and max(widths) <= widths[0]:
                yield encoding, separator


def sniff(head: bytes, whole: bool = True) -> tuple[str, str]:
    """The first of the guesses."""
    return next(guesses(head, whole), ("utf-8", ","))


def _utf16_holds(separator: str | None):  # noqa: ANN202
    """Whether a file's bytes decode and no record is wider than the first."""

    def holds(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                held, first, widest = True, 0, 0
                try:
                    for record in csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding="utf-16", newline=""), delimiter=separator or ","):
                        first, widest = first or len(record), max(widest, len(record))
                except (UnicodeError, csv.Error):
                    held = False
                yield pd.DataFrame({"held": [held and (separator is None or widest <= first)]})

    return holds


def numbered(df: DataFrame, row: str = ROW) -> DataFrame:
    """df with rows numbered from 0 in file order.

    Rows are numbered within each partition, and partitions by their counts:
    no sort and no single task.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.select(part.alias("p")).groupBy("p").count().collect()
    offset, at = {}, 0
    for p, n in sorted((r[0], r[1]) for r in counts):
        offset[p], at = at, at + n
    if not offset:
        return marked.withColumn(row, F.col("_id")).drop("_id")
    table = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv))
    return marked.withColumn(row, (table[part] + local).cast("long")).drop("_id")


def read_csv(spark: SparkSession, path: str, row: str = ROW) -> DataFrame:
    """A CSV as a table with typed columns, its encoding and separator the first ones that hold for the whole file; the head only gives the guesses.

    Where none of the fixed separators holds, the whole file's counts of other
    characters tell one, and the quote. Quoted fields may hold line ends and
    doubled quotes; a file that has such records is read by csv_records, any
    other by Spark's own reader, both in parallel. A UTF-16 file is read by one
    task. A quote that is never closed makes quotes ordinary characters.
    """
    head, whole = read_head(spark, path)
    found = list(guesses(head, whole))
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        content = spark.read.format("binaryFile").load(path).select("content")
        holds = lambda sep: content.mapInPandas(_utf16_holds(sep), "held boolean").first()["held"]
        separator = next((sep for encoding, sep in found if encoding == "utf-16" and holds(sep)), None)
        if separator or holds(None):
            return numbered(_plain(spark, path, sep=separator or ",", encoding="UTF-16", multiLine=True, escape='"'), row)
    end = "\n" if b"\n" in head or b"\r" not in head else None
    lines = csv_records.file_lines(spark, path, end)
    dialect, at = _dialect(lines, dict.fromkeys(sep for encoding, sep in found if encoding != "utf-16"))
    name = "UTF-8" if at.valid else "ISO-8859-1"
    if not at.crossing:
        return numbered(_plain(spark, path, encoding=name, **csv_records.options(dialect)), row)
    records = csv_records.records(lines, dialect, at).select("row", F.decode("record", name).alias("record"))
    names = _names(csv_records.fields(records.where("row = 0").first()["record"], dialect))
    data = records.where("row > 0")
    # Spark infers the types, from a first record that has every column and says nothing of them.
    blank = spark.sparkContext.parallelize([dialect.separator.join([2 * dialect.quote] * len(names))], 1)
    kinds = spark.read.options(**csv_records.options(dialect), multiLine=True).csv(blank.union(data.select("record").rdd.map(lambda r: r[0])), inferSchema=True).dtypes
    parsed = csv_records.parsed(F.col("record"), ", ".join(f"_{i} {kind}" for i, (_, kind) in enumerate(kinds)), dialect)
    table = data.select((F.col("row") - 1).alias("_row"), parsed.alias("_p"))
    return table.select(*(F.col(f"_p._{i}") for i in range(len(names))), "_row").toDF(*names, row)


def _plain(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A CSV by Spark's own reader, with names by _names()."""
    table = spark.read.csv(path, header=True, inferSchema=True, **options)
    header = spark.read.csv(path, schema=", ".join(f"_{i} string" for i in range(len(table.columns))), **options).first()
    return table.toDF(*_names(header or ()))


def _dialect(lines: DataFrame, separators: Iterable[str]) -> tuple[csv_records.Dialect, csv_records.Layout]:
    """The first dialect that holds for all records, and the file's layout by it."""

    def tried(dialect: csv_records.Dialect) -> tuple[csv_records.Dialect, csv_records.Layout] | None:
        at = csv_records.layout(lines, dialect)
        return (dialect, at) if at.closed and at.widest <= max(at.width, 1) else None

    for separator in separators:
        if held := tried(csv_records.Dialect(separator)):
            return held
    own = csv_records.detect(lines)
    plain = csv_records.Dialect(own.separator if own else ",", "")
    return (own and tried(own)) or tried(csv_records.Dialect(plain.separator)) or (plain, csv_records.layout(lines, plain))


def _names(header: Iterable[str | None], nameless: str = "_c") -> list[str]:
    """Column names: those without a name get their place, repeated ones (in either case, as Spark compares them) a number that is free."""
    taken: set[str] = set()
    out = []
    for i, given in enumerate(header):
        name = base = given or f"{nameless}{i}"
        k = 0
        while name.lower() in taken:
            k += 1
            name = f"{base}.{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_cells(spark: SparkSession, path: str, data_only: bool = True) -> DataFrame:
    """Cells of a workbook, of a folder of workbooks, or of a CSV with its header as row 1.

    Local workbooks are read sheet by sheet in parallel; those in another store file by file.
    """
    folder = not path.lower().endswith((".csv", ".xlsx")) and _is_folder(spark, path)
    if not folder and check_input(path, spark) == ".csv":
        table = read_csv(spark, path)
        return cells_from_table(table.withColumn(ROW, F.col(ROW) + 1), ROW, file=path)
    local = "://" not in path or path.startswith("file://")
    if local:
        spark.dataSource.register(xlsx.XlsxCells)
        return spark.read.format(xlsx.NAME).option("data_only", data_only).schema(CELLS).load(path)
    files = spark.read.format("binaryFile")
    if folder:
        files = files.option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true")
    return xlsx.cells_of_binary_files(files.load(path), data_only)


def _is_folder(spark: SparkSession, path: str) -> bool:
    store, at = _stored(spark, path)
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def table_from_cells(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """The first (or named) sheet as a table: row 1 gives the names, other rows are numbered from 0; texts and numbers by column."""
    if sheet is not None:
        cells = cells.where(F.col("sheet") == sheet)
    head = {r["col"]: r["v_str"] for r in cells.where("row = 1").select("col", "v_str").collect()}
    widest = cells.where("v_str is not null").agg(F.max("col")).first()[0] or 0
    names = _names((head.get(c) for c in range(1, widest + 1)), "Unnamed: ")
    kinds = {
        r["col"]: r
        for r in cells.where("row > 1 and v_str is not null").groupBy("col").agg(F.bool_and(F.col("py_type") == "int").alias("i"), F.bool_and(F.col("py_type").isin("int", "float")).alias("f"), F.bool_and(F.col("py_type") == "bool").alias("b"), F.bool_and(F.col("py_type") == "datetime").alias("d")).collect()
    }
    last = cells.where("v_str is not null").agg(F.max("row")).first()[0] or 1
    wide = cells.where("row > 1").groupBy("row").agg(*(F.max(F.when(F.col("col") == c, F.col("v_str"))).alias(f"_{c}") for c in range(1, widest + 1)))

    def kind(c: int) -> str:
        r = kinds.get(c)
        return "string" if r is None else "bigint" if r["i"] else "double" if r["f"] else "boolean" if r["b"] else "timestamp_ntz" if r["d"] else "string"

    # Rows without cells are rows of the table as well.
    wide = cells.sparkSession.range(2, last + 1).select(F.col("id").cast("int").alias("row")).join(wide, "row", "left")
    return wide.select((F.col("row") - 2).cast("long").alias(ROW), *(F.col(f"_{c}").try_cast(kind(c)).alias(names[c - 1]) for c in range(1, widest + 1)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, or the first sheet of a workbook, as a table with numbered rows."""
    if check_input(path, spark) == ".csv":
        return read_csv(spark, path)
    cells = read_cells(spark, path)
    return table_from_cells(cells.where("sheet_no = 0"))


def write_json(path: str, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_csv(df: DataFrame, folder: str, encoding: str = "UTF-8") -> None:
    """Part files with headers, in parallel."""
    df.write.mode("overwrite").csv(folder, header=True, encoding=encoding)


def save(df: DataFrame, path: str, kind: str = "csv", encoding: str = "utf-8") -> str:
    """One file for people, .csv or .xlsx, in the order of rows; tasks write its parts and the commit joins them.

    A .xlsx path with kind csv gets CSV text, in the given encoding. For many files take write_csv().
    """
    ordered = df.orderBy(ROW).drop(ROW) if ROW in df.columns else df
    target = path
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        target = os.path.abspath(path)
    workbook = kind == "xlsx" and path.lower().endswith(".xlsx")
    sink.save(ordered, target, "xlsx" if workbook else "csv", "utf-8-sig" if kind == "csv-bom" else encoding)
    return path
