"""The cell relation, and how tables become cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row for each non-empty or formatted cell. Rows and columns count from 1, sheets of a workbook (sheet_no) from 0.
CELLS = (
    "file string, sheet string, row int, col int, dtype string, py_type string, v_str string, number_format string, "
    "bold boolean, h_align string, fill string, has_border boolean, merged_range string, is_merge_start boolean, sheet_no int"
)
SHEET = ["file", "sheet"]
_PY = {"boolean": ("b", "bool"), "tinyint": ("n", "int"), "smallint": ("n", "int"), "int": ("n", "int"), "bigint": ("n", "int"), "float": ("n", "float"), "double": ("n", "float")}


def _kind(dtype: str) -> tuple[str, str]:
    if dtype.startswith("decimal"):
        return "n", "float"
    if dtype.startswith(("timestamp", "date")):
        return "d", "datetime"
    return _PY.get(dtype, ("s", "str"))


def cells_from_table(df: DataFrame, row: str, file: str = "", sheet: str = "Sheet1", header: bool = True, header_style: bool = False) -> DataFrame:
    """Cells of a table whose column row numbers its rows from 1; the header is sheet row 1.

    One projection and one explode, no shuffle. header_style gives header cells
    the bold face and border that spreadsheet writers give them.
    """
    shift = 1 if header else 0
    columns = [c for c in df.columns if c != row]
    kinds = dict(df.dtypes)
    body = F.explode(F.array(*(
        F.struct(F.lit(i).alias("col"), F.lit(_kind(kinds[c])[0]).alias("dtype"), F.lit(_kind(kinds[c])[1]).alias("py_type"), F.col(f"`{c}`").cast("string").alias("v_str"))
        for i, c in enumerate(columns, 1)
    )))
    plain = [F.lit("General").alias("number_format"), F.lit(False).alias("bold"), F.lit(None).cast("string").alias("h_align"), F.lit("none").alias("fill"), F.lit(False).alias("has_border")]
    merge = [F.lit(None).cast("string").alias("merged_range"), F.lit(False).alias("is_merge_start"), F.lit(0).alias("sheet_no")]
    where = [F.lit(file).alias("file"), F.lit(sheet).alias("sheet")]
    cells = df.select((F.col(f"`{row}`") + shift).cast("int").alias("row"), body.alias("c")).select(*where, "row", "c.*", *plain, *merge).where("v_str is not null")
    if not header:
        return cells
    names = df.sparkSession.createDataFrame([(1, i, c) for i, c in enumerate(columns, 1)], "row int, col int, v_str string")
    styled = [F.lit("General").alias("number_format"), F.lit(header_style).alias("bold"), F.lit("center" if header_style else None).cast("string").alias("h_align"), F.lit("none").alias("fill"), F.lit(header_style).alias("has_border")]
    top = names.select(*where, "row", "col", F.lit("s").alias("dtype"), F.lit("str").alias("py_type"), "v_str", *styled, *merge)
    return top.unionByName(cells)


def extents(cells: DataFrame) -> DataFrame:
    """max_row and max_col of each sheet; sheets of one cell or none are left out."""
    return cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col")).where("max_row > 1 or max_col > 1")
