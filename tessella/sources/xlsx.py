"""Workbooks as a data source: cells of .xlsx files, read and written with the standard library.

spark.dataSource.register(XlsxCells); spark.read.format("tessella_xlsx").load(path)

A partition is one sheet of one file, since a sheet is one XML stream. The
stream is parsed as it is read, so memory holds a batch of cells, the shared
strings and the styles, not the sheet.
"""

from __future__ import annotations

import datetime
import glob
import io
import math
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ranges import letters, number

NAME = "tessella_xlsx"
SCHEMA = (
    "file string, sheet string, row int, col int, dtype string, py_type string, v_str string, number_format string, "
    "bold boolean, h_align string, fill string, has_border boolean, merged_range string, is_merge_start boolean, sheet_no int"
)
_REF = re.compile(r"([A-Za-z]+)(\d+)")
# Number formats that workbooks name by number only.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


def _tag(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _of(element: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if element is None else [x for x in element if _tag(x) == name]


def _one(element: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_of(element, name)), None)


@dataclass
class Style:
    number_format: str = "General"
    bold: bool = False
    h_align: str | None = None
    fill: str = "none"
    has_border: bool = False


def _on(element: ET.Element | None, name: str) -> bool:
    flag = _one(element, name)
    return flag is not None and flag.get("val", "1") not in ("0", "false")


def _fill(element: ET.Element) -> str:
    """Colour of a solid fill: rgb, else its index, else none."""
    pattern = _one(element, "patternFill")
    if pattern is None or pattern.get("patternType") != "solid":
        return "none"
    for name in ("fgColor", "bgColor"):
        colour = _one(pattern, name)
        if colour is not None and colour.get("rgb"):
            return colour.get("rgb")
    colour = _one(pattern, "fgColor")
    return f"index_{colour.get('indexed')}" if colour is not None and colour.get("indexed") else "none"


def _styles(book: zipfile.ZipFile) -> list[Style]:
    if "xl/styles.xml" not in book.namelist():
        return [Style()]
    root = ET.fromstring(book.read("xl/styles.xml"))
    formats = BUILT_IN | {int(x.get("numFmtId")): x.get("formatCode") for x in _of(_one(root, "numFmts"), "numFmt")}
    fonts = [_on(x, "b") for x in _of(_one(root, "fonts"), "font")]
    fills = [_fill(x) for x in _of(_one(root, "fills"), "fill")]
    borders = [any(side.get("style") for name in ("left", "right", "top", "bottom") for side in _of(x, name)) for x in _of(_one(root, "borders"), "border")]
    at = lambda items, i, other: items[i] if i < len(items) else other
    out = []
    for x in _of(_one(root, "cellXfs"), "xf"):
        align = _one(x, "alignment")
        font, fill, border = (int(x.get(n, 0)) for n in ("fontId", "fillId", "borderId"))
        out.append(Style(formats.get(int(x.get("numFmtId", 0)), "General"), at(fonts, font, False), None if align is None else align.get("horizontal"), at(fills, fill, "none"), at(borders, border, False)))
    return out or [Style()]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, x in ET.iterparse(f):
            if _tag(x) == "si":
                out.append("".join(t.text or "" for t in x.iter() if _tag(t) == "t"))
                x.clear()
    return out


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook, in its order."""
    links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ET.fromstring(book.read("xl/workbook.xml"))
    out = []
    for x in _of(_one(root, "sheets"), "sheet"):
        target = links[next(v for k, v in x.attrib.items() if k.endswith("}id"))]
        out.append((x.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


_DATE = re.compile(r'\[[^\]]*\]|"[^"]*"|\\.|_.')


def _is_date(number_format: str) -> bool:
    return number_format != "General" and any(c in "dmhysDMHYS" for c in _DATE.sub("", number_format))


#: Day 0 of the two date systems of workbooks.
DAY_ZERO = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}


def counts_from_1904(book: zipfile.ZipFile) -> bool:
    settings = _one(ET.fromstring(book.read("xl/workbook.xml")), "workbookPr")
    return settings is not None and settings.get("date1904", "0") in ("1", "true")


def _value(kind: str, text: str | None, strings: list[str], number_format: str, zero: datetime.datetime) -> tuple[str, str, str] | None:
    """dtype, py_type and text of a stored value; the text is what Python's str() makes of it."""
    if text is None:
        return None
    if kind == "s":
        return "s", "str", strings[int(text)]
    if kind in ("str", "inlineStr"):
        return "s", "str", text
    if kind == "b":
        return "b", "bool", "True" if text.strip() in ("1", "true") else "False"
    if kind == "e":
        return "e", "str", text
    x = float(text)
    if _is_date(number_format):
        day = zero + datetime.timedelta(days=x)
        day = (day + datetime.timedelta(microseconds=500)).replace(microsecond=day.microsecond // 1000 * 1000)
        return "d", "datetime", str(day)
    if re.fullmatch(r"-?\d+", text.strip()):
        return "n", "int", str(int(text))
    return "n", "float", str(x)


class _Merged:
    """Merged ranges of a sheet, looked up for cells in row order; a range is kept as its corners, whatever its size."""

    def __init__(self, refs: list[str]) -> None:
        self.waiting = []
        for ref in refs:
            (c0, r0), (c1, r1) = (_REF.match(p).groups() for p in (ref.split(":") * 2)[:2])
            self.waiting.append((int(r0), int(r1), number(c0), number(c1), ref))
        self.waiting.sort(reverse=True)
        self.open: list[tuple] = []
        self.row = 0

    def of(self, row: int, col: int) -> tuple[str | None, bool]:
        """The range that the cell lies in, and whether it is its first cell."""
        if row != self.row:
            self.row = row
            self.open = [x for x in self.open if x[1] >= row]
            while self.waiting and self.waiting[-1][0] <= row:
                self.open.append(self.waiting.pop())
        for r0, r1, c0, c1, ref in self.open:
            if r0 <= row <= r1 and c0 <= col <= c1:
                return ref, (row, col) == (r0, c0)
        return None, False


def cells(data: bytes, file: str, sheet: str, part: str, data_only: bool = True, sheet_no: int = 0) -> Iterator[tuple]:
    """Rows of the cell relation of one sheet."""
    book = zipfile.ZipFile(io.BytesIO(data))
    styles, strings, zero = _styles(book), _strings(book), DAY_ZERO[counts_from_1904(book)]
    refs = []
    with book.open(part) as f:
        for _, x in ET.iterparse(f):  # merged ranges stand after the cells
            if _tag(x) == "mergeCell":
                refs.append(x.get("ref"))
            elif _tag(x) == "row":
                x.clear()
    merged = _Merged(refs)
    row = 0
    with book.open(part) as f:
        for event, x in ET.iterparse(f, events=("start", "end")):
            if _tag(x) == "row" and event == "start":
                row, col = int(x.get("r", row + 1)), 0
            elif _tag(x) == "row":
                x.clear()
            elif _tag(x) == "c" and event == "end":
                m = _REF.match(x.get("r", ""))
                col = number(m[1]) if m else col + 1
                style = styles[min(int(x.get("s", 0)), len(styles) - 1)]
                formula, v, inline = _one(x, "f"), _one(x, "v"), _one(x, "is")
                text = v.text if v is not None else "".join(t.text or "" for t in inline.iter() if _tag(t) == "t") if inline is not None else None
                if formula is not None and not data_only:
                    value = ("f", "str", "=" + (formula.text or ""))
                else:
                    value = _value(x.get("t", "n"), text, strings, style.number_format, zero)
                merge, first = merged.of(row, col)
                if value is not None or style != Style() or merge:
                    dtype, py_type, v_str = value or ("n", None, None)
                    look = (style.number_format, style.bold, style.h_align, style.fill, style.has_border)
                    yield (file, sheet, row, col, dtype, py_type, v_str, *look, merge, first, sheet_no)


def find(path: str) -> list[str]:
    """Workbooks at a path: a file, a folder's .xlsx files, or a pattern."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True))
    found = sorted(glob.glob(path)) or [path]
    for p in found:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
        if not p.lower().endswith(".xlsx"):
            raise ValueError(f"{p}: not an .xlsx file")
    return found


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str, number: int) -> None:
        self.path, self.name, self.part, self.number = path, name, part, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path") or ""
        self.data_only = str(options.get("data_only", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in find(self.path):
            with zipfile.ZipFile(path) as book:
                out += [_Sheet(path, name, part, i) for i, (name, part) in enumerate(sheets(book))]
        return out

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from cells(f.read(), partition.path, partition.name, partition.part, self.data_only, partition.number)


class XlsxCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def cells_of_binary_files(files, data_only: bool = True):  # noqa: ANN001, ANN201
    """Cells of workbooks in any store that Spark reads: files is spark.read.format("binaryFile").load(...)."""

    def read(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    parts = sheets(book)
                for i, (name, part) in enumerate(parts):
                    rows: list = []
                    for cell in cells(content, path, name, part, data_only, i):
                        rows.append(cell)
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, SCHEMA)


# The parts of a workbook that don't depend on its rows.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_SIDES = '<left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/>'
_STYLES = f'<styleSheet xmlns="{_MAIN}"><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/><border>{_SIDES}</border></borders><cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="1"><alignment horizontal="center"/></xf><xf numFmtId="22" fontId="0" fillId="0" borderId="0"/><xf numFmtId="14" fontId="0" fillId="0" borderId="0"/></cellXfs></styleSheet>'
#: Begin and end of the rows of a sheet.
SHEET_HEAD, SHEET_TAIL = f'<worksheet xmlns="{_MAIN}"><sheetData>', "</sheetData>{0}</worksheet>"


def sheet_part(number: int) -> str:
    return f"xl/worksheets/sheet{number}.xml"


def write_frame(book: zipfile.ZipFile, names: list[str]) -> None:
    """All parts of a workbook but its sheets, whose names are given."""
    kinds = {"xl/workbook.xml": "sheet.main", "xl/styles.xml": "styles"} | {sheet_part(i): "worksheet" for i in range(1, len(names) + 1)}
    overrides = "".join(f'<Override PartName="/{part}" ContentType="{_PARTS}.{kind}+xml"/>' for part, kind in kinds.items())
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types">{defaults}{overrides}</Types>')
    links = lambda rows: f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(rows)}</Relationships>'
    link = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{_DOCUMENT}/{kind}" Target="{target}"/>'
    book.writestr("_rels/.rels", links([link(1, "officeDocument", "xl/workbook.xml")]))
    sheets_ = [link(i, "worksheet", sheet_part(i).removeprefix("xl/")) for i in range(1, len(names) + 1)]
    book.writestr("xl/_rels/workbook.xml.rels", links([*sheets_, link(len(names) + 1, "styles", "styles.xml")]))
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(names, 1))
    book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets>{listed}</sheets></workbook>')
    book.writestr("xl/styles.xml", _STYLES)


def cell_xml(v, place: str = "", style: int = 0) -> str:  # noqa: ANN001
    """A cell. Without a place it follows the one before it, so a null or NaN is then an empty cell; with one it is left out.

    Numbers that aren't finite and moments before 1900 are texts, since sheets have no numbers for them.
    """
    at = (f' r="{place}"' if place else "") + (f' s="{style}"' if style else "")
    if v is None or v != v:
        return "" if place else "<c/>"
    if isinstance(v, bool):
        return f'<c{at} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, Decimal)) and (isinstance(v, int) or math.isfinite(v)):
        return f"<c{at}><v>{v:f}</v></c>" if isinstance(v, Decimal) else f"<c{at}><v>{v!r}</v></c>"
    if isinstance(v, datetime.date) and v.year >= 1900:
        moment = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
        days = (moment.replace(tzinfo=None) - DAY_ZERO[False]) / datetime.timedelta(days=1)
        return f'<c{f" r={chr(34)}{place}{chr(34)}" if place else ""} s="{2 if isinstance(v, datetime.datetime) else 3}"><v>{days!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c{at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(path: str, names: list[str], rows: Iterator, sheet: str = "Sheet1", header_style: bool = True, merged: list[str] | None = None) -> None:
    """A workbook with one sheet from rows in order; rows are taken one by one. For a relation take sink.save()."""

    def row_xml(r: int, values: Iterable, style: int = 0) -> bytes:
        return f'<row r="{r}">{"".join(cell_xml(v, f"{letters(c)}{r}", style) for c, v in enumerate(values, 1))}</row>'.encode()

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        write_frame(book, [sheet])
        with book.open(sheet_part(1), "w") as out:
            out.write(SHEET_HEAD.encode() + row_xml(1, names, int(header_style)))
            for r, row in enumerate(rows, 2):
                out.write(row_xml(r, row))
            listed = "".join(f'<mergeCell ref="{m}"/>' for m in merged or [])
            out.write(SHEET_TAIL.format(f"<mergeCells>{listed}</mergeCells>" if listed else "").encode())
