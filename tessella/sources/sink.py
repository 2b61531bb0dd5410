"""One .csv or .xlsx file from a relation of any number of partitions, as a data source that is written to.

spark.dataSource.register(OneFile); or save(df, path)

Every task writes its rows, in blocks, to one part file in the folder that the
cluster shares, for a workbook as compressed XML. Only the sizes of the blocks go to the commit, which
strings the parts together byte by byte: compressed stretches that end on a byte
can be joined as they are, and the checksum of a whole follows from those of its
stretches. So nothing is compressed or formatted twice, no rows pass through the
driver, and memory holds one block. The file appears by a move when it is whole;
parts of failed or repeated tasks are in no message and go with the folder.

Sheets hold a bounded number of rows: a block that doesn't fit opens the next
sheet, which repeats the names. Rows and cells of blocks carry no numbers, since
their place in the file gives them.

Defined results: an empty table gives the names alone. Nulls and NaN are empty
cells. Names may repeat. A table wider than a sheet is an error before any task
starts; so is a file that is there already, unless mode is overwrite.
"""

from __future__ import annotations

import csv
import io
import json
import shutil
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.scratch import new_path
from . import xlsx

NAME = "tessella_one_file"
# The most rows and columns of a sheet, and the polynomial of the archive's checksum, lowest power first.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384
POLYNOMIAL = 0xEDB88320
BLOCK_ROWS = 8_192


@dataclass
class Stretch:
    """A stretch of a file: its rows, its bytes as stored and as they are, and the checksum of these."""

    rows: int
    stored: int
    size: int
    crc: int


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    blocks: list[Stretch]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's; the highest bit is the power 0."""
    out = 0
    for bit in range(32):
        out = out >> 1 ^ (POLYNOMIAL if out & 1 else 0)
        if a >> bit & 1:
            out ^= b
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """Checksum of two stretches, the second of the given size, from theirs."""
    shift, power = 1 << 31, 1 << 23  # 1, and the power 8: one byte
    while size:
        if size & 1:
            shift = _times(shift, power)
        power, size = _times(power, power), size >> 1
    return _times(shift, first) ^ second


def _squeezed(data: bytes, rows: int, last: bool = False) -> tuple[bytes, Stretch]:
    """A stretch of a compressed stream, ending on a byte."""
    squeeze = zlib.compressobj(wbits=-15)
    out = squeeze.compress(data) + squeeze.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
    return out, Stretch(rows, len(out), len(data), zlib.crc32(data))


def _blocks(rows: Iterator, most: int) -> Iterator[list]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def _store(path: str):  # noqa: ANN202
    """File system and path, in any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


class _Csv:
    def __init__(self, names: list[str], encoding: str) -> None:
        self.names, self.encoding = names, encoding
        self.mark = "".encode(encoding)  # a byte order mark stands at the file's head only

    def lines(self, rows: list) -> bytes:
        out = io.StringIO()
        csv.writer(out).writerows(rows)
        return out.getvalue().encode(self.encoding)[len(self.mark) :]

    def block(self, rows: list) -> tuple[bytes, Stretch]:
        data = self.lines(rows)
        return data, Stretch(len(rows), len(data), len(data), 0)

    def join(self, out, parts: list[Part], opened) -> None:  # noqa: ANN001
        out.write(self.mark + self.lines([self.names]))
        for part in parts:
            if part.blocks:
                with opened(part.path) as f:
                    shutil.copyfileobj(f, out)


class _Workbook:
    def __init__(self, names: list[str], sheet_rows: int) -> None:
        if len(names) > SHEET_COLUMNS:
            raise ValueError(f"{len(names)} columns; a sheet has {SHEET_COLUMNS}")
        self.names, self.sheet_rows = names, sheet_rows

    def block(self, rows: list) -> tuple[bytes, Stretch]:
        return _squeezed("".join(f"<row>{''.join(map(xlsx.cell_xml, row))}</row>" for row in rows).encode(), len(rows))

    def sheets(self, parts: list[Part]) -> list[list[tuple[Part, Stretch]]]:
        """Blocks of each sheet, in order."""
        out, held = [[]], 1
        for part in parts:
            for block in part.blocks:
                if held + block.rows > self.sheet_rows and out[-1]:
                    out.append([])
                    held = 1
                out[-1].append((part, block))
                held += block.rows
        return out

    def join(self, out, parts: list[Part], opened) -> None:  # noqa: ANN001
        sheets = self.sheets(parts)
        head = _squeezed(f"{xlsx.SHEET_HEAD}<row>{''.join(xlsx.cell_xml(x, style=1) for x in self.names)}</row>".encode(), 1)
        tail = _squeezed(xlsx.SHEET_TAIL.format("").encode(), 0, last=True)
        # A part may end one sheet and begin the next: it stays open, and is read on.
        at, source = None, None
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            xlsx.write_frame(book, [f"Sheet{i}" for i in range(1, len(sheets) + 1)])
            for i, blocks in enumerate(sheets, 1):
                info = zipfile.ZipInfo(xlsx.sheet_part(i))
                info.compress_type = zipfile.ZIP_DEFLATED
                info.header_offset = book.fp.tell()
                for x in [head[1], *(b for _, b in blocks), tail[1]]:
                    info.CRC = joined_crc(getattr(info, "CRC", 0), x.crc, x.size)
                    info.compress_size += x.stored
                    info.file_size += x.size
                book.fp.write(info.FileHeader())
                book.fp.write(head[0])
                for part, block in blocks:
                    if part is not at:
                        if source:
                            source.close()
                        at, source = part, opened(part.path)
                    book.fp.write(source.read(block.stored))
                book.fp.write(tail[0])
                book.filelist.append(info)
                book.NameToInfo[info.filename] = info
                book.start_dir = book.fp.tell()
            if source:
                source.close()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, width: int, overwrite: bool) -> None:
        self.path = options["path"]
        names = json.loads(options.get("names") or "null") or [f"_c{i}" for i in range(width)]
        self.workbook = options.get("kind", "csv") == "xlsx"
        # A block is one sheet at most.
        sheet_rows = int(options.get("sheet_rows", SHEET_ROWS))
        self.most = min(BLOCK_ROWS, sheet_rows - 1) if self.workbook else BLOCK_ROWS
        self.form = _Workbook(names, sheet_rows) if self.workbook else _Csv(names, options.get("encoding", "utf-8"))
        own = uuid.uuid4().hex
        self.parts, self.whole = options.get("parts") or f"{self.path}.parts-{own}", f"{self.path}.{own}"
        from pyarrow import fs

        store, at = _store(self.path)
        if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, folder = _store(self.parts)
        path = f"{folder}/{number}-{uuid.uuid4().hex}"
        store.create_dir(folder)
        stretches = []
        with store.open_output_stream(path) as out:
            for rows in _blocks(iterator, self.most):
                data, stretch = self.form.block(rows)
                out.write(data)
                stretches.append(stretch)
        return Part(number, path, stretches)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        store, whole = _store(self.whole)
        with store.open_output_stream(whole) as out:
            self.form.join(out, parts, _store(self.parts)[0].open_input_stream)
        store.move(whole, _store(self.path)[1])
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        for path in (self.parts, self.whole):
            store, at = _store(path)
            kind = store.get_file_info(at).type
            if kind == fs.FileType.Directory:
                store.delete_dir(at)
            elif kind == fs.FileType.File:
                store.delete_file(at)


class OneFile(DataSource):
    """Options: path; kind (csv or xlsx); names (a JSON list, for names that repeat); encoding (of a CSV);
    sheet_rows (the most rows of a sheet); parts (a folder that all tasks see; else one beside the path)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise NotImplementedError("this source is only written to")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        options = dict(self.options)
        options.setdefault("names", json.dumps(schema.names))
        return _Writer(options, len(schema), overwrite)


def save(df: DataFrame, path: str, kind: str = "csv", encoding: str = "utf-8", **options: object) -> None:
    """df as one file, its partitions in order."""
    df.sparkSession.dataSource.register(OneFile)
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    plain.write.format(NAME).mode("overwrite").options(kind=kind, encoding=encoding, names=json.dumps(df.columns), parts=new_path(df.sparkSession, "parts"), **options).save(path)
