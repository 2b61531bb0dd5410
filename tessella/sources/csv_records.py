"""Records of a CSV file whose quoted fields may hold line ends, read in parallel.

Where a line stands, inside a quoted field or not, depends on all lines before it. Every
split of the file is walked for both answers and reports what each leads to: the state at
its end, how many records begin in it, and how wide they are. A prefix over these few
numbers tells each split its true state and its first row number; a second walk then gives
whole records. Only pieces of records that cross from one split into the next, at most two
from each split, are brought together.

A quote opens a field only where the field begins; inside, two quotes are one. What follows
a closing quote belongs to the field up to the separator. Lines without anything outside
quotes are no records.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"


class Dialect(NamedTuple):
    separator: str = ","
    quote: str = '"'  # empty: none


class Layout(NamedTuple):
    """A file as its splits and a dialect have it: where each split begins, and the widths that decide whether the dialect holds."""

    inside: list[bool]
    first_row: list[int]
    rows: int
    width: int
    widest: int
    crossing: bool  # some record has a line end within
    closed: bool  # no quote is left open at the end
    valid: bool  # all bytes are UTF-8


def walk(line: bytes, inside: bool, separator: bytes, quote: bytes) -> tuple[bool, int]:
    """Whether a line ends inside quotes, and the separators that it has outside of them."""
    if not quote or quote not in line:
        return inside, 0 if inside else line.count(separator)
    at, n = 0, 0
    while True:
        if not inside:
            if line.startswith(quote, at):
                at += len(quote)
            else:
                found = line.find(separator, at)
                if found < 0:
                    return False, n
                at, n = found + len(separator), n + 1
                continue
        while True:
            found = line.find(quote, at)
            if found < 0:
                return True, n
            at = found + len(quote)
            if not line.startswith(quote, at):
                break
            at += len(quote)
        inside = False
        found = line.find(separator, at)
        if found < 0:
            return False, n
        at, n = found + len(separator), n + 1


def file_lines(spark: SparkSession, path: str, line_end: str | None) -> DataFrame:
    """(split, line): the file's lines as bytes, in its order within and across partitions; line_end None: any of the three."""
    text = spark.read.text(path, lineSep=line_end) if line_end else spark.read.text(path)
    return text.select(F.spark_partition_id().alias("split"), F.col("value").cast("binary").alias("line"))


_SIDES = "split int, begins_inside boolean, inside boolean, begun long, head long, ended boolean, widest long, tail long, crossing boolean, valid boolean"


def layout(lines: DataFrame, dialect: Dialect) -> Layout:
    """Walks every split both ways and joins the answers from split to split."""
    separator, quote = dialect.separator.encode(), dialect.quote.encode()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid, crossing = True, {False: False, True: False}
        states = {False: (False, 0, 0, False, 0, 0), True: (True, 0, 0, False, 0, 0)}
        split = None
        for batch in batches:
            held = batch.column("line").to_pylist()
            if held and split is None:
                split = batch.column("split")[0].as_py()
                held[0] = held[0] if split else held[0].removeprefix(BOM)
            valid = valid and all(map(_is_utf8, held))
            for begins in states:
                states[begins], over = _extend(states[begins], held, begins, separator, quote)
                crossing[begins] |= over
        if split is None:
            return
        rows = [(split, begins, *states[begins], crossing[begins], valid) for begins in states]
        names = [x.split()[0] for x in _SIDES.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_sides_schema())

    found: dict = {}
    for r in lines.mapInArrow(sides, _SIDES).collect():
        found[r["split"], r["begins_inside"]] = r
    inside, open_width, rows, widest, crossing, valid = False, 0, 0, 0, False, True
    begins, first = [], []
    n = 1 + max((s for s, _ in found), default=-1)
    for split in range(n):
        begins.append(inside)
        first.append(rows)
        r = found.get((split, inside))
        if r is None:
            continue
        if inside:
            open_width += r["head"]
            if r["ended"]:
                widest, open_width = max(widest, open_width), 0
        rows, widest = rows + r["begun"], max(widest, r["widest"])
        if r["inside"] and (r["ended"] or not inside):
            open_width = r["tail"]
        crossing, valid, inside = crossing or r["crossing"] or inside, valid and r["valid"], r["inside"]
    out = Layout(begins, first, rows, 0, max(widest, open_width) + 1, crossing, not inside, valid)
    if not rows:
        return out
    header = records(lines, dialect, out).where("row = 0").first()
    return out._replace(width=len(fields(bytes(header["record"]).decode("latin1"), dialect)))


def _sides_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _SIDES.split(", ")])


def _is_utf8(line: bytes) -> bool:
    if line.isascii():
        return True
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _extend(state: tuple, lines: list[bytes], begins_inside: bool, separator: bytes, quote: bytes) -> tuple[tuple, bool]:
    """The state of a side after more lines, and whether one of them ended inside quotes."""
    inside, begun, head, ended, widest, now = state
    crossing = False
    for line in lines:
        if not inside and not line.strip():
            continue
        begun += not inside
        inside, n = walk(line, inside, separator, quote)
        crossing |= inside
        if begins_inside and not ended:
            head += n
        else:
            now += n
        if not inside:
            if not begins_inside or ended:
                widest = max(widest, now)
            ended, now = True, 0
    return (inside, begun, head, ended, widest, now), crossing


def records(lines: DataFrame, dialect: Dialect, at: Layout) -> DataFrame:
    """(row, record): every record as bytes, without its line end, numbered from 0 in the file's order; row 0 is the header."""
    separator, quote = dialect.separator.encode(), dialect.quote.encode()
    begins, first = at.inside, at.first_row
    schema = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("record", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, row, own, piece = None, False, 0, [], False
        for batch in batches:
            rows, held = [], batch.column("line").to_pylist()
            if held and split is None:
                split = batch.column("split")[0].as_py()
                held[0] = held[0] if split else held[0].removeprefix(BOM)
                # A record that began in an earlier split is a piece of the row before this split's first.
                inside, row, piece = begins[split], first[split], begins[split]
            for line in held:
                if not inside and not line.strip():
                    continue
                inside, _ = walk(line, inside, separator, quote)
                own.append(line)
                if not inside:
                    rows.append((row - 1 if piece else row, split if piece else -1, b"\n".join(own).removesuffix(b"\r")))
                    row, own, piece = row + (not piece), [], False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([row - 1 if piece else row]), pa.array([split], pa.int32()), pa.array([b"\n".join(own)], pa.binary())], schema=schema)

    found = lines.mapInArrow(gather, "row bigint, piece int, record binary")
    if not any(begins):
        return found.select("row", F.col("record"))
    # Latin-1 maps every byte to a character and back.
    text = F.decode("record", "ISO-8859-1")
    parts = found.where("piece >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", text.alias("text")))).alias("p"))
    joined = parts.select("row", F.encode(F.array_join("p.text", "\n"), "ISO-8859-1").alias("record"))
    return found.where("piece < 0").select("row", "record").unionByName(joined)


def fields(record: str, dialect: Dialect) -> list[str]:
    """The values of one record."""
    import csv
    import io

    quoting = {"quotechar": dialect.quote} if dialect.quote else {"quoting": csv.QUOTE_NONE}
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=dialect.separator, **quoting), [])


def parsed(record: Column, schema: str, dialect: Dialect) -> Column:
    """The record's fields as a struct."""
    return F.from_csv(record, schema, options(dialect) | {"multiLine": "true"})


def options(dialect: Dialect) -> dict[str, str]:
    """What Spark's parser is told of a dialect; no quote is the character zero."""
    quote = dialect.quote or "\x00"
    return {"sep": dialect.separator, "quote": quote, "escape": quote, "maxCharsPerColumn": "-1"}


#: Characters that may separate fields, in order of preference where all else is equal.
CANDIDATES = "\t,;|^~:" + "".join(c for c in string.punctuation if c not in ",;|^~:\"'_.-") + " -._"
#: Share of the lines that must have the most frequent count of a separator.
CONSISTENT = 0.9


def tally(lines: list[str]) -> Counter:
    """How many lines have each count of each candidate, outside of quotes of either kind: (quote, character, count) -> lines; and which quotes enclose whole fields: (quote, character, -1) -> fields."""
    import re

    found: Counter = Counter()
    enclosed = {q: re.compile(rf"(?:^|(?<=[{re.escape(CANDIDATES)}])){q}(?:[^{q}]|{q}{q})*{q}(?=$|[{re.escape(CANDIDATES)}])") for q in "\"'"}
    for line in lines:
        if not line.strip():
            continue
        for q, pattern in enclosed.items():
            outside, n = pattern.subn("", line)
            for m in pattern.finditer(line):
                for c in {line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]} - {""}:
                    found[q, c, -1] += 1
            seen = Counter(outside)
            for c in CANDIDATES:
                found[q, c, seen.get(c, 0)] += 1
    return found


def decide(counts: Counter) -> Dialect | None:
    """The quote that encloses more fields, and the candidate of which most lines have the same number, if nearly all have."""
    enclosing = {q: max((n for (p, _, k), n in counts.items() if p == q and k == -1), default=0) for q in "\"'"}
    quote = "'" if enclosing["'"] > enclosing['"'] else '"'
    best = None
    for rank, c in enumerate(CANDIDATES):
        by_count = {k: n for (q, x, k), n in counts.items() if q == quote and x == c and k >= 0}
        total = sum(by_count.values())
        n, times = max(((n, k) for k, n in by_count.items() if k > 0), default=(0, 0))
        if total and n >= CONSISTENT * total:
            own = (n / total, counts[quote, c, -1] > 0, -rank)
            if best is None or own > best[0]:
                best = (own, Dialect(c, quote))
    return best[1] if best else None


def detect(lines: DataFrame) -> Dialect | None:
    """The dialect of a whole file of UTF-8 or Latin-1 lines, by tables of counts that each batch makes and Spark sums; None if no separator is consistent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tally([x.decode("latin1").rstrip("\r") for x in batch.column("line").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([q for q, _, _ in own], [c for _, c, _ in own], [k for _, _, k in own], list(own.values()))], ["q", "c", "k", "n"])

    # As many rows as there are candidates and counts; a count beyond 1000 is taken as that.
    sums = lines.mapInArrow(count, "q string, c string, k bigint, n bigint").groupBy("q", "c", F.least("k", F.lit(1000)).alias("k")).agg(F.sum("n").alias("n"))
    return decide(Counter({(r["q"], r["c"], r["k"]): r["n"] for r in sums.collect()}))
