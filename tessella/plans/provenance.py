"""Samples for validation: cells of the source, and the row of the result that each must give.

What a cell becomes is told by the analysis (which columns identify a row, which are values
of a variable, where markers stand), not by the plan: each part of a row is traced by itself,
so a plan that takes values from the wrong columns gives rows that no sample matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import tidy
from ..operators.tidy import ROW
from .analysis import Analysis
from .plan import snake

#: Source rows that are traced, and values of a variable of each.
ROWS, VALUES = 3, 2


def _plain(body: DataFrame) -> DataFrame:
    """Numbers as they are (decimals as doubles), everything else as text."""
    own = lambda c, t: F.col(f"`{c}`") if t in P.NUMERIC and not t.startswith("decimal") else F.col(f"`{c}`").cast("double" if t.startswith("decimal") else "string")
    return body.select(*(own(c, t).alias(c) for c, t in body.dtypes))


def _details(analysis: Analysis, body: DataFrame) -> DataFrame:
    """Rows of the region that a result keeps: no markers, totals or rows with a part missing."""
    names = [c for c in body.columns if c != ROW]
    kinds = dict(body.dtypes)
    rows = body
    texts = [c for c in analysis.id_columns if kinds.get(c) == "string"]
    if analysis.marker_column is not None:
        rows = rows.where(~tidy.is_marker_row(body, analysis.marker_column))
    if texts:
        rows = rows.where(~tidy.is_total_row(texts))
    if analysis.detail_column is not None and tidy.filter_needed("exclude", analysis.summary_values):
        rows = rows.where(~F.coalesce(F.col(f"`{analysis.detail_column}`").isin(analysis.summary_values), F.lit(False)))
    values = [c for columns in analysis.value_groups.values() for c in columns.values()] or [c for c in names if kinds[c] in P.NUMERIC]
    some = [F.col(f"`{c}`").isNotNull() for c in values]
    return rows.where(reduce(lambda a, b: a | b, some)) if some else rows


def _markers(analysis: Analysis, body: DataFrame, at: list[int]) -> dict[int, str | None]:
    """The text of the last marker above each row; one pass."""
    own = F.when(tidy.is_marker_row(body, analysis.marker_column), F.struct(ROW, F.col(f"`{analysis.marker_column}`").cast("string").alias("v")))
    found = body.agg(*(F.max(F.when(F.col(ROW) < r, own)) for r in at)).first()
    return {r: x and x["v"] for r, x in zip(at, found)}


def _traced(analysis: Analysis, row: dict, second: dict | None, marker: str | None, renamed: dict[str, str], value: str | None) -> dict:
    """The result's row for one source row (and the one that pairs with it) and one value of the variable."""
    out: dict = {}
    groups = {snake(g): columns for g, columns in analysis.value_groups.items()}
    label = analysis.pair_label if second is not None else None
    for c, name in renamed.items():
        if c == "section" and analysis.marker_column is not None:
            out[name] = marker
        elif label is not None and c in (f"{label}_first", f"{label}_second"):
            out[name] = (row if c.endswith("_first") else second)[label]
        elif label is not None and c.endswith("_second") and c.removesuffix("_second") in row:
            out[name] = second[c.removesuffix("_second")]
        elif value is not None and c == "variable":
            out[name] = value
        elif value is not None and c in groups:
            out[name] = row[groups[c][value]] if value in groups[c] else None
        elif analysis.detail_column is not None and c in (f"{analysis.detail_column}_base", f"{analysis.detail_column}_detail"):
            base, found, extra = str(row[analysis.detail_column]).partition(analysis.detail_delimiter)
            out[name] = base if c.endswith("_base") else extra if found else None
        elif c in row:
            out[name] = analysis.spellings.get(c, {}).get(row[c], row[c])
    return out


def samples(body: DataFrame, analysis: Analysis, renamed: dict[str, str], rows: int = ROWS, values: int = VALUES) -> list[dict]:
    """[{description, expected_row}] for some rows of the region, chosen by a hash of their numbers.

    body: the region with its names and types; renamed: the result's name of each
    column that the steps make or keep.
    """
    pairs = analysis.pair_label is not None and analysis.marker_column is None
    plain = _plain(body)
    found = _details(analysis, plain)
    if pairs:
        found = found.where(F.pmod(F.col(ROW) - analysis.start, F.lit(2)) == 0)
    own = found.orderBy(F.xxhash64(ROW), ROW).limit(rows).collect()
    if not own:
        return []
    at = [r[ROW] for r in own]
    seconds = {r[ROW]: r for r in plain.where(F.col(ROW).isin([i + 1 for i in at])).collect()} if pairs else {}
    markers = _markers(analysis, plain, at) if analysis.marker_column is not None else {}
    every = list(dict.fromkeys(v for columns in analysis.value_groups.values() for v in columns)) if analysis.value_groups and not pairs else [None]
    out = []
    for k, r in enumerate(own):
        if pairs and r[ROW] + 1 not in seconds:
            continue
        # Rows begin at different values, so that all of them have their turn.
        for j in range(min(values, len(every))):
            v = every[(k * values + j) % len(every)]
            expected = _traced(analysis, r.asDict(), seconds[r[ROW] + 1].asDict() if pairs else None, markers.get(r[ROW]), renamed, v)
            out.append({"description": f"row {r[ROW]}" + (f", {v}" if v is not None else ""), "expected_row": expected})
    return out
