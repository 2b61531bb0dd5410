"""Reshaping operators that make a messy table long and tidy.

Tables carry the number of each row in a column (ROW), counted from 0 like the
rows below a header; order never comes from anything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C

ROW = "__row"

# Fixed values that results depend on.
TOTAL_LABELS = ["total", "grand total", "sub-total", "subtotal", "合計", "小計"]
AGGREGATE_NAMES = ["total", "sum", "grand total", "合計"]
FOOTER = r"^(Source:|Note:|※|\* )"
SUMMARY_DELIMITERS = [" - ", " / ", " : ", " > "]
NO_FILTER_PHRASES = ["none", "none specifically", "no rows", "keep all", "preserve all", "no filtering", "not applicable", "n/a", "all rows are valid", "no exclusion"]
SUMMARY_WORDS = ["total", "sum", "subtotal", "aggregate", "all", "合計", "小計", "總計", "总计", "小计", "合计"]


def slice_region(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start..end, both included."""
    return df.where(F.col(ROW).between(start, end))


def promote_header(df: DataFrame, rows: list[int], separator: str = "_", fill: bool = True) -> DataFrame:
    """Column names from these rows, which then go. Levels are joined; an empty upper level takes what stands left of it.

    Only the header rows are collected. Nameless columns become column_i, and
    repeated names get a number.
    """
    names = [c for c in df.columns if c != ROW]
    levels = {r[ROW]: [None if r[c] is None or not str(r[c]).strip() else str(r[c]).strip() for c in names] for r in df.where(F.col(ROW).isin(rows)).collect()}
    order = [levels[r] for r in sorted(rows) if r in levels]
    if fill:
        for level in order[:-1]:
            for i in range(1, len(level)):
                level[i] = level[i] if level[i] is not None else level[i - 1]
    found, seen = [], {}
    for i in range(len(names)):
        parts = [level[i] for level in order if level[i] is not None]
        name = separator.join(dict.fromkeys(parts)) or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        found.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    body = df.where(~F.col(ROW).isin(rows))
    return body.select(ROW, *(F.col(f"`{c}`").alias(n) for c, n in zip(names, found)))


def first_footer_row(df: DataFrame, column: str) -> DataFrame:
    """One row: the first row that begins like a source or a note; null if there is none."""
    return df.where(F.col(f"`{column}`").rlike(FOOTER)).agg(F.min(ROW).alias("first_footer"))


def drop_footer(df: DataFrame, column: str) -> DataFrame:
    """Rows before the first footer row."""
    first = first_footer_row(df, column).first()[0]
    return df if first is None else df.where(F.col(ROW) < first)


def unpivot(df: DataFrame, ids: list[str], groups: dict[str, dict[str, str]], variable: str) -> DataFrame:
    """Columns to rows. groups: name of a value column -> {variable's value: source column}.

    Several groups stay columns of their own, side by side for each value of the
    variable; a value that a group lacks is null there. One pass, no join.
    """
    values = list(dict.fromkeys(v for columns in groups.values() for v in columns))
    kinds = dict(df.dtypes)

    def common_type(columns: dict[str, str]) -> str:
        found = {kinds[c] for c in columns.values()}
        return found.pop() if len(found) == 1 else "double" if all(t in ("int", "bigint", "smallint", "tinyint", "float", "double") for t in found) else "string"

    types = {g: common_type(columns) for g, columns in groups.items()}
    rows = [F.struct(F.lit(v).alias(variable), *((F.col(f"`{columns[v]}`") if v in columns else F.lit(None)).cast(types[g]).alias(g) for g, columns in groups.items())) for v in values]
    keep = [F.col(f"`{c}`") for c in ([ROW] if ROW in df.columns and ROW not in ids else []) + ids]
    return df.select(*keep, F.inline(F.array(*rows)))


def is_aggregate_name(name: str) -> bool:
    return name.strip().lower() in AGGREGATE_NAMES


def drop_aggregate_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Without these columns; without those named like totals if none are given."""
    return df.drop(*(names if names is not None else [c for c in df.columns if is_aggregate_name(c)]))


def is_total_row(columns: list[str], labels: list[str] = TOTAL_LABELS) -> Column:
    """Whether a row has a total's label in any of these columns."""
    low = [x.lower() for x in labels]
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin(low), F.lit(False)) for c in columns])


def drop_total_rows(df: DataFrame, columns: list[str], labels: list[str] = TOTAL_LABELS) -> DataFrame:
    """Without rows that have a total's label in any of these columns; Other and Unknown are rows like any."""
    return df.where(~is_total_row(columns, labels))


def _filled(df: DataFrame, c: str) -> Column:
    text = F.col(f"`{c}`").cast("string")
    return (~C.is_blank(text)).cast("int")


def is_marker_row(df: DataFrame, column: str) -> Column:
    """Exactly one cell has something, and it stands in this column."""
    names = [c for c in df.columns if c != ROW]
    total = reduce(lambda a, b: a + b, [_filled(df, c) for c in names])
    return (total == 1) & (_filled(df, column) == 1)


#: Rows of one stretch of a table that is filled by itself.
STRETCH = 1 << 16


def fill_section_markers(df: DataFrame, column: str, into: str, group: list[str] | None = None) -> DataFrame:
    """Marker rows go; the marker of each other row, the last one above it, is in column into.

    With group (a file, a sheet) sequences are independent, else the table is
    one. Stretches of STRETCH rows are filled by themselves; the last marker
    before a stretch is carried over from a table with one row a stretch, so no
    task gets more rows than that of a sequence.
    """
    keys = group or []
    marked = df.withColumn("_m", F.when(is_marker_row(df.drop(*keys), column), F.col(f"`{column}`"))).withColumn("_s", F.floor(F.col(ROW) / STRETCH))
    last = marked.groupBy(*keys, "_s").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col(ROW))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_t"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_s") == F.col("_t"))
    order = Window.partitionBy(*keys, "_s").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.join(carried, same).withColumn(into, F.coalesce(F.last("_m", ignorenulls=True).over(order), "_before"))
    return filled.where("_m is null").drop("_m", "_s", "_t", "_before", *(f"_k{i}" for i in range(len(keys))))


def merge_bilingual_pairs(df: DataFrame, label: str, values: list[str], start: int = 0, same_data: bool = True, second_names: dict[str, str] | None = None) -> DataFrame:
    """Each two rows from start become one: label_first and label_second, and the values.

    same_data: both rows hold the same values, and the first row's (else the
    second's) stay. Otherwise the second row's values go to columns of their own,
    named by second_names. Grouped by pair, so pairs never have to be adjacent
    in a partition.
    """
    first = F.pmod(F.col(ROW) - start, F.lit(2)) == 0
    of = lambda c, which: F.max(F.when(which, F.col(f"`{c}`")))
    others = [c for c in df.columns if c not in (ROW, label, *values)]
    out = [of(label, first).alias(f"{label}_first"), of(label, ~first).alias(f"{label}_second"), *(F.coalesce(of(c, first), of(c, ~first)).alias(c) for c in others)]
    for c in values:
        if same_data:
            out.append(F.coalesce(of(c, first), of(c, ~first)).alias(c))
        else:
            out += [of(c, first).alias(c), of(c, ~first).alias((second_names or {}).get(c, f"{c}_second"))]
    pair = F.floor((F.col(ROW) - start) / 2).cast("long")
    return df.where(F.col(ROW) >= start).groupBy(pair.alias("pair_id")).agg(*out)


def implicit_aggregation(df: DataFrame, column: str, delimiters: list[str] = SUMMARY_DELIMITERS) -> DataFrame:
    """summary, delimiter and detail: values that stand for the sum of others, which they begin.

    Distinct values only; the prefix before each delimiter is looked up by an
    equi-join, not compared with every other value.
    """
    distinct = df.select(F.col(f"`{column}`").cast("string").alias("detail")).where("detail is not null").distinct()
    each = F.explode(F.array(*map(F.lit, delimiters)))
    parts = distinct.select("detail", each.alias("delimiter")).where(F.contains(F.col("detail"), F.col("delimiter")))
    # A detail may have the delimiter several times: every prefix that ends before one is tried.
    pieces = F.split("detail", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    prefixes = parts.withColumn("p", pieces).select("detail", "delimiter", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p")
    prefixes = prefixes.select("detail", "delimiter", F.array_join(F.slice("p", F.lit(1), F.col("n")), "\0").alias("s"))
    prefixes = prefixes.withColumn("summary", F.expr("replace(s, chr(0), delimiter)")).drop("s")
    return prefixes.join(distinct.withColumnRenamed("detail", "summary"), "summary").select("summary", "delimiter", "detail")


def split_dimension(df: DataFrame, column: str, delimiter: str, base: str, extra: str) -> DataFrame:
    """All rows; what stands before and after the first delimiter, and null after it where there is none."""
    text, n = F.col(f"`{column}`").cast("string"), len(delimiter)
    at = F.locate(delimiter, text)
    out = df.withColumn("_b", F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)).withColumn("_e", F.when(at > 0, F.substring(text, at + n, F.length(text))))
    return out.drop(column).withColumnsRenamed({"_b": base, "_e": extra})


def filter_needed(guidance: str | None, summary_values: list[str]) -> bool:
    """Whether rows are to be excluded: not by empty guidance or a phrase for none; else if a summary value names a total.

    Phrases and words are looked for as parts of words, as they stand.
    """
    text = (guidance or "").strip().lower()
    if not text or any(p in text for p in NO_FILTER_PHRASES):
        return False
    return any(w in str(v).lower() for v in summary_values for w in SUMMARY_WORDS)


def exclude_summary_rows(df: DataFrame, column: str, summary_values: list[str], guidance: str | None = "exclude") -> DataFrame:
    if not filter_needed(guidance, summary_values):
        return df
    return df.where(~F.coalesce(F.col(f"`{column}`").isin(summary_values), F.lit(False)))


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """string, integer or float for each named column; what doesn't read as such becomes null. Thousands commas and blanks are dropped."""

    def cast(c: str, t: str) -> Column:
        text = F.trim(F.col(f"`{c}`").cast("string"))
        number = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")
        if t == "string":
            return F.col(f"`{c}`").cast("string")
        if t == "integer":
            return F.coalesce(number.try_cast("bigint"), F.when(number.try_cast("double") == F.floor(number.try_cast("double")), number.try_cast("double").cast("bigint")))
        if t == "float":
            return number.try_cast("double")
        raise ValueError(f"{t!r} is not string, integer or float")

    return df.select(*(cast(c, types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def select_rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns under their new names, in this order."""
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in columns.items()))


def map_values(df: DataFrame, column: str, mapping: dict, into: str | None = None) -> DataFrame:
    """Values replaced by a dictionary's; others stay."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
    value = F.col(f"`{column}`") if table is None else F.coalesce(table[F.col(f"`{column}`")], F.col(f"`{column}`"))
    return df.withColumn(into or column, value)
