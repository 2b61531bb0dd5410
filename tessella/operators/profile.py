"""Column profiles: counts, distinct values, statistics, types, delimiters, languages.

All columns of a table are profiled together: one pass for counts and moments, and
one aggregation of (column, value) pairs for everything that is about distinct
values. Values of all columns meet as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import dates
from .scratch import materialize

# Fixed values that results depend on.
NA_WORDS = ["n/a", "na", "not applicable", "不適用", "不适用", "none", "null", ""]
BOOLEAN_SETS = [
    ["yes", "no"], ["y", "n"], ["true", "false"], ["t", "f"], ["1", "0"], ["是", "否"], ["有", "沒有", "无"], ["有", "没有"],
]
DELIMITERS = {
    " - ": "space-dash-space", "-": "dash", " / ": "space-slash-space", "/": "slash", " | ": "space-pipe-space", "|": "pipe",
    ":": "colon", ";": "semicolon", ",": "comma", "(": "open-paren", ")": "close-paren",
}

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
INTEGER = ("tinyint", "smallint", "int", "bigint")


def sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows with the smallest hashes (MD5) of their key, the same ones however the rows are dealt; all rows of a smaller table.

    Every partition keeps its n smallest, and those are merged, so n bounds what
    any task gathers.
    """
    return df.orderBy(F.md5(F.col(f"`{key}`").cast("string").cast("binary")), F.col(f"`{key}`")).limit(n)


def unpivoted(df: DataFrame, row: str | None = None) -> DataFrame:
    """(column, ordinal, value as text, row) of every cell of a table."""
    names = [c for c in df.columns if c != row]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names))))
    at = (F.col(f"`{row}`").cast("long") if row else F.lit(None).cast("long")).alias("row")
    return df.select(at, each.alias("c")).select("c.column", "c.ordinal", "c.value", "row")


def nulls(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null and null_pct of every column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_null")) for i, c in enumerate(df.columns))))
    pct = F.when(F.col("_n") > 0, F.col("c.n_null") * 100.0 / F.col("_n"))
    return one.select("_n", each.alias("c")).select("c.column", F.col("_n").alias("n_rows"), "c.n_null", pct.alias("null_pct"))


#: Part of all ranks on either side of the middle that a bracket leaves; distinct values that a column's bracket may hold in the end.
NEAR, MOST_NEAR = 0.001, 100_000


def _brackets(df: DataFrame, names: list[str], most: int) -> list[tuple]:
    """(ordinal, column, n, low, high): the two middle values lie in low..high, which holds most distinct values or fewer."""
    accuracy = int(4 / NEAR)
    own = [F.col(f"`{c}`").cast("double") for c in names]
    # The sketch's error is a quarter of NEAR, so ranks between its two answers hold both middle ones, but for few rows, where it is exact.
    first = df.agg(*(x for c in own for x in (F.count(c), F.percentile_approx(c, [0.5 - NEAR, 0.5 + NEAR], accuracy)))).first()
    found = {i: (first[2 * i], *first[2 * i + 1]) for i in range(len(names)) if first[2 * i]}
    # Brackets of fewer values would leave out one of the middle ones.
    most = max(most, int(10 / NEAR))
    wide = [i for i, (n, low, high) in found.items() if low < high and 3 * NEAR * n > most]
    rows = {i: found[i][0] for i in wide}
    while wide:
        inside = {i: own[i].between(found[i][1], found[i][2]) for i in wide}
        counts = df.agg(*(x for i in wide for x in (F.count_if(own[i] < found[i][1]), F.count_if(inside[i]), F.approx_count_distinct(F.when(inside[i], own[i]))))).first()
        counts = {i: counts[3 * k : 3 * k + 3] for k, i in enumerate(wide)}
        # Two heavy values on either side of the middle are as close as it gets.
        wide = [i for i in wide if counts[i][2] > most and 2 * counts[i][1] <= rows[i]]
        if not wide:
            break
        rows |= {i: counts[i][1] for i in wide}
        middle = {i: (found[i][0] / 2 - counts[i][0]) / counts[i][1] for i in wide}
        around = lambda i: [min(1.0, max(0.0, middle[i] + x)) for x in (-NEAR, NEAR)]  # noqa: B023, E731
        closer = df.agg(*(F.percentile_approx(F.when(inside[i], own[i]), around(i), accuracy) for i in wide)).first()
        for k, i in enumerate(wide):
            found[i] = (found[i][0], *closer[k])
        wide = [i for i in wide if found[i][1] < found[i][2]]
    return [(i, names[i], *x) for i, x in found.items()]


def medians(df: DataFrame, names: list[str], most: int = MOST_NEAR) -> DataFrame:
    """column and exact median of numeric columns; the mean of the two middle values of an even number.

    A pass finds, with a sketch of fixed size, values surely below and above the
    middle. While more than most distinct values may lie between, what lies below
    is counted and the bracket is narrowed in the same way, to a five-hundredth
    each time. A last pass counts the values of the bracket, and only they are
    put in order. No task sees a whole column, and none more values than most.
    """
    bounds = df.sparkSession.createDataFrame(_brackets(df, names, most), "ordinal int, column string, n bigint, low double, high double")
    own = [F.col(f"`{c}`").cast("double") for c in names]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), x.alias("value")) for i, x in enumerate(own))))
    held = df.select(each.alias("c")).select("c.*").where("value is not null").join(F.broadcast(bounds), "ordinal")
    held = held.withColumn("value", F.greatest("value", "low")).where("value <= high").groupBy("ordinal", "column", "n", "value").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("ordinal").orderBy("value"))
    at = [F.floor((F.col("n") + x) / 2) for x in (1, 2)]
    middle = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    return held.withColumn("upto", upto).groupBy("column").agg(((middle(at[0]) + middle(at[1])) / 2).alias("median"))


def statistics(df: DataFrame) -> DataFrame:
    """column, min, max, mean, median and population std of numeric columns; the median is exact."""
    names = [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, mean double, median double, std double")
    functions = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    one = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"_{i}_{n}") for i, c in enumerate(names) for n, f in functions.items()))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"_{i}_{n}").alias(n) for n in functions)) for i, c in enumerate(names))))
    found = one.select(each.alias("c")).select("c.*").join(medians(df, names), "column", "left")
    return found.select("column", "min", "max", "mean", "median", "std")


def value_counts(df: DataFrame, row: str | None = None) -> DataFrame:
    """column, value, n and the first row of every distinct value; pre-aggregated before its one shuffle."""
    return unpivoted(df, row).where("value is not null").groupBy("column", "ordinal", "value").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


def top_values(counts: DataFrame, k: int = 50, max_distinct: int = 100) -> DataFrame:
    """The k most frequent values of columns with at most max_distinct values; earlier values first among equals."""
    few = counts.groupBy("column").agg(F.count("*").alias("n_distinct")).where(F.col("n_distinct") <= max_distinct)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first_row", "value")
    return counts.join(few, "column").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unique_values(counts: DataFrame, limit: int = 100) -> DataFrame:
    """The first values of each column in order of appearance, and whether there are more."""
    order = Window.partitionBy("column").orderBy("first_row", "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    return ranked.groupBy("column").agg(
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "value"))), 1, limit), lambda x: x["value"]).alias("values"), (F.max("rank") > limit).alias("truncated")
    )


def boolean_kind(words: Column, has_na: Column) -> Column:
    """boolean, boolean_with_na or null for the lower-cased, stripped distinct values without NA words."""
    subset = reduce(lambda a, b: a | b, [F.size(F.array_except(words, F.array(*map(F.lit, s)))) == 0 for s in BOOLEAN_SETS])
    known = F.array(*(F.lit(w) for w in sorted({w for s in BOOLEAN_SETS for w in s})))
    return (
        F.when((F.size(words) >= 2) & subset, F.when(has_na, "boolean_with_na").otherwise("boolean"))
        .when((F.size(words) == 1) & has_na & F.array_contains(known, F.get(words, F.lit(0))), "boolean_with_na")
    )


def column_type(dtype: Column, n: Column, n_distinct: Column, low: Column, high: Column, few: Column, dates: Column) -> Column:
    """Type of a column from its profile.

    dtype: numeric, integer or other. few: its distinct values, where there are
    ten at most. dates: share of the first non-null values that read as dates.
    """
    words = F.array_distinct(F.transform(few, lambda v: F.lower(C.strip(v))))
    na = F.array(*map(F.lit, NA_WORDS))
    boolean = boolean_kind(F.array_except(words, na), F.arrays_overlap(words, na))
    share = F.when(n > 0, n_distinct / n).otherwise(0.0)
    return (
        F.when((dtype == "integer") & low.between(1900, 2100) & high.between(1900, 2100), "year")
        .when(dtype == "integer", "integer")
        .when(dtype == "numeric", "numeric")
        .when(n_distinct <= 10, F.coalesce(boolean, F.lit("categorical")))
        .when(share > 0.95, "identifier")
        .when((share < 0.5) & (n_distinct <= 50), "categorical")
        .when(dates > 0.7, "date")
        .otherwise("string")
    )


def reads_as_date(value: Column) -> Column:
    """Whether a text reads as a date, with or without a time, in any of the orders and spellings of functions.dates."""
    return dates.is_date(value)


def delimiters(samples: DataFrame) -> DataFrame:
    """column, delimiter, name, ordinal, frequency, share, is_consistent, num_parts and sample_split: delimiters in at least half of a column's samples.

    samples: column, rank, value; the first 20 count, and columns with fewer
    than 3 have none. num_parts is null where the samples that have the
    delimiter have different numbers of parts, sample_split is of the first
    sample, null where it has none. The candidates are a fixed list of eleven.
    """
    first = samples.where("rank <= 20 and value is not null")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("delimiter"), F.lit(name).alias("name")) for i, (d, name) in enumerate(DELIMITERS.items()))))
    held = first.select("column", "rank", "value", each.alias("d")).select("column", "rank", "value", "d.*")
    parts = F.split("value", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    has = F.contains(F.col("value"), F.col("delimiter"))
    found = held.groupBy("column", "ordinal", "delimiter", "name").agg(
        F.count("*").alias("n"),
        F.count_if(has).alias("frequency"),
        F.min(F.when(has, F.size(parts))).alias("least"),
        F.max(F.when(has, F.size(parts))).alias("most"),
        F.min_by(F.when(has, parts), "rank").alias("sample_split"),
    )
    alike = F.col("least") == F.col("most")
    return found.where("n >= 3 and frequency * 2 >= n").select(
        "column", "delimiter", "name", "ordinal", "frequency", (F.col("frequency") / F.col("n")).alias("share"), alike.alias("is_consistent"), F.when(alike, F.col("least")).alias("num_parts"), "sample_split"
    )


def bilingual(samples: DataFrame) -> DataFrame:
    """column and whether any of its first ten samples has both CJK and Latin letters."""
    both = C.has_cjk(F.col("value")) & C.has_latin(F.col("value"))
    return samples.where("rank <= 10").groupBy("column").agg(F.bool_or(F.coalesce(both, F.lit(False))).alias("is_bilingual"))


def multi_language_columns(df: DataFrame) -> list[str]:
    """Columns whose names have both CJK and Latin letters."""
    return [c for c in df.columns if any("一" <= x <= "鿿" for x in c) and any(x.isascii() and x.isalpha() for x in c)]


#: Rows at a table's head in which first_values() looks for where each column's values end.
HEAD = 1024


def first_values(df: DataFrame, row: str, limit: int, head: int = HEAD) -> DataFrame:
    """column, rank, value: the first non-null values of each column by row.

    Of the first rows only it is told which values are there, and so up to which
    row a column's values are needed: no more of it is read in order. Columns
    that have too few values there, mostly empty ones, are ranked as a whole.
    """
    names = [c for c in df.columns if c != row]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string")
    at = F.col(f"`{row}`")
    there = df.select(at.alias("row"), F.array(*(F.col(f"`{c}`").isNotNull() for c in names)).alias("there")).orderBy("row").limit(head).collect()
    last: dict[str, int] = {}
    for i, name in enumerate(names):
        rows = [r["row"] for r in there if r["there"][i]][:limit]
        if len(rows) == limit and rows[-1] is not None:
            last[name] = rows[-1]
    pick = lambda some: [at, *(F.col(f"`{c}`") for c in some)]
    whole = [c for c in names if c not in last]
    parts = [unpivoted(df.select(*pick(whole)), row)] if whole else []
    if last:
        parts.append(unpivoted(df.where(at.isNull() | (at <= max(last.values()))).select(*pick(last)), row))
    order = Window.partitionBy("column").orderBy("row")
    values = reduce(DataFrame.unionByName, parts).where("value is not null")
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("column", "rank", "value")


def profile(df: DataFrame, row: str, max_unique: int = 100) -> DataFrame:
    """One row for each column: counts, type, values, statistics, delimiters, languages."""
    table = df.drop(row)
    kinds = df.sparkSession.createDataFrame(
        [(i, c, t, "integer" if t in INTEGER else "numeric" if t in NUMERIC or t.startswith("decimal") or t == "boolean" else "other") for i, (c, t) in enumerate(table.dtypes)],
        "ordinal int, column string, dtype string, family string",
    )
    counts = materialize(value_counts(df, row), "counts")
    samples = materialize(first_values(df, row, 20), "samples")
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    few = unique_values(counts, max_unique)
    shares = samples.where("rank <= 10").groupBy("column").agg(F.avg(reads_as_date(F.col("value")).cast("double")).alias("date_share"))
    top = top_values(counts, max_distinct=max_unique).groupBy("column").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"], x["n"]))).alias("value_counts"))
    fields = ["delimiter", "name", "frequency", "is_consistent", "num_parts", "sample_split"]
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "ordinal", *fields)))
    marks = delimiters(samples).groupBy("column").agg(F.transform(ordered, lambda x: F.struct((-x["s"]).alias("share"), *(x[f].alias(f) for f in fields))).alias("delimiters"))
    out = kinds
    for part in (nulls(table), distinct, statistics(table), few, shares, top, marks, bilingual(samples)):
        out = out.join(part, "column", "left")
    values = F.coalesce("values", F.array().cast("array<string>"))
    n_distinct = F.coalesce("n_distinct", F.lit(0))
    kind = column_type(F.col("family"), F.col("n_rows"), n_distinct, F.col("min"), F.col("max"), F.when(n_distinct <= 10, values).otherwise(F.array().cast("array<string>")), F.coalesce("date_share", F.lit(0.0)))
    kind = F.when(F.col("dtype").startswith("timestamp") | F.col("dtype").startswith("date"), F.when(n_distinct <= 10, kind).when((F.col("n_rows") > 0) & (n_distinct / F.col("n_rows") > 0.95), "identifier").otherwise("date")).otherwise(kind)
    return out.select(
        "ordinal", "column", "dtype", "n_rows", "n_null", "null_pct", n_distinct.alias("n_distinct"), kind.alias("column_type"), values.alias("values"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"), "value_counts", "min", "max", "mean", "median", "std",
        F.when(kind == "string", F.col("delimiters")).alias("delimiters"), F.coalesce("is_bilingual", F.lit(False)).alias("is_bilingual"),
    )
