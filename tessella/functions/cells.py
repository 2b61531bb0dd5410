"""Typing of cells as column expressions; all of it stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\n?$"
CURRENCY_SIGNS = ["$", "€", "£", "¥"]
DATE_KEYS = ["yyyy", "yy", "mmmm", "mmm", "mm", "dddd", "ddd", "dd", "d"]
TIME_KEYS = ["hh", "h", "ss", "s", "am/pm", "a/p"]
INTEGER_FORMATS = ["0", "#,##0"]
FLOAT_FORMATS = ["0.00", "#,##0.00", "0.0", "#,##0.0"]
LONGEST_VALUE = 200

#: What Python's str.strip() takes away, for cells and texts that come from there.
STRIPPED = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0  -     　"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | text.rlike(f"^[{STRIPPED}]*$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{STRIPPED}]+|[{STRIPPED}]+$", "")


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def cell_type(value: Column, py_type: Column, dtype: Column) -> Column:
    """Physical type from the value's text, its Python type and the workbook's type code."""
    formula = F.when(py_type == "str", "text").when(py_type.isin("int", "float", "bool"), "numeric").otherwise("formula_cached_value")
    return (
        F.when(value.isNull(), "empty")
        .when((py_type == "str") & is_email(value), "email")
        .when(dtype == "s", "text")
        .when(dtype == "n", "numeric")
        .when(dtype == "b", "boolean")
        .when(dtype == "d", "datetime")
        .when(dtype == "e", "error")
        .when(dtype == "f", formula)
        .when(dtype == "g", "text")
        .otherwise("unknown")
    )


def number_format(raw: Column) -> Column:
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit("General"))


def format_category(nf: Column, kind: Column, strict: bool = False) -> Column:
    """Category of a number format for a physical type.

    As it is by default, single letters count as keywords anywhere in the
    format, and a locale tag such as [$-409] as a currency sign; strict drops
    bracketed and quoted parts and backslash escapes first, and takes m for a
    date only outside h:mm and mm:ss.
    """
    if strict:
        nf = F.regexp_replace(nf, r'\[[^\]]*\]|"[^"]*"|\\.|_.', "")
    low = F.lower(nf)
    date_text = F.regexp_replace(low, r"h+:m+|m+:s+", "h:s") if strict else low
    is_date, is_time = _any([date_text.contains(k) for k in DATE_KEYS]), _any([low.contains(k) for k in TIME_KEYS]) | nf.contains(":")
    return (
        F.when(~kind.isin("numeric", "datetime"), "not_applicable")
        .when(low == "general", F.when(kind == "datetime", "datetime_general").otherwise("general"))
        .when((nf == "@") | (low == "text"), "text_format")
        .when(_any([nf.contains(c) for c in CURRENCY_SIGNS]), "currency")
        .when(nf.contains("%"), "percentage")
        .when(low.contains("e+") | low.contains("e-"), "scientific")
        .when(low.contains("#") & low.contains("/") & low.contains("?"), "fraction")
        .when(is_date & is_time, "datetime_custom")
        .when(is_date, "date_custom")
        .when(is_time, "time_custom")
        .when((kind == "numeric") & nf.isin(INTEGER_FORMATS), "integer")
        .when((kind == "numeric") & nf.isin(FLOAT_FORMATS), "float")
        .when(kind == "numeric", "other_numeric")
        .otherwise("other_date")
    )


def semantic_type(kind: Column, category: Column, nf: Column, py_type: Column) -> Column:
    low = F.lower(nf)
    year_only = low.contains("yy") & ~low.contains("m") & ~low.contains("d")
    return (
        F.when(kind == "email", "email")
        .when(category == "percentage", "percentage")
        .when(category == "currency", "currency")
        .when(category.isin("date_custom", "datetime_custom", "datetime_general", "other_date"), F.when(year_only, "year").otherwise("date"))
        .when(category == "time_custom", "time")
        .when(category == "scientific", "scientific_notation")
        .when((kind == "numeric") & (py_type.isin("int", "bool") | (category == "integer")), "integer")
        .when((kind == "numeric") & ((py_type == "float") | (category == "float")), "float")
        .otherwise(kind)
    )


def column_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to XFD and the rest of three letters."""
    n = n.cast("int")
    letter = lambda x: F.char((x % 26 + 65).cast("int"))
    one, two, three = letter(n - 1), letter(F.floor((n - 27) / 26)), letter(F.floor((n - 703) / 676))
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, letter(F.floor((n - 703) / 26)), one))


def column_number(letters: Column) -> Column:
    """A -> 1, XFD -> 16384."""
    return F.aggregate(F.split(F.upper(letters), "(?!^)(?!$)"), F.lit(0), lambda a, c: (a * 26 + F.ascii(c) - 64).cast("int"))


def cell_ref(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def split_ref(ref: Column) -> Column:
    """struct(letters, row); row 0 where the reference has no digits."""
    digits = F.regexp_extract(ref, r"(\d+)", 1)
    return F.struct(F.regexp_replace(ref, r"[^A-Za-z]", "").alias("letters"), F.when(digits == "", 0).otherwise(digits.cast("int")).alias("row"))


def shorten(value: Column, longest: int = LONGEST_VALUE) -> Column:
    """The text of a value, cut with an ellipsis; '' for null."""
    return F.when(value.isNull(), "").when(F.length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("…"))).otherwise(value)


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def json_quoted_size(text: Column) -> Column:
    """Characters of the text as a JSON string, quotes included, other characters than controls, quotes and backslashes as they are."""
    short = F.length(F.regexp_replace(text, r'[^"\\\x08\x09\x0A\x0C\x0D]', ""))
    long = F.length(F.regexp_replace(text, r"[^\x00-\x07\x0B\x0E-\x1F]", ""))
    return (F.length(text) + short + 5 * long + 2).cast("long")


def json_object_size(entries: Column, total: Column) -> Column:
    """Characters of an object of so many entries, whose keys and values take total characters, with ', ' and ': ' between."""
    return F.when(entries == 0, F.lit(2)).otherwise(2 + 2 * (entries - 1) + 2 * entries + total).cast("long")


def similar(a: str, b: str) -> Column:
    """Whether two cells (structs of these names) look alike: equal fill, and at most one of weight, border, Python type and format differs."""
    f = lambda x, n: F.col(f"{x}.{n}")
    apart = reduce(lambda p, q: p + q, [(~f(a, n).eqNullSafe(f(b, n))).cast("int") for n in ("bold", "has_border", "py_type", "number_format")])
    return f(a, "fill").eqNullSafe(f(b, "fill")) & (apart <= 1)


def spread_sample(start: Column, end: Column, n: int) -> Column:
    """At most n indices spread evenly over start..end, both included, in order; the arithmetic is in doubles."""
    total = end - start + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(start + i * (total.cast("double") / F.lit(float(n)))).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= n, F.sequence(start, end).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(spread)))


def same_value(found: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """Equal, both null, or as numbers closer than the tolerance."""
    x, y = (c.cast("string").try_cast("double") for c in (found, expected))
    return found.cast("string").eqNullSafe(expected.cast("string")) | F.coalesce(F.abs(x - y) < tolerance, F.lit(False))
