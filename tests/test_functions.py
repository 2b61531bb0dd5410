"""Pure rules of cells and ranges, by table and against brute force."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import cells as C
from tessella.functions import ranges as R

cells = st.sets(st.tuples(st.integers(1, 8), st.integers(1, 8)), max_size=40)


@given(cells)
@settings(max_examples=200, deadline=None)
def test_cover_is_an_exact_partition(some):
    seen = [(y, x) for r0, c0, r1, c1 in R.cover(some) for y in range(r0, r1 + 1) for x in range(c0, c1 + 1)]
    assert sorted(seen) == sorted(some)


def test_cover_takes_width_first():
    assert [R.a1(*x) for x in R.cover([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)])] == ["A1:B2", "C2"]


def _slow_rectangles(order, max_row, max_col, side=20):
    free, out = set(order), []
    for r, c in order:
        if (r, c) not in free:
            continue
        best = (1, 1, 1)
        for w in range(1, min(side, max_col - c + 1) + 1):
            for h in range(1, min(side, max_row - r + 1) + 1):
                if w * h > best[0] and all((y, x) in free for y in range(r, r + h) for x in range(c, c + w)):
                    best = (w * h, w, h)
        free -= {(y, x) for y in range(r, r + best[2]) for x in range(c, c + best[1])}
        out.append((r, c, r + best[2] - 1, c + best[1] - 1))
    return out


@given(cells, st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_largest_rectangles_against_all_rectangles(some, side):
    order = sorted(some)
    random.Random(1).shuffle(order)
    assert R.largest_rectangles(order, 8, 8, side) == _slow_rectangles(order, 8, 8, side)


@pytest.mark.parametrize(("n", "name"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (728, "AAZ"), (729, "ABA"), (16384, "XFD")])
def test_letters(n, name):
    assert R.letters(n) == name and R.number(name) == n


def test_column_letters_on_spark(spark):
    rows = spark.range(1, 16385).select(F.col("id").alias("n"), C.column_letters(F.col("id")).alias("a")).withColumn("back", C.column_number(F.col("a"))).collect()
    assert all(r["a"] == R.letters(r["n"]) and r["back"] == r["n"] for r in rows)


#: value, py_type, dtype, format -> kind, category, semantic
TYPING = [
    (None, None, "n", "General", "empty", "not_applicable", "empty"),
    ("a.b@c.org", "str", "s", "General", "email", "not_applicable", "email"),
    ("a.b@c.org\n", "str", "s", "General", "email", "not_applicable", "email"),
    ("x", "str", "s", "General", "text", "not_applicable", "text"),
    ("7", "int", "n", None, "numeric", "general", "integer"),
    ("7.5", "float", "n", "", "numeric", "general", "float"),
    ("7.5", "float", "n", "0", "numeric", "integer", "integer"),
    ("7", "int", "n", "0%", "numeric", "percentage", "percentage"),
    ("7", "int", "n", "[$-409]d-mmm-yy", "numeric", "currency", "currency"),
    ("7", "float", "n", "#,##0;[Red]#,##0", "numeric", "date_custom", "date"),
    ("7", "float", "n", "0.00E+00", "numeric", "scientific", "scientific_notation"),
    ("7", "float", "n", "# ?/?", "numeric", "fraction", "float"),
    ("7", "float", "n", "h:mm", "numeric", "datetime_custom", "date"),
    ("7", "float", "n", "h:00", "numeric", "time_custom", "time"),
    ("2020", "datetime", "d", "yyyy", "datetime", "date_custom", "year"),
    ("2020", "datetime", "d", "General", "datetime", "datetime_general", "date"),
    ("True", "bool", "b", "General", "boolean", "not_applicable", "boolean"),
    ("#N/A", "str", "e", "General", "error", "not_applicable", "error"),
    ("3", "int", "f", "General", "numeric", "general", "integer"),
    ("t", "time", "f", "General", "formula_cached_value", "not_applicable", "formula_cached_value"),
    ("t", "str", "q", "General", "unknown", "not_applicable", "unknown"),
]


def test_typing_table(spark):
    df = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(TYPING)], "i int, v string, p string, d string, f string")
    nf, kind = C.number_format(F.col("f")), C.cell_type(F.col("v"), F.col("p"), F.col("d"))
    df = df.withColumn("nf", nf).withColumn("kind", kind).withColumn("cat", C.format_category(F.col("nf"), F.col("kind")))
    found = [(r["kind"], r["cat"], r["sem"]) for r in df.withColumn("sem", C.semantic_type(F.col("kind"), F.col("cat"), F.col("nf"), F.col("p"))).orderBy("i").collect()]
    assert found == [x[4:] for x in TYPING]


def test_strict_categories(spark):
    df = spark.createDataFrame([("[$-409]d-mmm-yy", "datetime"), ("#,##0;[Red]#,##0", "numeric"), ("h:mm", "datetime")], "nf string, k string")
    assert [r[0] for r in df.select(C.format_category(F.col("nf"), F.col("k"), True)).collect()] == ["date_custom", "other_numeric", "time_custom"]


def test_json_sizes(spark):
    texts = ["", "a", 'q"q', "back\\slash", "line\nbreak\t", "\x01\x1f", "類別", "\U0001f600"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", C.json_quoted_size(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len(json.dumps(r["t"], ensure_ascii=False)) for r in rows)


def test_spread_sample(spark):
    totals = [1, 29, 30, 31, 130, 138, 246, 1000]
    rows = spark.createDataFrame([(3, 2 + t) for t in totals], "a int, b int").select("a", "b", C.spread_sample(F.col("a"), F.col("b"), 30).alias("s")).collect()
    for r in rows:
        total = r["b"] - r["a"] + 1
        assert r["s"] == (list(range(r["a"], r["b"] + 1)) if total <= 30 else sorted({int(r["a"] + i * (total / 30)) for i in range(30)}))


def test_same_value(spark):
    df = spark.createDataFrame([("1", "1.004"), ("1", "1.02"), (None, None), (None, "1"), ("a", "a"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(C.same_value(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, False]


def test_shorten_and_refs(spark):
    df = spark.createDataFrame([("x" * 201,), ("x" * 200,), (None,)], "t string").select(C.shorten(F.col("t")).alias("t"))
    assert [r[0] for r in df.collect()] == ["x" * 200 + "…", "x" * 200, ""]
    r = spark.sql("select 'AB12' a, 'Q' b").select(C.split_ref(F.col("a")), C.split_ref(F.col("b"))).first()
    assert tuple(r[0]) == ("AB", 12) and tuple(r[1]) == ("Q", 0)


@pytest.mark.parametrize("side", [2, 3, 20])
def test_swept_rectangles_are_the_largest_ones(side):
    """Ranks of any mixture, gaps between rows, several keys: as if all cells of a key were at hand."""
    rng = random.Random(side)
    for n in range(60):
        ranks = rng.choice([1, 2, 5, 40])
        grids = {key: {(r, c): rng.randrange(ranks) for r in range(1, rng.choice([5, 60])) for c in range(1, 9) if rng.random() < rng.choice([0.7, 1]) and (r % 11 or n % 2)} for key in "ab"}
        rows = [(key, r, cols, [g[r, c] for c in cols]) for key, g in grids.items() for r in sorted({r for r, _ in g}) if (cols := sorted(c for y, c in g if y == r))]
        found = sorted(R.swept_rectangles(rows, side))
        want = []
        for key, g in grids.items():
            order = sorted(g, key=lambda x: (g[x], x))
            want += [(key, g[box[:2]], *box) for box in R.largest_rectangles(order, 100, 100, side)]
        assert found == sorted(want)


def test_a_sweep_holds_few_rows():
    read = 0

    def rows():
        nonlocal read
        for read in range(1, 2001):
            yield "k", read, [1, 2, 3], [0, read % 2, 2]

    found = R.swept_rectangles(rows())
    assert next(found) == ("k", 0, 1, 1, 20, 3) and read <= 100
    assert all(next(found) for _ in range(20)) and read < 600
