"""Queries over whole tables against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.operators import index as I

N_PARTS = 2600


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with a part table whose rows go far beyond row 1000."""
    folder = str(tmp_path_factory.mktemp("parts"))
    k = F.col("p_partkey")
    spark.range(N_PARTS).select(F.col("id").alias("p_partkey")).select("p_partkey", F.concat(F.lit("b"), (k % 25).cast("string")).alias("p_brand"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("p_type"), (k % 50).alias("p_size")).write.parquet(f"{folder}/part.parquet")
    return folder


def _grid(k: int) -> list:
    return [None] * 3 if k % 6 == 0 else ["x"] * 3 if k % 4 == 0 else [f"b{k % 25}", f"t{k % 7}", str(k % 50)]


def test_grid_queries_take_all_rows(spark, parts):
    grid = {k: _grid(k) for k in range(N_PARTS)}
    assert sorted(r["row"] for r in Q.homogeneous_rows(spark, parts).collect()) == [k for k, v in grid.items() if len(set(v)) > 1]
    assert sorted(r["row"] for r in Q.blank_rows(spark, parts).collect()) == [k for k, v in grid.items() if any(x is not None for x in v)]
    assert sorted(r["col"] for r in Q.homogeneous_cols(spark, parts).collect()) == [1, 2, 3]


def test_homogeneous_cols_see_the_last_row(spark, tmp_path):
    rows = [(k, "b", "t", 1 if k < 2999 else 2) for k in range(1, 3000) if k % 6 and k % 4]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [r["col"] for r in Q.homogeneous_cols(spark, str(tmp_path)).collect()] == [3]


def test_neighbourhood_reaches_the_last_row(spark, parts):
    want = {r for k in range(0, N_PARTS, 13) for r in range(k - 2, k + 3) if 5 <= r < N_PARTS}
    assert sorted(r["row"] for r in Q.k_neighborhood(spark, parts).collect()) == sorted(want)


def test_plan_sums_all_events(spark, tmp_path):
    events = [(i, "abc"[i % 3], float(i % 17)) for i in range(1234)]
    spark.createDataFrame(events, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want: dict = {}
    for i, kind, value in events:
        if i % 10:
            key = (f"S{i // 10 % 5}", kind)
            want[key] = want.get(key, 0) + value
    assert {(r["section"], r["type"]): r["total"] for r in Q.declarative_plan(spark, str(tmp_path)).collect()} == want


def _slow_cover(cells: set) -> list[str]:
    """From the first free cell in row order, as wide as possible, then as tall as the width stays free."""
    free, out = set(cells), []
    while free:
        r, c = min(free)
        wide = next(w for w in range(1, 99) if (r, c + w) not in free)
        tall = next(t for t in range(1, 99) if not all((r + t, c + x) in free for x in range(wide)))
        free -= {(r + y, c + x) for y in range(tall) for x in range(wide)}
        first, last = f"{chr(64 + c)}{r}", f"{chr(63 + c + wide)}{r + tall - 1}"
        out.append(first if first == last else f"{first}:{last}")
    return out


def test_ranges_of_all_values(spark, tmp_path):
    nation = [(k, f"N{k}", k if k < 5 else k // 6) for k in range(25)]
    spark.createDataFrame(nation, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    at: dict = {}
    for r, row in enumerate([("n_nationkey", "n_name", "n_regionkey"), *nation], 1):
        for c, v in enumerate(row, 1):
            at.setdefault(str(v), set()).add((r, c))
    found = {r["value"]: r["ranges"] for r in Q.value_ranges(spark, str(tmp_path)).collect()}
    assert found == {v: ", ".join(_slow_cover(cells)) for v, cells in at.items()}
    assert any(":" in x for x in found.values())


def test_both_languages_are_looked_for_in_the_whole_text(spark, tmp_path):
    texts = ["1" * 40 + "a", "\n" * 30 + "b", "2" * 25 + " 類 z", "3" * 50, "x", "4" * 30 + "類", "a" + "-" * 30 + "別", "", "y" * 30, "5" * 21 + "é", None, None]
    docs = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(i: int, t: str | None) -> bool | None:
        whole = t if t is None or i % 3 == 2 else "類別" + t
        return None if whole is None else any("一" <= c <= "鿿" for c in whole) and any(c.isascii() and c.isalpha() for c in whole)

    assert {r["doc_id"]: r["both_languages"] for r in Q.bilingual_flag(spark, str(tmp_path)).collect()} == {i: want(i, t) for i, t in docs}


def _slow_rectangles(order: list, max_row: int, max_col: int) -> list[str]:
    """Every width and height up to 20 is tried at each cell in order; the largest wins, of equals the narrowest."""
    free, out = set(order), []
    for r, c in order:
        if (r, c) in free:
            fits = [(-w * t, w, t) for w in range(1, 21) for t in range(1, 21) if r + t - 1 <= max_row and c + w - 1 <= max_col and all((r + y, c + x) in free for y in range(t) for x in range(w))]
            _, w, t = min(fits)
            free -= {(r + y, c + x) for y in range(t) for x in range(w)}
            first, last = f"{chr(64 + c)}{r}", f"{chr(63 + c + w)}{r + t - 1}"
            out.append(first if first == last else f"{first}:{last}")
    return out


def test_format_rectangles_of_all_cells(spark, tmp_path):
    n = 60
    k = F.col("p_partkey")
    rows = spark.range(1, n).select(F.col("id").alias("p_partkey"))
    rows.select("p_partkey", F.concat(F.lit("b"), k).alias("p_brand"), F.lit("t").alias("p_type"), (k % 5).alias("p_size"), F.lit("n").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    cells = [(r, c) for r in range(1, n) for c in (1, 2, 3, 5) if r % 10 and (r + c) % 7]
    of = {"text": [x for x in cells if x[1] != 3], "integer": [x for x in cells if x[1] == 3]}
    # Bold cells (every fifth row) are formats of their own: those of the format that is seen first come first.
    first = {s: {b: min(x for x in own if (x[0] % 5 == 0) == b) for b in (True, False)} for s, own in of.items()}
    want = {s: ", ".join(_slow_rectangles(sorted(own, key=lambda x: (first[s][x[0] % 5 == 0], x)), n - 1, 5)) for s, own in of.items()}
    assert {r["semantic"]: r["ranges"] for r in Q.format_rectangles(spark, str(tmp_path)).collect()} == want


def test_no_row_holds_the_cells_of_a_format(spark):
    """Groups without a number format count too; the sweep reads rows of cells, and rectangles go into one row at the end only."""
    cells = [("f", "s", 0, r, c, "bi"[r % 3 == 0], "General" if c < 3 else None, "text") for r in range(1, 50) for c in range(1, 5) if r % 7]
    kinds = "file string, sheet string, region int, row int, col int, look string, nf string, semantic string"
    df = spark.createDataFrame(cells, kinds).withColumn("format", F.struct("look", "nf")).drop("look", "nf")
    found = {r["nf"]: ", ".join(r["ranges"]) for r in I.format_rectangles(df).collect()}
    for nf in ("General", None):
        own = sorted(((x[3], x[4]) for x in cells if x[6] == nf), key=lambda x: (x[0] % 3 == 0, x))
        assert found[nf] == ", ".join(_slow_rectangles(own, 49, 4))
