"""Regions, anchors, components and whole encodings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import cells as C
from tessella.functions import ranges as R
from tessella.operators import graph, scratch
from tessella.operators import structure as S
from tessella.operators.model import CELLS
from tessella.plans import encode as E


def sheet(spark, grid: dict, name: str = "S", **styles):
    """Cells of {(row, col): value}; styles: {(row, col): {...}}."""
    rows = []
    for (r, c), v in grid.items():
        py = type(v).__name__ if v is not None else None
        dtype = {"str": "s", "bool": "b"}.get(py, "n")
        look = {"number_format": "General", "bold": False, "h_align": None, "fill": "none", "has_border": False, "merged_range": None, "is_merge_start": False} | styles.get("styles", {}).get((r, c), {})
        rows.append(("f", name, r, c, dtype, py, None if v is None else str(v), *look.values(), styles.get("sheet_no", 0)))
    return spark.createDataFrame(rows, CELLS)


# A published table whose encoding is known.
LABELS = ["身體虐待", " 精神虐待", " 疏忽照顧", " 侵吞財產", " 遺棄長者", " 性侵犯", " 其他", " 多種虐待"]
ITEMS = ["Physical abuse", "Psychological abuse ", "Neglect", "Financial abuse", "Abandonment", "Sexual abuse", "Others", "Multiple abuse"]
COUNTS = [390, 26, 3, 87, 1, 1, 0, 20, 200, 15, 1, 41, 1, 1, 0, 6, 190, 11, 2, 46, 0, 0]


def golden_grid() -> dict:
    head = ["年份/Year", "有否向警方舉報事件", "Incident Being or Not Reported to Police", "類別", "Category", "項目", "Item", "個案數字/No. of Cases"]
    grid = {(1, c): v for c, v in enumerate(head, 1)}
    for i in range(30):
        r, k = i + 2, i % 8
        male, female = 8 <= i < 16, i >= 16
        wide = male or female
        label = LABELS[k] + (" - 男性" if male else " - 女性" if female else "")
        item = ITEMS[k].rstrip() + " - Male" if male else ITEMS[k] + " - Female" if female else ITEMS[k]
        kind = ("虐待長者性質及受虐長者性別", "Type of Elder Abuse and Sex of Elderly Person Being Abused") if wide else ("虐待長者性質", "Type of Elder Abuse")
        grid |= {(r, 1): 2005, (r, 2): "不適用", (r, 4): kind[0], (r, 5): kind[1], (r, 6): label, (r, 7): item, (r, 8): COUNTS[i] if i < len(COUNTS) else 5}
    return grid


def test_golden_sheet(spark):
    found = E.encode(sheet(spark, golden_grid(), "Sheet1"), E.Options(profile="v1"))
    s, m = found["sheets"]["Sheet1"], found["compression_metrics"]["sheets"]["Sheet1"]
    assert s["structural_anchors"] == {"rows": list(range(1, 24)), "columns": list("ABCDEFGH")}
    assert s["cells"]["1"] == ["H6:H7", "H12", "H14:H15"] and s["cells"]["2005"] == ["A2:A23"]
    assert list(s["formats"].values()) == [["A1:H1", "B2:B21", "D2:G21", "B22:B23", "D22:G23"], ["A2:A21", "H2:H21", "A22:A23", "H22:H23"], ["C2:C21", "C22:C23"]]
    assert [m[f"{x}_tokens"] for x in ("after_anchor", "after_inverted_index", "after_merged_index", "after_format", "numeric", "final")] == [3746, 2284, 1751, 262, 93, 2320]


def _slow_components(full: dict, look: dict) -> dict:
    edges = [(a, b) for a in full for b in ((a[0], a[1] + 1), (a[0] + 1, a[1])) if b in full and look[a] == look[b]]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    grid = {(r, c): "x" for r in range(1, 14) for c in range(1, 12) if rng.random() < 0.7}
    fills = {at: rng.choice("ab") for at in grid}
    cells = sheet(spark, grid, styles={at: {"fill": f} for at, f in fills.items()}).withColumn("region", F.lit(0))
    want = _slow_components(grid, fills)
    size = {x: list(want.values()).count(x) for x in set(want.values())}
    found = {(r["row"], r["col"]): (r["component"] // (1 << 24), r["component"] % (1 << 24)) for r in S.components(S.similar_edges(cells)).collect()}
    assert found == {x: r for x, r in want.items() if size[r] >= 4}


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_components_of_tall_runs_over_borders(spark, stretch):
    rng = random.Random(stretch)
    grid = {(r, c): "x" for r in range(1, 30) for c in range(1, 6)}
    fills = {(r, c): "ab"[(r // rng.choice([4, 9]) + c // 2) % 2] for r, c in grid}
    cells = sheet(spark, grid, styles={at: {"fill": f} for at, f in fills.items()}).withColumn("region", F.lit(0))
    want = _slow_components(grid, fills)
    edges = S.similar_edges(cells)
    found = S.components(edges.unionByName(edges.where("row % 2 = 0")), 1, stretch).collect()
    assert len(found) == len(want) and {(r["row"], r["col"]): (r["component"] // (1 << 24), r["component"] % (1 << 24)) for r in found} == want
    assert all(r["size"] == list(want.values()).count(want[r["row"], r["col"]]) for r in found)
    assert S.components(edges.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = graph.components(edges, ["k"]).collect()
    assert len(rows) == 501 and {r["component"] for r in rows} == {0}


@pytest.mark.parametrize("differ", [(), ("bold",), ("has_border",), ("py_type",), ("number_format",), ("fill",), ("bold", "has_border"), ("bold", "py_type"), ("fill", "bold")])
def test_similarity_is_the_weighted_score(spark, differ):
    weights = {"bold": 2.0, "fill": 3.0, "has_border": 1.5, "py_type": 2.0, "number_format": 1.5}
    score = sum(w for x, w in weights.items() if x not in differ) / 10
    a = {"bold": False, "fill": "none", "has_border": False, "py_type": "str", "number_format": "General"}
    b = a | {x: (not a[x] if isinstance(a[x], bool) else "other") for x in differ}
    row = spark.createDataFrame([(a, b)], "a struct<bold:boolean,fill:string,has_border:boolean,py_type:string,number_format:string>, b struct<bold:boolean,fill:string,has_border:boolean,py_type:string,number_format:string>")
    assert row.select(C.similar("a", "b")).first()[0] == (score >= 0.75)


def test_regions(spark):
    grid = {(r, c): 1 for r in range(1, 5) for c in (1, 2)} | {(r, c): 2 for r in range(7, 12) for c in (1, 2, 5, 6)} | {(2, 9): " "}
    found = S.table_regions(sheet(spark, grid)).orderBy("region").collect()
    assert [tuple(r[x] for x in ("min_row", "max_row", "min_col", "max_col", "n_cells")) for r in found] == [(7, 11, 5, 6, 10), (7, 11, 1, 2, 10), (1, 4, 1, 2, 8)]


@pytest.mark.parametrize("stretch", [1, 3, 4, 1 << 16])
def test_islands_over_stretches(spark, stretch):
    rng = random.Random(stretch)
    own = {(f"s{k}", i) for k in range(3) for i in range(1, 60) if rng.random() < (0.5, 0.8, 1)[k]}
    df = spark.createDataFrame([("f", 0, *x) for x in own for _ in range(2)], "file string, sheet_no int, sheet string, row int")
    found = {(r["sheet"], r["row"]): (r["min_row"], r["max_row"]) for r in S.islands(df, "row", stretch=stretch).collect()}
    want = {}
    for name, i in own:
        a = b = i
        while (name, a - 1) in own:
            a -= 1
        while (name, b + 1) in own:
            b += 1
        want[name, i] = a, b
    assert found == want and S.islands(df, "row", stretch=stretch).count() == len(want)


@pytest.mark.parametrize("stretch", [4, 1 << 16])
def test_cells_of_regions(spark, stretch):
    """Side by side, one above the other, overlapping, with blank cells; no more rows than cells where regions are apart."""
    rng = random.Random(1)
    grid = {(r, c): rng.choice(["x", 1, None]) for r in range(1, 40) for c in range(1, 12) if rng.random() < 0.6}
    cells = sheet(spark, grid).unionByName(sheet(spark, grid, "T"))
    boxes = [("S", 0, 1, 10, 1, 3), ("S", 1, 1, 10, 5, 6), ("S", 2, 12, 30, 1, 3), ("S", 3, 12, 30, 5, 11), ("S", 4, 35, 35, 2, 2), ("T", 0, 1, 39, 1, 11), ("T", 1, 5, 7, 2, 3)]
    keys = cells.select("file", "sheet").distinct().collect()
    regions = spark.createDataFrame([(k["file"], *b) for k in keys for b in boxes if b[0] == k["sheet"]], "file string, sheet string, region int, min_row int, max_row int, min_col int, max_col int")
    found = sorted((r["sheet"], r["region"], r["row"], r["col"], r["min_row"], r["max_row"], r["min_col"], r["max_col"]) for r in S.in_regions(cells, regions).collect())
    assert found == sorted((n, k, r, c, a, b, x, y) for r, c in grid for n, k, a, b, x, y in boxes if a <= r <= b and x <= c <= y)
    rows = S.rows_of(regions.where("sheet = 'S'"), stretch)
    assert rows.count() == 10 + 19 + 1 and sorted(len(r["beside"]) for r in rows.collect())[-1] == 2


def test_region_fallback_and_blank_sheet(spark):
    assert [r["n_cells"] for r in S.table_regions(sheet(spark, {(3, 2): "a", (9, 9): "b"})).collect()] == [2]
    assert S.table_regions(sheet(spark, {(3, 2): " ", (9, 9): "\t"})).count() == 0


def test_anchors_fall_back_to_edges(spark):
    cells = sheet(spark, {(r, 1): "x" if r % 2 else 1 for r in range(1, 10)}, styles={(r, 1): {"fill": str(r)} for r in range(1, 10)})
    found = S.anchors(cells, S.table_regions(cells), "row")
    assert sorted(r["row"] for r in found.collect()) == [1, 9]


def test_uniform_lines_take_one_and_true_as_equal(spark):
    full = sheet(spark, {(1, 1): 1, (1, 2): True, (1, 3): 1.0, (2, 1): "a", (2, 2): "b", (2, 3): None, (3, 1): None, (3, 2): None, (3, 3): None}).withColumn("region", F.lit(0))
    assert [r["row"] for r in S.drop_uniform_lines(full, "row").collect()] == [2]
    assert sorted(r["row"] for r in S.drop_blank_lines(full, "row").collect()) == [1, 2]


def test_v2_merged_ranges_and_regions(spark):
    grid = {(r, c): f"v{r}{c}" for r in range(1, 6) for c in range(1, 4)}
    cells = sheet(spark, grid, styles={(1, 1): {"merged_range": "A1:B1", "is_merge_start": True}})
    found = E.encode(cells)
    s = found["sheets"]["S"]
    assert s["cells"]["v11"] == ["A1:B1"] and s["region"] == {"min_row": 1, "max_row": 5, "min_col": 1, "max_col": 3}
    assert len(s["regions"]) == 1 and found["compression_metrics"]["sheets"]["S"]["num_regions"] == 1
    text = E.readable_text("S", s, found["compression_metrics"]["sheets"]["S"])
    assert "STRUCTURAL ANCHORS" in text and "REGION: A1:C5" in text


def test_v1_copies_merged_values(spark):
    cells = sheet(spark, {(1, 1): "m", (1, 2): None, (2, 1): "a", (2, 2): "b"}, styles={(1, 1): {"merged_range": "A1:B1", "is_merge_start": True}, (1, 2): {"merged_range": "A1:B1"}})
    assert E.encode(cells, E.Options(profile="v1"))["sheets"]["S"]["cells"]["m"] == ["A1:B1"]


def test_trivial_sheets_are_skipped(spark):
    assert E.encode(sheet(spark, {(1, 1): "only"}))["sheets"] == {}


def test_ranges_of_merge_refs(spark):
    df = spark.createDataFrame([([(1, 1), (1, 2), (2, 1)],)], "c array<struct<row:int,col:int>>")
    assert df.select(R.merge_refs(F.col("c"))).first()[0] == ["A1:B1", "A2"]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_like_others(spark, how, wide):
    """Few keys, many even ones, and a hot one among many; keys without a row, and null ones."""
    for keys in ([1] * 50, list(range(3000)), [7] * 1500 + list(range(2000)) + [None] * 3):
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
        table = scratch.materialize(rows.where("k % 3 = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")), "t")
        found = sorted(map(tuple, scratch.join_counted(rows, table, ["k"], how, wide).select("k", "i", "top").collect()), key=str)
        assert found == sorted(map(tuple, rows.join(table.drop("n"), "k", how).select("k", "i", "top").collect()), key=str)


@pytest.mark.parametrize("stretch", [1, 4, 1 << 16])
def test_neighbours_over_borders_of_stretches(spark, stretch):
    rng = random.Random(stretch)
    grid = {(r, c): "x" for r in range(1, 20) for c in range(1, 20) if rng.random() < 0.8}
    cells = sheet(spark, grid).withColumn("region", F.lit(0))
    want = sorted((*a, *b) for a in grid for b in ((a[0], a[1] + 1), (a[0] + 1, a[1])) if b in grid)
    assert sorted((r["row"], r["col"], r["to_row"], r["to_col"]) for r in S.similar_edges(cells, stretch).collect()) == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_cells_is_broadcast(spark, monkeypatch):
    """Files of many alike rows are tiny; what is made of them is not."""
    plans = []
    write = scratch.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name, **totals: plans.append((name, _plan(df))) or write(df, name, **totals))
    monkeypatch.setattr(S.graph, "components", lambda edges, keys, run=graph.components: plans.append(("edges", _plan(edges))) or run(edges, keys))
    cells = sheet(spark, {(r, c): "x" for r in range(1, 9) for c in range(1, 5)}).withColumn("region", F.lit(0))
    assert S.components(S.similar_edges(cells)).count() == 32
    assert {"edges", "named"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_counted_tables_of_many_keys_are_shuffled(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    table = scratch.materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.lit(1).alias("x")), "t")
    monkeypatch.setattr(scratch, "MANY", 2500)
    assert "Broadcast" in _plan(scratch.join_counted(rows, table, ["k"]))
    monkeypatch.setattr(scratch, "MANY", 2499)
    joined = scratch.join_counted(rows, table, ["k"])
    assert "Broadcast" not in _plan(joined) and joined.count() == 5000


def test_no_table_of_rows_or_regions_is_broadcast(spark, monkeypatch):
    plans = {}
    write = scratch.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name, **totals: plans.setdefault(name, _plan(df)) and write(df, name, **totals))
    cells = sheet(spark, {(r, c): "x" for r in range(1, 30) for c in range(1, 5) if r % 7})
    regions = write(S.table_regions(cells), "regions")
    assert re.search(r"SortMergeJoin \[file#\d+, sheet#\d+, row#\d+\]", plans["boxes"])
    assert "Broadcast" not in _plan(S.in_regions(cells, regions))
    found = S.anchors(cells, regions, "row")
    assert "Broadcast" not in plans["neighbours"] and "Broadcast" not in plans["anchored"]
    assert re.search(r"SortMergeJoin .*LeftAnti", _plan(found))
    assert sorted((r["region"], r["row"]) for r in found.collect()) == sorted((r["region"], k) for r in regions.collect() for k in range(r["min_row"], r["max_row"] + 1) if k - r["min_row"] <= 2 or r["max_row"] - k <= 2)
