"""Covers of crowded values against the cell-by-cell cover."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import ranges as R
from tessella.operators import cover
from tessella.operators import index as I

from .test_structure import sheet


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_cover_of_random_sheets(spark, stretch):
    rng = random.Random(stretch)
    own: dict = {}
    for k in range(12):
        share = rng.choice([0.3, 0.6, 0.9, 0.97])
        own[f"v{k}"] = [(r, c) for r in range(1, rng.randint(2, 30)) for c in range(1, rng.randint(2, 12)) if rng.random() < share]
    rows = [("S", v, r, c) for v, cells in own.items() for r, c in cells for _ in range(2)]
    df = spark.createDataFrame(rows, "sheet string, value string, row int, col int").repartition(3)
    found: dict = {}
    for x in cover.cover(df, ["sheet", "value"], stretch).collect():
        found.setdefault(x["value"], []).append((x["r0"], x["c0"], x["r1"], x["c1"]))
    assert {v: sorted(x) for v, x in found.items()} == {v: R.cover(cells) for v, cells in own.items() if cells}


def test_sweep_holds_open_ranges_only():
    """A million rows alike are one band; of a million rows by turns, one range is open at a time."""
    key = ("k",)
    assert list(cover.sweep(iter([(key, 1, 10**6, [(1, 3), (5, 5)])]))) == [(key, 1, 1, 10**6, 3), (key, 1, 5, 10**6, 5)]
    turns = ((key, r, r, [(1, 1 + r % 2)]) for r in range(1, 10**5))
    found = list(cover.sweep(turns))
    assert found[0][1:] == (1, 2, 1, 2) or found[0][1:] == (1, 1, 1, 2)
    assert sorted(x[1:] for x in found) == sorted(R.cover((r, c) for r in range(1, 10**5) for c in range(1, 2 + r % 2)))


def test_a_value_of_a_million_cells(spark):
    """A million cells of one value, with holes: bands and blocks, not cells, reach the sweep."""
    n = 250_000
    cells = spark.range(1, n + 1).select(F.lit("v").alias("value"), F.col("id").cast("int").alias("row"), F.explode(F.expr("sequence(1, 4)")).alias("col")).where("not (row % 1000 = 7 and col = 2) and row % 50000 <> 0")
    found = cover.cover(cells, ["value"])
    area = found.agg(F.sum((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)), F.count("*")).first()
    assert area[0] == cells.count()
    rows = cover.bands(cover.row_runs(cells, ["value"]), ["value"])
    assert rows.count() < 600 and rows.select("block").distinct().count() == 5


def test_value_ranges_equal_the_index(spark):
    rng = random.Random(5)
    grid = {(r, c): rng.choice(["a", "b", "a", None, " ", 1]) for r in range(1, 25) for c in range(1, 9)}
    styles = {(3, 1): {"merged_range": "A3:B3", "is_merge_start": True}, (9, 2): {"merged_range": "B9:C10", "is_merge_start": True}}
    cells = sheet(spark, grid, styles=styles).unionByName(sheet(spark, {(1, 1): "only"}, "T")).withColumn("region", F.lit(0))
    of = lambda df: {(r["sheet"], r["value"]): (list(r["ranges"]), tuple(r["first_seen"])) for r in df.select("sheet", "value", "ranges", "first_seen").collect()}
    for longest, skip in ((None, False), (100, True)):
        plain = cells if skip else cells.withColumn("is_merge_start", F.lit(False))
        assert of(I.value_ranges(cells, longest=longest, skip_blank=skip)) == of(I.index_ranges(I.inverted_index(plain, longest=longest, skip_blank=skip)))
