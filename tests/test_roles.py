"""Which columns are values of a variable, and which are not."""

from __future__ import annotations

import random

import pytest

from tessella.operators.tidy import ROW
from tessella.plans import planner as pl
from tessella.plans import roles


def table(spark, columns: dict[str, list]):
    rows = [(i, *v) for i, v in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, [ROW, *columns])


def numbers(seed: int, low: int, high: int, n: int = 20) -> list[int]:
    rng = random.Random(seed)
    return [rng.randint(low, high) for _ in range(n)]


def shares(seed: int, n: int = 20) -> list[float]:
    rng = random.Random(seed)
    return [round(rng.uniform(0.5, 99), 1) for _ in range(n)]


AREAS = [f"area {i}" for i in range(20)]


@pytest.mark.parametrize("names", [("Male count", "Male pct", "Female count", "Female pct"), ("count_male", "pct_male", "count_female", "pct_female"), ("MaleCount", "MalePct", "FemaleCount", "FemalePct")])
def test_values_by_measures(spark, names):
    df = table(spark, {"Area": AREAS, **dict(zip(names, (numbers(1, 100, 900), shares(2), numbers(3, 100, 900), shares(4))))})
    planner = pl.RulePlanner()
    analysis = planner.analyze(df)
    groups = {m.lower(): {v.lower(): c for v, c in g.items()} for m, g in analysis.value_groups.items()}
    assert groups == {"count": {"male": names[0], "female": names[2]}, "pct": {"male": names[1], "female": names[3]}}
    assert analysis.id_columns == ["Area"]
    schema = planner.schema(df, analysis)
    result = planner.plan(df, analysis, schema).apply(df)
    assert set(result.columns) - {ROW} == {"area", "variable", "count", "pct"} and result.count() == schema.rows == 40
    row = result.where("area = 'area 3' and lower(variable) = 'female'").first()
    assert (row["count"], row["pct"]) == (numbers(3, 100, 900)[3], shares(4)[3])


def test_sides_are_told_by_the_profile(spark):
    """No word says what is measured; columns of a measure are alike, those of a value are not."""
    df = table(spark, {"Area": AREAS, "Red Depth": numbers(1, 1000, 9000), "Red Glow": shares(2), "Blue Depth": numbers(3, 1000, 9000), "Blue Glow": shares(4)})
    assert roles.value_groups(df, []) == {"Depth": {"Red": "Red Depth", "Blue": "Blue Depth"}, "Glow": {"Red": "Red Glow", "Blue": "Blue Glow"}}
    df = table(spark, {"Area": AREAS, "Depth Red": numbers(1, 1000, 9000), "Glow Red": shares(2), "Depth Blue": numbers(3, 1000, 9000), "Glow Blue": shares(4)})
    assert roles.value_groups(df, []) == {"Depth": {"Red": "Depth Red", "Blue": "Depth Blue"}, "Glow": {"Red": "Glow Red", "Blue": "Glow Blue"}}


def test_one_measure(spark):
    df = table(spark, {"Area": AREAS, "North sales": numbers(1, 5, 90), "South sales": numbers(2, 5, 90), "East sales": numbers(3, 5, 90)})
    assert roles.value_groups(df, []) == {"sales": {"North": "North sales", "South": "South sales", "East": "East sales"}}


def test_a_grid_with_a_hole(spark):
    names = [f"{v} {m}" for v in ("A", "B", "C", "D") for m in ("count", "rate")][:-1]
    df = table(spark, {"Area": AREAS, **{n: numbers(i, 100, 900) if n.endswith("count") else shares(i) for i, n in enumerate(names)}})
    found = roles.value_groups(df, [])
    assert len(found["count"]) == 4 and list(found["rate"]) == ["A", "B", "C"]


def test_names_that_are_values_of_another_column(spark):
    places = ["Ayr", "Bly", "Cam"]
    df = table(spark, {"From": [places[i % 3] for i in range(20)], "When": [f"t{i}" for i in range(20)], **{p: numbers(i, 0, 50) for i, p in enumerate(places)}})
    analysis = pl.RulePlanner().analyze(df)
    assert analysis.value_groups == {"value": {p: p for p in places}} and analysis.id_columns == ["From", "When"]


@pytest.mark.parametrize(
    "columns",
    [
        {"Respondent ID": list(range(20)), "Age": numbers(1, 18, 90), "Gender": ["m", "f"] * 10, "Score": shares(2), "Rank": list(range(20))},
        {"City": AREAS, "Temp min": numbers(1, 0, 10), "Temp max": numbers(2, 10, 30), "Temp mean": shares(3)},
        {"Order ID": list(range(20)), "Customer ID": list(range(100, 120)), "Product ID": list(range(300, 320)), "Qty": numbers(1, 1, 9)},
        {"Item": AREAS, "Gross weight": numbers(1, 1, 9), "Net weight": numbers(2, 1, 9)},
        {"Item": AREAS, "Case count": numbers(1, 10, 90), "Case rate": shares(2), "Case share": [x / 100 for x in shares(3)]},
        {"Place": AREAS, "Home area": numbers(1, 10**6, 9 * 10**6), "Lake area": shares(2), "Wood area": numbers(3, 1, 5)},
    ],
)
def test_tables_that_stay_as_they_are(spark, columns):
    df = table(spark, columns)
    assert pl.RulePlanner().analyze(df).value_groups == {}


def test_scores(spark):
    n, found = roles.profile(table(spark, {"Order ID": list(range(20)), "Name": AREAS, "Level": [1, 2] * 10, "Price": ["1,200.5"] * 19 + ["n/a"]}))
    assert n == 20 and [c.role(n) for c in found] == ["identifier", "dimension", "dimension", "measure"]
    assert found[3].numbers == 19 and found[3].mean == 1200.5 and not found[3].whole
