"""Samples that rules make: right plans pass them, wrong ones don't."""

from __future__ import annotations

import pytest

from tessella.operators.tidy import ROW
from tessella.plans import planner as pl
from tessella.plans.plan import Plan
from tessella.plans.validate import validate


def table(spark, names, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"`{n.rpartition(':')[0]}` {n.rpartition(':')[2]}" for n in names))


def planned(df):
    planner = pl.RulePlanner()
    analysis = planner.analyze(df)
    schema = planner.schema(df, analysis)
    return analysis, schema, planner.plan(df, analysis, schema)


TABLES = {
    "groups": (["Area:string", "Male count:long", "Male pct:double", "Female count:long", "Female pct:double"], [(f"a{i}", 100 + i, 1.5 + i, 300 + i, 40.25 + i) for i in range(12)]),
    "periods": (["Store:string", "Rank:long", "Jan:long", "Feb:long"], [(f"s{i}", i, 3 * i, 3 * i + 1) for i in range(9)] + [("Total", None, 99, 99)]),
    "markers": (["a:string", "n:long", "m:double"], [r for k in range(6) for r in ((f"Part {k} ", None, None), (f"x{k}", k, 0.5), (f"y{k}", 2 * k, 1.5))]),
    "pairs": (["label:string", "n:long"], [r for k in range(5) for r in ((f"類別{k}", k), (f"kind {k}", k + 100))]),
    "details": (["kind:string", "n:long"], [("All", 9), ("All - north", 1), ("All - south", 8), ("x", 4)]),
    "spellings": (["kind:string", "n:long"], [("Food", 1), ("food ", 2), ("Food", 3), ("Oil", 4), ("Oil", 5), (None, 6)]),
    "plain": (["name:string", "when:timestamp_ntz", "price:decimal(9,2)", "ok:boolean"], []),
}


@pytest.mark.parametrize("name", [n for n in TABLES if n != "plain"])
def test_right_plans_pass(spark, name):
    df = table(spark, *TABLES[name])
    _, schema, plan = planned(df)
    report = validate(plan.apply(df), schema)
    assert report.is_valid and len(schema.samples) >= 3, [c for c in report.failed]
    assert all(set(s["expected_row"]) == set(schema.names) for s in schema.samples)


def test_values_of_other_types(spark):
    import datetime
    import decimal

    df = table(spark, TABLES["plain"][0], [(f"n{i}", datetime.datetime(2020, 1, 1 + i, 3), decimal.Decimal(f"{i}.25"), i % 2 == 0) for i in range(5)])
    _, schema, plan = planned(df)
    assert validate(plan.apply(df), schema).is_valid and len(schema.samples) == 3


def changed(plan: Plan, operator: str, **other) -> Plan:
    return Plan([{**s, **other} if s["operator"] == operator else s for s in plan.steps])


def test_a_wrong_unpivot_is_refused(spark):
    """Measures taken from each other's columns, and values from each other's: as many rows and the same columns, but no sample holds."""
    df = table(spark, *TABLES["groups"])
    analysis, schema, plan = planned(df)
    groups = {"count": {"Male": "Male count", "Female": "Female count"}, "pct": {"Male": "Male pct", "Female": "Female pct"}}
    assert analysis.value_groups == groups
    crossed = {"count": {"Male": "Female count", "Female": "Male count"}, "pct": groups["pct"]}
    mixed = {"count": groups["pct"], "pct": groups["count"]}
    for wrong in (crossed, mixed):
        report = validate(changed(plan, "unpivot", groups=wrong).apply(df), schema)
        assert not report.is_valid and {c.name for c in report.failed} == {"sample"}


def test_other_wrong_steps_are_refused(spark):
    df = table(spark, *TABLES["markers"])
    _, schema, plan = planned(df)
    wrong = plan.apply(df.withColumn("a", pl.F.when(pl.F.col("a").like("Part%"), "Part 0").otherwise(pl.F.col("a"))))
    assert not validate(wrong, schema).is_valid
    df = table(spark, *TABLES["pairs"])
    _, schema, plan = planned(df)
    assert not validate(changed(plan, "merge_bilingual_pairs", start=1).apply(df), schema).is_valid
    df = table(spark, *TABLES["spellings"])
    _, schema, plan = planned(df)
    assert not validate(changed(plan, "map_values", mapping={"Food": "Fuel", "Oil": "Fuel"}).apply(df), schema).is_valid


def test_no_rows_no_samples(spark):
    df = table(spark, *TABLES["groups"]).limit(0)
    _, schema, _ = planned(df)
    assert schema.samples == []
