"""Checks of a result against its target schema, and what to do about those that fail.

A sample row is looked for by a filter on the result, whatever order or index
its rows have.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators.tidy import ROW
from .analysis import Schema

#: A result with fewer rows than this part of the expected ones is wrong, one with more than this multiple is doubtful.
FEWEST, MOST = 0.5, 2
#: Percent of nulls above which a column is named.
MANY_NULLS = 50


@dataclass
class Check:
    name: str
    passed: bool
    found: object = None
    wanted: object = None
    #: Whether the result can stand though the check has failed.
    doubtful: bool = False
    advice: str = ""


@dataclass
class Report:
    checks: list[Check]
    shape: tuple[int, int]
    #: Percent of nulls of the columns that have many.
    mostly_null: dict[str, float] = field(default_factory=dict)

    @property
    def is_valid(self) -> bool:
        return all(c.passed or c.doubtful for c in self.checks)

    @property
    def failed(self) -> list[Check]:
        return [c for c in self.checks if not c.passed]

    def document(self) -> dict:
        return {"is_valid": self.is_valid, "shape": self.shape, "checks": [asdict(c) for c in self.checks], "mostly_null": self.mostly_null}


def _matches(column: str, expected, dtype: str) -> Column:  # noqa: ANN001
    found = F.col(f"`{column}`")
    if expected is None or expected != expected:
        return found.isNull()
    if isinstance(expected, (int, float)) and not isinstance(expected, bool):
        return F.coalesce(C.same_value(found, F.lit(float(expected))), F.lit(False))
    return F.coalesce(found.cast("string") == str(expected), F.lit(False))


def validate(df: DataFrame, schema: Schema | dict) -> Report:
    """One pass over the result counts all that the checks need."""
    df, schema = df.drop(ROW), Schema.of(schema)
    kinds = dict(df.dtypes)
    samples = [s for s in schema.samples if s.get("expected_row")]
    rows = [reduce(lambda a, b: a & b, [_matches(c, v, kinds[c]) for c, v in s["expected_row"].items() if c in kinds], F.lit(True)) for s in samples]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    n, *counts = df.agg(F.count("*"), *nulls, *(F.count_if(x) for x in rows)).first()
    null_counts, hits = counts[: len(nulls)], counts[len(nulls) :]

    missing = [c for c in schema.names if c not in kinds]
    extra = [c for c in df.columns if c not in schema.names]
    checks = [
        Check("rows", n > 0, n, advice="look for a filter that takes everything"),
        Check("columns", not missing, list(df.columns), schema.names, advice=f"add steps that make {missing}; not asked for: {extra}"),
    ]
    if schema.rows > 0:
        few = n < FEWEST * schema.rows
        advice = "the region may begin late, or a filter or a pairing take too much" if few else "an unpivot may repeat values, or sums be left"
        checks.append(Check("row_count", FEWEST * schema.rows <= n <= MOST * schema.rows, n, schema.rows, doubtful=not few, advice=advice))
    for sample, hit in zip(samples, hits):
        checks.append(Check("sample", hit > 0, hit, sample["expected_row"], advice=f"see which columns {sample.get('description', 'its values')} come from"))
    shares = {c: round(100 * k / n, 1) for c, k in zip(df.columns, null_counts) if n}
    return Report(checks, (n, len(df.columns)), {c: share for c, share in shares.items() if share > MANY_NULLS})


def feedback(report: Report) -> list[dict]:
    """For each check that failed: its name, what was found and wanted, and what to do."""
    return [{"check": c.name, "found": c.found, "wanted": c.wanted, "advice": c.advice} for c in report.failed]
