"""Declarative plans: a list of steps, each an operator's name and its parameters, as JSON.

A plan is data. It is checked against the operators' names and parameters and
then applied as DataFrame operations; no generated code is ever run.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import tidy

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        tidy.slice_region, tidy.promote_header, tidy.drop_footer, tidy.unpivot, tidy.drop_aggregate_columns, tidy.drop_total_rows,
        tidy.fill_section_markers, tidy.merge_bilingual_pairs, tidy.split_dimension, tidy.exclude_summary_rows, tidy.cast_types,
        tidy.select_rename, tidy.map_values,
    )
}


@dataclass
class Plan:
    steps: list[dict] = field(default_factory=list)

    def add(self, operator: str, **parameters) -> Plan:
        self.steps.append({"operator": operator, **parameters})
        return self

    def check(self) -> None:
        for i, step in enumerate(self.steps):
            name = step.get("operator")
            if name not in OPERATORS:
                raise ValueError(f"step {i}: no operator {name!r}")
            try:
                inspect.signature(OPERATORS[name]).bind(None, **{k: v for k, v in step.items() if k != "operator"})
            except TypeError as e:
                raise ValueError(f"step {i}, {name}: {e}") from e

    def apply(self, df: DataFrame) -> DataFrame:
        self.check()
        for step in self.steps:
            df = OPERATORS[step["operator"]](df, **{k: v for k, v in step.items() if k != "operator"})
        return df

    def to_json(self) -> str:
        return json.dumps(self.steps, ensure_ascii=False, indent=2)

    @staticmethod
    def from_json(text: str) -> Plan:
        plan = Plan(parse_reply(text))
        plan.check()
        return plan


def snake(name: str) -> str:
    """A column's name in the result: letters, digits and underscores, in lower case."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z一-鿿]+", "_", name)).strip("_").lower() or "column"


def parse_reply(text: str):  # noqa: ANN201
    """JSON from a reply: without code fences, else the outermost {...} or [...] in it."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(body)
    except ValueError:
        pass
    for a, b in (("{", "}"), ("[", "]")):
        start, end = body.find(a), body.rfind(b)
        if 0 <= start < end:
            try:
                return json.loads(body[start : end + 1])
            except ValueError:
                continue
    raise ValueError("no JSON in the reply")
