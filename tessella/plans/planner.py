"""Planning: what a table's structure is, what it should become, and by which steps.

A Planner answers the same questions as a person or a language model would.
RulePlanner answers them by fixed rules from profiles and a bounded preview, so
that results can be repeated; an external model can be put in its place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import profile as P
from ..operators import tidy
from ..operators.tidy import ROW
from . import provenance, roles
from .analysis import Analysis, Schema
from .plan import Plan, parse_reply, snake

#: Rows at either end that are looked at for headers and shown to models; rows of a kind that are listed.
HEAD, TAIL, LISTED = 15, 5, 30
#: Values of a column that are compared for their spellings.
FEW_VALUES = 50
#: Header names that are values: years, months, quarters, and names with a year in them.
_PERIOD = re.compile(r"^(?:(?:19|20)\d\d(?:[-/]\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?|q[1-4]|h[12])$", re.I)
_GROUPED = re.compile(r"^(.*?)[\s_\-]*((?:19|20)\d\d|q[1-4])$", re.I)
_METADATA = re.compile(r"\b(?:rank|notes?|remarks?|source|comments?)\b", re.I)
_NAMELESS = re.compile(r"^(?:Unnamed: \d+|_c\d+|column_\d+|)$")
_NUMBER = re.compile(r"^[-+]?[\d,]*\.?\d+(?:[eE][-+]?\d+)?%?$")
_YEAR = re.compile(r"^(?:19|20)\d\d(?:\.0)?$")


class Planner(Protocol):
    def analyze(self, table: DataFrame) -> Analysis: ...
    def schema(self, table: DataFrame, analysis: Analysis) -> Schema: ...
    def plan(self, table: DataFrame, analysis: Analysis, schema: Schema) -> Plan: ...
    def repair(self, table: DataFrame, analysis: Analysis, schema: Schema, plan: Plan, feedback: list[dict]) -> Plan: ...


def columns_of(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c != ROW]


# --- previews ----------------------------------------------------------------


def cut(text: str, longest: int) -> str:
    return text if len(text) <= longest else text[:longest] + "..."


def shown(table: DataFrame, rows: list[int], longest: int = 50) -> list[str]:
    """Rows of these numbers for people and models, a line each; empty cells are left out."""
    names, lines = columns_of(table), []
    for r in sorted(table.where(F.col(ROW).isin(rows)).collect(), key=lambda r: r[ROW]):
        filled = ((j, str(r[c]).strip()) for j, c in enumerate(names) if r[c] is not None)
        lines.append(f"{r[ROW]}: " + " | ".join(f"{j} {cut(v, longest)}" for j, v in filled if v))
    return lines


def described(analysis: Analysis, schema: Schema | None = None) -> str:
    """An analysis, and a schema, as text for people and models."""
    lines = [analysis.description, f"rows {analysis.start} to {analysis.end}, {analysis.complexity} complexity", *(f"- {x}" for x in analysis.findings)]
    if schema is not None:
        lines += [f"one row for {schema.unit}; {schema.rows} rows ({schema.formula})", *(f"- {c['name']}: {c.get('data_type', 'string')}" for c in schema.columns)]
    return "\n".join(x for x in lines if x)


def column_stats(table: DataFrame) -> list[dict]:
    """For each column: non-null cells, numbers and texts among them, whether its first values have CJK letters, and samples."""
    names, kinds = columns_of(table), dict(table.dtypes)
    own = [F.col(f"`{c}`") for c in names]
    is_number = lambda c, x: F.lit(True) if kinds[c] in P.NUMERIC or kinds[c] == "boolean" else x.cast("string").try_cast("double").isNotNull()
    counts = table.agg(F.count("*"), *(F.count(x) for x in own), *(F.count_if(x.isNotNull() & is_number(c, x)) for c, x in zip(names, own))).first()
    first: dict = {}
    for r in P.first_values(table, ROW, 10).collect():
        first.setdefault(r["column"], []).append((r["rank"], r["value"]))
    out = []
    for j, c in enumerate(names):
        values = [v for _, v in sorted(first.get(c, []))]
        n, numbers = counts[1 + j], counts[1 + len(names) + j]
        typed = kinds[c] in P.NUMERIC or kinds[c] == "boolean"
        out.append({"col": j, "name": c, "non_null": n, "numeric": numbers, "text": n - numbers, "typed": typed, "has_cjk": any(re.search("[一-鿿]", v) for v in values), "samples": [cut(v, 30) for v in values[:3]]})
    return out


# --- rules -------------------------------------------------------------------


def header_rows(names: list[str], rows: list[list[str | None]]) -> list[int]:
    """Which of the first rows hold the names, if the given names don't: those without numbers (years aside) above the first with one.

    The lowest of them that fills most of its widest neighbours' columns is the last level; rows
    right above it with two cells or more are upper levels, those with one cell are titles.
    """
    if sum(bool(_NAMELESS.match(n.strip())) for n in names) * 2 < len(names) or len(names) < 2:
        return []
    filled = [[v.strip() for v in row if v is not None and v.strip()] for row in rows]
    number = lambda v: bool(_NUMBER.match(v)) and not _YEAR.match(v)
    first = next((i for i, row in enumerate(filled) if any(map(number, row))), None)
    if first is None:
        return []
    widest = max(len(row) for row in filled[: first + 1])
    last = next((i for i in range(first - 1, -1, -1) if 2 * len(filled[i]) > widest and len(set(filled[i])) > 1), None)
    if last is None:
        return []
    top = last
    while top and len(filled[top - 1]) > 1:
        top -= 1
    return list(range(top, last + 1))


@dataclass
class RulePlanner:
    """Deterministic rules; only profiles and previews of bounded size are collected."""

    max_implicit_columns: int = 3

    def analyze(self, table: DataFrame) -> Analysis:
        names = columns_of(table)
        n = (table.agg(F.max(ROW)).first()[0] if names else None)
        n = 0 if n is None else n + 1
        found = Analysis(end=n - 1)
        top = {r[ROW]: [None if r[c] is None else str(r[c]) for c in names] for r in table.where(F.col(ROW) < HEAD).collect()}
        found.header_rows = header_rows(names, [top.get(i, []) for i in range(min(HEAD, n))])
        found.start = found.header_rows[-1] + 1 if found.header_rows else 0
        shaped = self._shaped(table, found)
        names = columns_of(shaped)
        footer = tidy.first_footer_row(shaped.where(F.col(ROW) >= found.start), names[0]).first()[0] if names else None
        found.end = n - 1 if footer is None else footer - 1
        body = shaped.where(F.col(ROW).between(found.start, found.end))
        if found.header_rows:
            found.types = self._types(body)
            body = tidy.cast_types(body, found.types)
        stats = column_stats(body)
        self._columns(found, names, body)
        self._rows(found, body, [s["name"] for s in stats if not s["typed"]])
        texts = [s["name"] for s in stats if not s["typed"] and s["name"] in found.id_columns]
        self._details(found, body, texts)
        self._spellings(found, body, [c for c in texts if c not in (found.detail_column, found.pair_label)])
        found.description = f"{len(names)} columns, {found.end - found.start + 1} rows"
        return found

    @staticmethod
    def _shaped(table: DataFrame, found: Analysis) -> DataFrame:
        """The table with the names of its header rows."""
        return tidy.promote_header(table, found.header_rows) if found.header_rows else table

    def _types(self, body: DataFrame) -> dict[str, str]:
        """integer or float for columns that are all numbers, but for words that stand for nothing."""
        names = columns_of(body)

        def of(c: str) -> tuple[Column, Column, Column]:
            text = C.strip(F.col(f"`{c}`").cast("string"))
            number = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "").try_cast("double")
            blank = text.isNull() | F.lower(text).isin([*P.NA_WORDS, "-", "–", "—"])
            return F.count_if(number.isNotNull()), F.count_if(number.isNull() & ~blank), F.count_if(number != F.floor(number))

        counts = body.agg(F.count("*"), *(x for c in names for x in of(c))).first()[1:]
        each = {c: counts[3 * i : 3 * i + 3] for i, c in enumerate(names)}
        return {c: "float" if broken else "integer" for c, (numbers, others, broken) in each.items() if numbers and not others}

    def _columns(self, found: Analysis, names: list[str], body: DataFrame) -> None:
        found.aggregate_columns = [c for c in names if tidy.is_aggregate_name(c)]
        found.metadata_columns = [c for c in names if _METADATA.search(c) and c not in found.aggregate_columns]
        groups: dict[str, dict[str, str]] = {}
        for c in names:
            if c in found.aggregate_columns or c in found.metadata_columns:
                continue
            m = _GROUPED.match(c.strip())
            if _PERIOD.match(c.strip()):
                groups.setdefault("value", {})[c] = c
            elif m and m[1]:
                groups.setdefault(m[1], {})[m[2]] = c
        several = {v for columns in groups.values() if len(columns) > 1 for v in columns}
        # A single column stays as it is, unless another group has its value of the variable.
        found.value_groups = {g: columns for g, columns in groups.items() if len(columns) > 1 or several.intersection(columns)}
        if not found.value_groups:
            # One variable at a time: other grids of names are looked for where there are no periods.
            found.value_groups = roles.value_groups(body, [*found.aggregate_columns, *found.metadata_columns])
        used = {c for columns in found.value_groups.values() for c in columns.values()}
        found.id_columns = [c for c in names if c not in used and c not in found.aggregate_columns and c not in found.metadata_columns]

    def _rows(self, found: Analysis, body: DataFrame, text: list[str]) -> None:
        names = columns_of(body)
        if not names:
            return
        listed = lambda where: [r[0] for r in body.where(where).select(ROW).orderBy(ROW).limit(LISTED).collect()]
        marker = tidy.is_marker_row(body, names[0]) if len(names) > 2 else F.lit(False)
        total = tidy.is_total_row(text) if text else F.lit(False)
        found.left_out = body.agg(F.count_if(marker | total)).first()[0]
        if found.left_out:
            found.marker_rows, found.total_rows = listed(marker), listed(total)
            found.marker_column = names[0] if found.marker_rows else None
        odd, numbers = F.pmod(F.col(ROW) - found.start, F.lit(2)) == 1, [c for c in names if c not in text]
        for c in text:
            cjk = F.col(f"`{c}`").rlike("[一-鿿]")
            n, first, second = body.where(F.col(f"`{c}`").isNotNull()).agg(F.count("*"), F.count_if(~odd & cjk), F.count_if(odd & ~cjk)).first()
            if n < 4 or first + second < n or not first:
                continue
            found.pair_label = c
            if numbers:
                pair = tidy.merge_bilingual_pairs(body, c, numbers, found.start, False)
                found.pairs_repeat = not pair.agg(F.count_if(~F.col(f"`{numbers[0]}`").eqNullSafe(F.col(f"`{numbers[0]}_second`")))).first()[0]
            break

    def _details(self, found: Analysis, body: DataFrame, candidates: list[str]) -> None:
        for c in candidates[: self.max_implicit_columns]:
            pairs = tidy.implicit_aggregation(body, c).groupBy("delimiter")
            most = pairs.agg(F.collect_set("summary").alias("summary"), F.slice(F.sort_array(F.collect_set("detail")), 1, 60).alias("detail"), F.count("*").alias("n")).orderBy(F.desc("n"), "delimiter").first()
            if most:
                found.detail_column, found.detail_delimiter = c, most["delimiter"]
                found.summary_values, found.detail_values = sorted(most["summary"]), list(most["detail"])
                return

    def _spellings(self, found: Analysis, body: DataFrame, candidates: list[str]) -> None:
        """Values of columns with few that differ in case or in blanks at the ends: the most frequent spelling stands for them."""
        if not candidates:
            return
        counts = P.value_counts(body.select(ROW, *(F.col(f"`{c}`") for c in candidates)), ROW)
        groups: dict = {}
        for r in P.top_values(counts, FEW_VALUES, FEW_VALUES).collect():
            groups.setdefault((r["column"], r["value"].strip().lower()), []).append((-r["n"], r["value"]))
        for (c, _), values in sorted(groups.items()):
            best = min(values)[1].strip()
            wrong = {v: best for _, v in sorted(values) if v != best}
            if len(values) > 1 and wrong:
                found.spellings.setdefault(c, {}).update(wrong)

    def plan(self, table: DataFrame, analysis: Analysis, schema: Schema) -> Plan:
        plan = Plan()
        if analysis.header_rows:
            plan.add("promote_header", rows=analysis.header_rows)
        plan.add("slice_region", start=analysis.start, end=analysis.end)
        if analysis.types:
            plan.add("cast_types", types=analysis.types)
        shaped = self._shaped(table, analysis)
        kinds = dict(shaped.dtypes) | {c: {"integer": "bigint", "float": "double"}[t] for c, t in analysis.types.items()}
        ids = [c for c in columns_of(shaped) if c in analysis.id_columns or c in analysis.metadata_columns]
        if analysis.marker_column is not None:
            plan.add("fill_section_markers", column=analysis.marker_column, into="section")
            ids = ["section", *ids]
        if analysis.total_rows:
            plan.add("drop_total_rows", columns=[c for c in ids if kinds.get(c) == "string"])
        if analysis.aggregate_columns:
            plan.add("drop_aggregate_columns", names=analysis.aggregate_columns)
        for c, mapping in analysis.spellings.items():
            plan.add("map_values", column=c, mapping=mapping)
        pairs = analysis.pair_label is not None and analysis.marker_column is None
        if pairs:
            label, numbers = analysis.pair_label, [c for c in ids if kinds.get(c) in P.NUMERIC]
            plan.add("merge_bilingual_pairs", label=label, values=numbers, start=analysis.start, same_data=analysis.pairs_repeat)
            ids = [f"{label}_first", f"{label}_second", *(c for c in ids if c not in (label, *numbers)), *(x for c in numbers for x in ([c] if analysis.pairs_repeat else [c, f"{c}_second"]))]
        elif analysis.value_groups:
            groups = {snake(g): columns for g, columns in analysis.value_groups.items()}
            plan.add("unpivot", ids=ids, groups=groups, variable="variable")
            ids = [*ids, "variable", *groups]
        c = analysis.detail_column
        if c in ids:
            if tidy.filter_needed("exclude", analysis.summary_values):
                plan.add("exclude_summary_rows", column=c, summary_values=analysis.summary_values)
            plan.add("split_dimension", column=c, delimiter=analysis.detail_delimiter, base=f"{c}_base", extra=f"{c}_detail")
            at = ids.index(c)
            ids[at : at + 1] = [f"{c}_base", f"{c}_detail"]
        taken: dict = {}
        renamed = {}
        for c in ids:
            s = snake(c)
            taken[s] = taken.get(s, 0) + 1
            renamed[c] = s if taken[s] == 1 else f"{s}_{taken[s]}"
        return plan.add("select_rename", columns=renamed)

    def schema(self, table: DataFrame, analysis: Analysis) -> Schema:
        n, formula = table.where(F.col(ROW).between(analysis.start, analysis.end)).count(), "rows of the data region"
        n -= analysis.left_out if analysis.left_out is not None else len({*analysis.marker_rows, *analysis.total_rows})
        if analysis.pair_label is not None and analysis.marker_column is None:
            n, formula = n // 2, formula + " / 2"
        elif analysis.value_groups:
            k = len({v for columns in analysis.value_groups.values() for v in columns})
            n, formula = n * k, formula + f" * {k} values"
        plan = self.plan(table, analysis, Schema())
        result = plan.apply(table).drop(ROW)
        types = {**dict.fromkeys(P.NUMERIC, "float"), **dict.fromkeys(P.INTEGER, "integer"), "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "boolean": "boolean"}
        columns = [{"name": c, "data_type": "float" if t.startswith("decimal") else types.get(t, "string"), "is_dimension": t == "string"} for c, t in result.dtypes]
        unit = "one value of " + ", ".join(c["name"] for c in columns if c["is_dimension"])
        body = self._shaped(table, analysis).where(F.col(ROW).between(analysis.start, analysis.end))
        body = tidy.cast_types(body, analysis.types) if analysis.types else body
        return Schema(columns, n, formula, unit, provenance.samples(body, analysis, plan.steps[-1]["columns"]))

    def repair(self, table: DataFrame, analysis: Analysis, schema: Schema, plan: Plan, feedback: list[dict]) -> Plan:
        """Rules give the same answer again; too few rows put back what filters took."""
        lost = any(x["check"] == "row_count" and x["found"] < x["wanted"] for x in feedback)
        return Plan([s for s in plan.steps if not (lost and s["operator"] in ("drop_total_rows", "exclude_summary_rows"))])


@dataclass
class ModelPlanner:
    """A planner whose answers come from a model: ask(question, context) returns text with JSON.

    An answer that can't be read is asked for again with what was wrong with
    it, tries times in all; then rules stand in for it.
    """

    ask: object
    rules: RulePlanner
    tries: int = 2

    def _answer(self, question: str, context: dict, read, otherwise):  # noqa: ANN001, ANN202
        for _ in range(self.tries):
            try:
                return read(parse_reply(self.ask(question, context)))
            except Exception as e:  # noqa: BLE001  any failure of a model falls back on the rules in the end
                context = {**context, "last_error": str(e)}
        return otherwise()

    def analyze(self, table: DataFrame) -> Analysis:
        n = (table.agg(F.max(ROW)).first()[0] or 0) + 1
        rows = [*range(min(HEAD, n)), *range(max(HEAD, n - TAIL), n)]
        context = {"preview": shown(table, rows), "columns": column_stats(table), "rows": n}
        return self._answer("structure", context, lambda x: Analysis.of(x, columns_of(table), n), lambda: self.rules.analyze(table))

    def schema(self, table: DataFrame, analysis: Analysis) -> Schema:
        context = {"analysis": analysis.document(), "text": described(analysis)}
        return self._answer("schema", context, Schema.of, lambda: self.rules.schema(table, analysis))

    def _steps(self, reply: object) -> Plan:
        plan = Plan(reply)
        plan.check()
        return plan

    def plan(self, table: DataFrame, analysis: Analysis, schema: Schema) -> Plan:
        context = {"analysis": analysis.document(), "schema": schema.document(), "text": described(analysis, schema)}
        return self._answer("plan", context, self._steps, lambda: self.rules.plan(table, analysis, schema))

    def repair(self, table: DataFrame, analysis: Analysis, schema: Schema, plan: Plan, feedback: list[dict]) -> Plan:
        return self._answer("repair", {"plan": plan.steps, "feedback": feedback}, self._steps, lambda: replace(plan))
