"""What is known of a table's structure, and what its tidy form should be.

Both are plain records with defaults. As documents (files that a run leaves, replies of
a model) they are nested under fixed names; a document that lacks some of them is filled
up from the defaults, so half an answer is as good as none only where it matters.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# The names that the parts of an analysis and of a schema have in documents.
ANALYSIS_NAMES = {
    "description": "semantic_understanding.data_description",
    "header_rows": "header_structure.header_rows",
    "start": "data_region.start_row",
    "end": "data_region.end_row",
    "id_columns": "column_patterns.id_columns",
    "value_groups": "column_patterns.value_columns",
    "aggregate_columns": "column_patterns.aggregate_columns",
    "metadata_columns": "column_patterns.metadata_columns",
    "pair_label": "row_patterns.bilingual_details.label_column",
    "pairs_repeat": "row_patterns.bilingual_details.same_data",
    "marker_column": "row_patterns.section_marker_details.marker_column",
    "marker_rows": "row_patterns.section_marker_details.marker_rows",
    "total_rows": "row_patterns.total_row_indices",
    "detail_column": "implicit_aggregation.detection_details.category_column",
    "detail_delimiter": "implicit_aggregation.detection_details.delimiter",
    "summary_values": "implicit_aggregation.detection_details.summary_values",
    "detail_values": "implicit_aggregation.detection_details.detail_values",
    "complexity": "transformation_complexity",
    "findings": "special_patterns",
}
SCHEMA_NAMES = {
    "unit": "observation_unit.description",
    "columns": "target_columns",
    "rows": "expected_output.row_count_estimate",
    "formula": "expected_output.row_count_formula",
    "samples": "validation_samples",
}


def _nested(values: dict, names: dict[str, str]) -> dict:
    out: dict = {}
    for key, value in values.items():
        *folders, last = names.get(key, key).split(".")
        at = out
        for f in folders:
            at = at.setdefault(f, {})
        at[last] = value
    return out


def _flat(document: object, names: dict[str, str]) -> dict:
    """The parts that a document has, by our names; whatever isn't there, or isn't nested as it should be, is left out."""
    out = {}
    for key, path in names.items():
        at = document
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            out[key] = at
    return out


@dataclass
class Analysis:
    """Columns are named as they are once the header rows have been promoted; rows are numbered as in the table."""

    description: str = ""
    header_rows: list[int] = field(default_factory=list)
    start: int = 0
    end: int = -1
    #: string, integer or float for columns whose header was promoted, as they are read.
    types: dict[str, str] = field(default_factory=dict)
    id_columns: list[str] = field(default_factory=list)
    #: name of the values -> {value of the variable: column}
    value_groups: dict[str, dict[str, str]] = field(default_factory=dict)
    aggregate_columns: list[str] = field(default_factory=list)
    metadata_columns: list[str] = field(default_factory=list)
    pair_label: str | None = None
    pairs_repeat: bool = True
    marker_column: str | None = None
    #: The first marker and total rows; the counts are of all rows, None where an analysis comes from elsewhere.
    marker_rows: list[int] = field(default_factory=list)
    total_rows: list[int] = field(default_factory=list)
    left_out: int | None = None
    detail_column: str | None = None
    detail_delimiter: str | None = None
    summary_values: list[str] = field(default_factory=list)
    detail_values: list[str] = field(default_factory=list)
    #: column -> {spelling: the spelling that stands for it}
    spellings: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def findings(self) -> list[str]:
        """What makes the table messy, for people."""
        out = []
        if self.header_rows:
            out.append(f"names stand in rows {self.header_rows}")
        out += [f"columns {list(columns.values())} hold values of one variable ({group})" for group, columns in self.value_groups.items()]
        if self.pair_label is not None:
            out.append(f"two rows belong together, told apart by {self.pair_label}, with {'the same' if self.pairs_repeat else 'different'} numbers")
        if self.marker_column is not None:
            out.append(f"rows with {self.marker_column} alone head the rows below, from {self.marker_rows[:3]}")
        if self.total_rows:
            out.append(f"sums stand among the rows, from {self.total_rows[:3]}")
        if self.detail_column is not None:
            out.append(f"{self.detail_column} holds two things, parted by {self.detail_delimiter!r}")
        out += [f"{column} spells values in several ways" for column in self.spellings]
        return out

    @property
    def complexity(self) -> str:
        n = len(self.findings)
        return "low" if not n else "medium" if n == 1 else "high"

    def document(self) -> dict:
        names = [f.name for f in fields(self)]
        return _nested({x: getattr(self, x) for x in [*names, "complexity", "findings"]}, ANALYSIS_NAMES)

    @staticmethod
    def of(document: object, columns: list[str], n: int) -> Analysis:
        """From a document, with the region held within the table's n rows and columns that the table has."""
        known = {f.name for f in fields(Analysis)}
        names = {x: ANALYSIS_NAMES.get(x, x) for x in known}
        out = Analysis(**({"id_columns": list(columns), "end": n - 1} | _flat(document, names)))
        out.start, out.end = max(0, out.start), min(out.end, n - 1)
        return out


@dataclass
class Schema:
    """The tidy table: one {name, data_type} for each column, how many rows, and rows that it must have."""

    columns: list[dict] = field(default_factory=list)
    rows: int = 0
    formula: str = ""
    unit: str = ""
    #: [{description, expected_row: {column: value}}]
    samples: list[dict] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    def document(self) -> dict:
        return _nested({f.name: getattr(self, f.name) for f in fields(self)}, SCHEMA_NAMES)

    @staticmethod
    def of(document: object) -> Schema:
        return document if isinstance(document, Schema) else Schema(**_flat(document, SCHEMA_NAMES))
