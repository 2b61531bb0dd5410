"""Compact encoding of sheets, in two profiles.

"v1" looks at each sheet as one region, finds header rows and columns by a plain
rule, and copies merged values to all cells they cover. "v2" splits a sheet into
regions, anchors them at the edges of look-alike cells, and gives a merged value
its whole range. The relations are built for all sheets of all files together,
each written once to the scratch folder, so plans stay short. encode() collects
one file's anchors, ranges and sizes into a document; entries() leaves them
distributed, for any number of files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import ranges as R
from ..operators import index as I
from ..operators import structure as S
from ..operators.model import SHEET, extents
from ..operators.scratch import materialize, scope
from ..operators.structure import REGION


@dataclass(frozen=True)
class Options:
    profile: str = "v2"
    k: int = 2
    detect_subtables: bool = True
    longest_value: int = C.LONGEST_VALUE
    min_cells: int = 8
    fallback: int = 20


def size_of(x) -> int:
    """Characters of the JSON text, other characters than ASCII as they are."""
    return len(json.dumps(x, ensure_ascii=False))


def _strings_size(items: Column) -> Column:
    total = F.aggregate(F.transform(items, C.json_quoted_size), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(items) == 0, 2).otherwise(2 + 2 * (F.size(items) - 1) + total)


def cells_size(cells: DataFrame, keys: list[str], longest: int | None, skip_blank: bool) -> DataFrame:
    """Size of {reference: text} of the nonblank cells of each sheet or region."""
    some = cells.where(~C.is_blank(F.col("v_str")) if skip_blank else F.col("v_str").isNotNull())
    text = C.shorten(F.col("v_str"), longest) if longest else F.col("v_str")
    total = F.sum(C.json_quoted_size(C.cell_ref(F.col("row"), F.col("col"))) + C.json_quoted_size(text))
    return some.groupBy(*keys).agg(C.json_object_size(F.count("*"), total).alias("size"))


@dataclass
class Encoding:
    """The relations that an encoding is made of."""

    regions: DataFrame
    rows: DataFrame
    cols: DataFrame
    full: DataFrame
    index: DataFrame
    formats: DataFrame
    extents: DataFrame
    options: Options = field(default_factory=Options)


def _copy_merged(cells: DataFrame, full: DataFrame) -> DataFrame:
    """Kept cells that lie in a merged range, with the value of the range's first cell; ranges are matched, not unrolled."""
    starts = cells.where("is_merge_start and v_str is not null").select(*SHEET, F.col("v_str").alias("m_str"), F.col("row").alias("r0"), F.col("col").alias("c0"), F.split("merged_range", ":").alias("ends"))
    last = C.split_ref(F.element_at("ends", -1))
    ranges = starts.select(*SHEET, "m_str", "r0", "c0", last["row"].alias("r1"), C.column_number(last["letters"]).alias("c1"))
    return S.merged_lookup(full.select(*SHEET, "row", "col").distinct(), ranges).select(*SHEET, "row", "col", "m_str")


def build(cells: DataFrame, options: Options = Options()) -> Encoding:
    """The relations of the encoding of every sheet in cells. They are scratch tables; see scratch.scope()."""
    size = materialize(extents(cells), "extents")
    cells = cells.join(size.select(*SHEET), SHEET, "left_semi")
    if options.profile == "v1":
        regions = S.full_regions(cells)
        anchor = {axis: S.header_anchors(cells, axis, options.k) for axis in ("row", "col")}
        drop = S.drop_uniform_lines
    else:
        regions = S.table_regions(cells, options.min_cells) if options.detect_subtables else S.full_regions(cells)
        regions = materialize(regions.select(*REGION, "min_row", "max_row", "min_col", "max_col"), "regions")
        parts = materialize(S.components(S.similar_edges(S.in_regions(cells, regions))), "parts")
        anchor = {axis: S.anchors(cells, regions, axis, options.k, parts) for axis in ("row", "col")}
        drop = S.drop_blank_lines
    anchor = {axis: materialize(df, "anchors") for axis, df in anchor.items()}
    if options.profile == "v1":
        kept = {axis: df.select(*REGION, axis) for axis, df in anchor.items()}
    else:
        kept = S.or_first({axis: S.kept(df, axis, options.k) for axis, df in anchor.items()}, regions, options.fallback)
    before = materialize(S.grid(cells, kept["row"], kept["col"]), "before")
    full = S.grid(cells, drop(before, "row"), drop(before, "col"))
    if options.profile == "v1":
        full = materialize(full, "full")
        full = full.join(_copy_merged(cells, full), [*SHEET, "row", "col"], "left")
    full = materialize(full, "full")
    index = I.value_ranges(*_valued(full, options))
    formats = materialize(I.format_cells(full, copy_merged=options.profile == "v1"), "formats")
    return Encoding(regions, anchor["row"], anchor["col"], full, materialize(index, "index"), formats, size, options)


def _valued(full: DataFrame, options: Options) -> tuple[DataFrame, list[str], int | None, bool]:
    """The cells, keys, longest value and whether blanks are skipped, for an index; v1 takes values as they are, blanks and copies in merged ranges included."""
    if options.profile == "v1":
        return full.withColumn("v_str", F.coalesce("m_str", "v_str")), REGION, None, False
    return full, REGION, options.longest_value, True


def _numeric(e: Encoding, cells: DataFrame) -> DataFrame:
    """Rectangles of numeric formats; where a region has none, those of all numeric cells of its sheet."""
    numeric = e.formats.where("format.kind = 'numeric'")
    none = e.regions.select(*REGION).join(numeric.select(*REGION).distinct(), REGION, "left_anti")
    whole = I.typed(cells).where("kind = 'numeric'").join(none, SHEET)
    # Without a kept numeric format, one group for each number format and semantic type, in row order.
    plain = F.struct(F.lit(None).cast("string").alias("h_align"), F.lit(False).alias("bold"), F.lit(False).alias("merged"), F.lit(None).cast("string").alias("merged_range_of"), "category", "nf", "kind")
    rest = whole.select(*REGION, plain.alias("format"), "row", "col", "semantic")
    return I.format_rectangles(numeric.unionByName(rest))


def entries(e: Encoding, cells: DataFrame) -> DataFrame:
    """The encodings of all files and sheets as rows: file, sheet, region, part (cells, formats or numeric_ranges), name and ranges."""
    name = F.to_json(F.struct(F.col("nf").alias("nfs"), F.col("semantic").alias("type")))
    of = lambda df, part, name: df.select(*REGION, F.lit(part).alias("part"), name.alias("name"), "ranges")
    values = of(e.index, "cells", F.col("value"))
    formats = of(I.format_rectangles(e.formats), "formats", name)
    return values.unionByName(formats).unionByName(of(_numeric(e, cells), "numeric_ranges", name))


def encode(cells: DataFrame, options: Options = Options(), file_name: str | None = None) -> dict:
    """The encoding of one file's sheets as a dict, with sizes and ratios; sheets in the order of the workbook."""
    with scope():
        cells = materialize(cells, "cells")
        files = [r[0] for r in cells.select("file").distinct().limit(2).collect()]
        if len(files) > 1:
            raise ValueError("cells of more than one file: use encode_files()")
        return _encode(build(cells, options), cells, options, file_name)


def encode_files(cells: DataFrame, options: Options = Options()) -> dict[str, dict]:
    """encode() of each file, by its name; for many files take entries()."""
    with scope():
        cells = materialize(cells, "cells")
        names = sorted(r[0] for r in cells.select("file").distinct().collect())
        return {name: encode(cells.where(F.col("file") == name), options, name) for name in names}


def _encode(e: Encoding, cells: DataFrame, options: Options, file_name: str | None) -> dict:
    v1 = options.profile == "v1"
    longest = None if v1 else options.longest_value
    key = lambda r: (r["sheet"], r["region"])
    sheet_no = {r["sheet"]: r["no"] for r in cells.groupBy("sheet").agg(F.min("sheet_no").alias("no")).collect()}
    original = {r["sheet"]: r["size"] for r in cells_size(cells, SHEET, longest, not v1).collect()}
    anchored = {key(r): r["size"] for r in cells_size(e.full, REGION, longest, not v1).collect()}
    refs = F.concat(F.transform("cells", lambda c: C.cell_ref(c["row"], c["col"])), F.coalesce("merged.merged_range", F.array().cast("array<string>")))
    per_value = I.inverted_index(*_valued(e.full, options)).withColumn("refs", refs).groupBy(*REGION).agg(
        C.json_object_size(F.count("*"), F.sum(C.json_quoted_size(F.col("value")) + _strings_size(F.col("refs")))).alias("size")
    )
    indexed = {key(r): r["size"] for r in per_value.collect()}

    def gathered(df: DataFrame, name, order) -> dict:
        out: dict = {}
        for r in sorted(df.collect(), key=order):
            out.setdefault(key(r), {})[name(r)] = list(r["ranges"])
        return out

    values = gathered(e.index, lambda r: r["value"], lambda r: tuple(r["first_seen"]))
    format_name = lambda r: json.dumps({"nfs": r["nf"], "type": r["semantic"]}, sort_keys=True)
    in_order = lambda r: tuple(r["first_seen"])
    formats = gathered(I.format_rectangles(e.formats), format_name, in_order)
    numeric = gathered(_numeric(e, cells), format_name, in_order)
    anchors: dict = {}
    for axis, df in (("row", e.rows), ("col", e.cols)):
        for r in df.collect():
            anchors.setdefault(key(r), {"row": [], "col": []})[axis].append(r[axis])

    sheets: dict = {}
    metrics: dict = {}
    for r in sorted(e.regions.collect(), key=lambda r: (sheet_no[r["sheet"]] or 0, r["sheet"], r["region"])):
        at, sheet = key(r), r["sheet"]
        found = anchors.get(at, {"row": [], "col": []})
        encoding = {} if v1 else {"region": {x: r[x] for x in ("min_row", "max_row", "min_col", "max_col")}}
        encoding |= {
            "structural_anchors": {"rows": sorted(found["row"]), "columns": [R.letters(c) for c in sorted(found["col"])]},
            "cells": values.get(at, {}),
            "formats": formats.get(at, {}),
            "numeric_ranges": numeric.get(at, {}),
        }
        # The names of the sizes and ratios.
        sizes = {
            "original_tokens": original.get(sheet, 2),
            "after_anchor_tokens": anchored.get(at, 2),
            "after_inverted_index_tokens": indexed.get(at, 2),
            "after_merged_index_tokens": size_of(encoding["cells"]),
            "after_format_tokens": size_of(encoding["formats"]),
            "numeric_tokens": size_of(encoding["numeric_ranges"]),
            "final_tokens": size_of(encoding),
        }
        share = {f"{n}_ratio": sizes["original_tokens"] / sizes[x] if sizes[x] else 0 for n, x in (("anchor", "after_anchor_tokens"), ("index", "after_inverted_index_tokens"), ("format", "after_format_tokens"), ("overall", "final_tokens"))}
        if v1:
            sheets[sheet], metrics[sheet] = encoding, sizes | share
        else:
            if sheet not in sheets:
                sheets[sheet], metrics[sheet] = {**encoding, "regions": []}, sizes | share | {"num_regions": 0}
            sheets[sheet]["regions"].append(encoding)
            metrics[sheet]["num_regions"] += 1
    totals = {x: sum(m[x] for m in metrics.values()) for x in ("original_tokens", "after_anchor_tokens", "after_inverted_index_tokens", "after_format_tokens", "final_tokens")}
    totals["overall_ratio"] = totals["original_tokens"] / totals["final_tokens"] if totals["final_tokens"] else 0
    return {"file_name": file_name or "", "sheets": sheets, "compression_metrics": {"sheets": metrics, "overall": totals}}


def readable_text(name: str, encoding: dict, metrics: dict, values: int = 20, ranges: int = 5, formats: int = 10, format_ranges: int = 3) -> str:
    """A sheet's encoding as text for people: head, region, anchors, values and formats, each cut short, with counts of what is left."""

    def some(items: list[str], most: int) -> str:
        rest = len(items) - most
        return ", ".join(items[:most]) + (f" (+{rest} more)" if rest > 0 else "")

    def part(title: str, entries: dict, most: int, each: int, longest: int) -> list[str]:
        lines = [f"  {key[:longest] + '...' if len(key) > longest else key}: {some(at, each)}" for key, at in list(entries.items())[:most]]
        rest = len(entries) - most
        return ["", title, *lines, *([f"  ... and {rest} more"] if rest > 0 else [])]

    anchors = encoding.get("structural_anchors", {})
    lines = ["=" * 60, f"SHEET {name}", f"Compression Ratio: {metrics.get('overall_ratio', 0):.2f}×", "=" * 60]
    if encoding.get("region"):
        r = encoding["region"]
        lines += ["", f"REGION: {R.a1(r['min_row'], r['min_col'], r['max_row'], r['max_col'])}"]
    lines += ["", "STRUCTURAL ANCHORS", f"  Rows: {anchors.get('rows', [])}", f"  Columns: {anchors.get('columns', [])}"]
    lines += part("CELL VALUES", encoding.get("cells", {}), values, ranges, 80)
    return "\n".join(lines + part("FORMAT REGIONS", encoding.get("formats", {}), formats, format_ranges, 80))
