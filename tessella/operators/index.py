"""Inverted index, formats and their ranges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import ranges as R
from . import cover
from .scratch import join_counted, materialize, shuffled
from .structure import REGION, WIDE, islands


def typed(cells: DataFrame, strict: bool = False) -> DataFrame:
    """cells with kind, nf, category and semantic."""
    out = cells.withColumn("kind", C.cell_type(F.col("v_str"), F.col("py_type"), F.col("dtype"))).withColumn("nf", C.number_format(F.col("number_format")))
    out = out.withColumn("category", C.format_category(F.col("nf"), F.col("kind"), strict))
    return out.withColumn("semantic", C.semantic_type(F.col("kind"), F.col("category"), F.col("nf"), F.col("py_type")))


def inverted_index(full: DataFrame, keys: list[str] = REGION, longest: int | None = C.LONGEST_VALUE, skip_blank: bool = True) -> DataFrame:
    """value -> its cells in row order, and the merged ranges that hold it; first_seen orders values as they come."""
    value = C.shorten(F.col("v_str"), longest) if longest else F.col("v_str")
    some = full.where(~C.is_blank(F.col("v_str")) if skip_blank else F.col("v_str").isNotNull())
    at = F.struct("row", "col")
    start = F.col("is_merge_start") & F.lit(skip_blank)
    return some.groupBy(*keys, value.alias("value")).agg(
        F.sort_array(F.collect_list(F.when(~F.coalesce(start, F.lit(False)), at))).alias("cells"),
        F.sort_array(F.collect_list(F.when(start, F.struct("row", "col", "merged_range")))).alias("merged"),
        F.min(at).alias("first_seen"),
    )


def index_ranges(index: DataFrame) -> DataFrame:
    """The inverted index with its cells merged to ranges; blank values are left out."""
    return index.where(~C.is_blank(F.col("value"))).withColumn("ranges", R.merge_refs(F.col("cells"), F.col("merged.merged_range")))


def value_ranges(full: DataFrame, keys: list[str] = REGION, longest: int | None = C.LONGEST_VALUE, skip_blank: bool = True) -> DataFrame:
    """value -> its ranges, merged ones that hold it first, and first_seen, its first cell; the same as index_ranges(inverted_index()), for values with any number of cells."""
    value = C.shorten(F.col("v_str"), longest) if longest else F.col("v_str")
    start = F.coalesce("is_merge_start", F.lit(False)) if skip_blank else F.lit(False)
    some = full.where(~C.is_blank(F.col("v_str"))).select(*keys, value.alias("value"), "row", "col", start.alias("start"), "merged_range")
    covered = cover.refs(cover.cover(some.where("not start"), [*keys, "value"]))
    found = covered.select(*keys, "value", F.lit(1).alias("k"), F.col("r0").alias("row"), F.col("c0").alias("col"), "ref")
    merged = some.where("start").select(*keys, "value", F.lit(0).alias("k"), "row", "col", F.col("merged_range").alias("ref"))
    each = F.array_sort(F.collect_list(F.struct("k", "row", "col", "ref")))
    out = found.unionByName(merged).groupBy(*keys, "value").agg(each.alias("r"), F.min(F.struct("row", "col")).alias("first_seen"))
    return out.where(~C.is_blank(F.col("value"))).select(*keys, "value", F.col("r.ref").alias("ranges"), "first_seen")


def format_key() -> Column:
    """All that makes up a cell's format."""
    return F.struct("h_align", "bold", "merged", "merged_range_of", "category", "nf", "kind")


def format_cells(full: DataFrame, keys: list[str] = REGION, copy_merged: bool = False) -> DataFrame:
    """Each cell of the grid with its format and semantic type."""
    inside = F.col("merged_range").isNotNull() & (F.lit(copy_merged) | F.coalesce("is_merge_start", F.lit(False)))
    marked = typed(full).withColumn("merged", inside).withColumn("merged_range_of", F.when(inside, F.col("merged_range")))
    return marked.select(*keys, format_key().alias("format"), "row", "col", "semantic")


#: Rows of a sheet whose rectangles of one format are put in order together.
_CHUNK = 1 << 12


def format_rectangles(cells: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Cells regrouped by number format and semantic type -> largest rectangles of at most 20 by 20.

    Rectangles begin at the cells in the order of formats (by their first cells),
    then rows. Blocks of rows, between which a group has no cell in a row, are
    independent; each is swept by one task that holds a few rows of it. Only the array
    of a group's ranges is put together in one row, from chunks that are in order.
    """
    at = [*keys, "format"]
    first = F.min(F.col("row").cast("long") * WIDE + F.col("col"))
    seen = materialize(cells.groupBy(*at).agg(first.alias("f"), F.count("*").alias("n")), "formats")
    # As a struct, a group without a number format or semantic type is a key like others.
    of = [*keys, "group"]
    ranked = join_counted(cells, seen, at).select(*keys, F.struct("format.nf", "semantic").alias("group"), "row", "col", "f")
    rows = ranked.groupBy(*of, "row").agg(F.array_sort(F.collect_list(F.struct("col", "f"))).alias("x"))
    rows = materialize(rows.select(*of, "row", F.col("x.col").alias("cols"), F.col("x.f").alias("ranks")), "rows")
    block = islands(rows, "row", of).select(*of, "row", F.col("min_row").alias("block"))
    found = rows.join(shuffled(block), [*of, "row"])
    kinds = dict(found.dtypes)
    schema = f"{', '.join(f'`{k}` {kinds[k]}' for k in of)}, f long, r0 int, c0 int, r1 int, c1 int"

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def lines() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in of]
                columns = [batch.column(c).to_pylist() for c in [*of, "row", "cols", "ranks"]]
                for *key, row, cols, ranks in zip(*columns):
                    yield key, row, cols, ranks

        found = R.swept_rectangles(lines())
        while out := list(islice(found, 10_000)):
            keyed = [pa.array(c, t) for c, t in zip(zip(*(x[0] for x in out)), types)]
            rest = [pa.array(c, t) for c, t in zip(list(zip(*out))[1:], [pa.int64()] + [pa.int32()] * 4)]
            yield pa.RecordBatch.from_arrays([*keyed, *rest], [*of, "f", *cover.BOX])

    boxes = found.repartition(*of, "block").sortWithinPartitions(*of, "block", "row").mapInArrow(swept, schema)
    chunk = F.expr(f"r0 div {_CHUNK}").alias("s")
    chunks = cover.refs(boxes).groupBy(*of, "f", chunk).agg(F.array_sort(F.collect_list(F.struct("r0", "c0", "ref"))).alias("x"))
    begin = F.struct("f", F.col("x")[0]["r0"].alias("row"), F.col("x")[0]["c0"].alias("col"))
    chunks = chunks.select(*of, F.struct("f", "s", F.col("x.ref").alias("refs")).alias("chunk"), begin.alias("begin"))
    out = chunks.groupBy(*of).agg(F.array_sort(F.collect_list("chunk")).alias("c"), F.min("begin").alias("first_seen"))
    return out.select(*keys, "group.nf", "group.semantic", "first_seen", F.flatten("c.refs").alias("ranges"))
