"""Ranges that cover the cells of a value, for values with any number of cells.

The cover is greedy: from the first free cell in row order as wide as possible, then as tall
as the whole width stays free. Going down the rows this is a sweep: a range goes on as long
as its columns are all there in the next row, and what then is left of a row's runs opens new
ranges. So only the open ranges have to be known, never the cells. Rows become runs of
columns, rows alike become bands, and bands are swept in order; where a row has no cell of
the value the sweep begins anew, so these blocks are independent tasks. Nothing holds more
than the runs of one row and the open ranges, but for the arrays of ranges that ranges() ends
with.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from .structure import STRETCH, islands

BOX = ["r0", "c0", "r1", "c1"]


def row_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, and the runs of consecutive columns of its cells as sorted pairs."""
    in_order = Window.partitionBy(*keys, "row").orderBy("col")
    runs = cells.select(*keys, "row", "col").distinct().withColumn("g", F.col("col") - F.row_number().over(in_order))
    runs = runs.groupBy(*keys, "row", "g").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    return runs.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def bands(rows: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """keys, block, r0, r1 and runs: consecutive rows with the same runs, cut at the borders of stretches; a block is a run of rows, named by its first."""
    within = [*keys, "stretch"]
    cut = rows.withColumn("stretch", F.expr(f"row div {stretch}"))
    in_order = Window.partitionBy(*within).orderBy("row")
    begins = F.coalesce((F.lag("row").over(in_order) + 1 != F.col("row")) | (F.lag("runs").over(in_order) != F.col("runs")), F.lit(True))
    cut = cut.withColumn("begins", begins.cast("int")).withColumn("band", F.sum("begins").over(in_order))
    found = cut.groupBy(*within, "band").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min_by("runs", "row").alias("runs"))
    block = islands(rows, "row", keys, stretch).select(*keys, F.col("row").alias("r0"), F.col("min_row").alias("block"))
    return found.join(block, [*keys, "r0"]).select(*keys, "block", "r0", "r1", "runs")


def sweep(rows: Iterator[tuple[tuple, int, int, list[tuple[int, int]]]]) -> Iterator[tuple]:
    """Ranges (key, r0, c0, r1, c1) of bands (key, r0, r1, runs), each key's in the order of rows."""
    now, last, open_ranges = None, 0, {}
    for key, r0, r1, runs in rows:
        if key != now or r0 != last + 1:
            yield from ((now, top, c0, last, c1) for c0, (c1, top) in open_ranges.items())
            now, open_ranges = key, {}
        starts = [a for a, _ in runs]
        going: dict = {}
        for c0, (c1, top) in open_ranges.items():
            at = bisect_right(starts, c0) - 1
            if at >= 0 and c1 <= runs[at][1]:
                going[c0] = (c1, top)
            else:
                yield now, top, c0, last, c1
        taken = sorted(going)
        k = 0
        for a, b in runs:
            free = a
            while k < len(taken) and taken[k] <= b:
                if taken[k] > free:
                    going[free] = (taken[k] - 1, r0)
                free = going[taken[k]][0] + 1
                k += 1
            if free <= b:
                going[free] = (b, r0)
        open_ranges, last = going, r1
    yield from ((now, top, c0, last, c1) for c0, (c1, top) in open_ranges.items())


def cover(cells: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """keys, r0, c0, r1 and c1: disjoint ranges that cover each key's cells (row, col) exactly."""
    found = bands(row_runs(cells, keys), keys, stretch)
    kinds = dict(found.dtypes)
    order = [*keys, "block", "r0"]
    schema = f"{', '.join(f'`{k}` {kinds[k]}' for k in keys)}, r0 int, c0 int, r1 int, c1 int"

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keys]
                columns = [batch.column(c).to_pylist() for c in [*keys, "block", "r0", "r1", "runs"]]
                for *key, block, r0, r1, runs in zip(*columns):
                    yield (*key, block), r0, r1, [(x["a"], x["b"]) for x in runs]

        def batch_of(out: list) -> pa.RecordBatch:
            keyed = [pa.array(c, t) for c, t in zip(zip(*(x[0][:-1] for x in out)), types)]
            return pa.RecordBatch.from_arrays([*keyed, *(pa.array([x[i] for x in out], pa.int32()) for i in range(1, 5))], [*keys, *BOX])

        out: list = []
        for x in sweep(rows()):
            out.append(x)
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return found.repartition(*keys, "block").sortWithinPartitions(*order).mapInArrow(swept, schema)


def refs(box: DataFrame) -> DataFrame:
    """With a column ref: the range in A1 form, one cell as itself."""
    one = (F.col("r0") == F.col("r1")) & (F.col("c0") == F.col("c1"))
    return box.withColumn("ref", F.when(one, C.cell_ref(F.col("r0"), F.col("c0"))).otherwise(F.concat(C.cell_ref(F.col("r0"), F.col("c0")), F.lit(":"), C.cell_ref(F.col("r1"), F.col("c1")))))


def ranges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and the A1 ranges of cover() in row order."""
    found = refs(cover(cells, keys)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r0", "c0", "ref"))).alias("r"))
    return found.select(*keys, F.col("r.ref").alias("ranges"))
