"""Finding structure in sheets: regions, anchors, kept rows and columns.

Every operator works on all sheets of the cell relation together, keyed by file,
sheet and, where there are regions, their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from . import graph
from .model import SHEET, extents
from .scratch import free, join_counted, materialize, shuffled

REGION = [*SHEET, "region"]
#: Columns of one sheet are numbered below this.
WIDE = 1 << 24


def occupancy(cells: DataFrame, axis: str) -> DataFrame:
    """Nonblank cells of each row, or column, of each sheet."""
    return cells.where(~C.is_blank(F.col("v_str"))).groupBy(*SHEET, axis).agg(F.count("*").alias("n"))


#: Indices that one window of islands() and one array of rows_of() hold.
STRETCH = 1 << 16


def islands(indices: DataFrame, axis: str, keys: list[str] = SHEET, stretch: int = STRETCH) -> DataFrame:
    """Each index with the first and last of its run of consecutive ones.

    Runs are found within stretches of the axis. Those that touch a stretch's
    border, two at most of each, are joined with their neighbours, and only they
    are looked at across stretches.
    """
    within = [*keys, "stretch"]
    own = indices.select(*keys, axis).distinct().withColumn("stretch", F.expr(f"{axis} div {stretch}"))
    own = own.withColumn("g", F.col(axis) - F.row_number().over(Window.partitionBy(*within).orderBy(axis)))
    run = Window.partitionBy(*within, "g")
    own = own.withColumn("first", F.min(axis).over(run)).withColumn("last", F.max(axis).over(run))
    touching = (F.col("first") == F.col("stretch") * stretch) | (F.col("last") == F.col("stretch") * stretch + stretch - 1)
    border = own.where(touching).groupBy(*within, "first").agg(F.first("last").alias("last"))
    in_order = Window.partitionBy(*keys).orderBy("first")
    begins = F.coalesce(F.lag("last").over(in_order) + 1 != F.col("first"), F.lit(True)).cast("int")
    chain = Window.partitionBy(*keys, "chain")
    border = border.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(in_order))
    border = border.select(*within, "first", F.min("first").over(chain).alias("from"), F.max("last").over(chain).alias("to"))
    both = own.join(border, [*within, "first"], "left")
    return both.select(*keys, axis, F.coalesce("from", "first").alias(f"min_{axis}"), F.coalesce("to", "last").alias(f"max_{axis}"))


def table_regions(cells: DataFrame, min_cells: int = 8) -> DataFrame:
    """Sub-tables: runs of nonblank rows by runs of nonblank columns with min_cells nonblank cells or more.

    Where no candidate has enough, the box around all nonblank cells. Regions
    are numbered from 0 by area, then first row and first column, all descending.
    """
    full = cells.where(~C.is_blank(F.col("v_str"))).select(*SHEET, "row", "col")
    columns = full.groupBy(*SHEET, "col").agg(F.count("*").alias("n")).join(shuffled(islands(full, "col")), [*SHEET, "col"])
    found = full.join(shuffled(islands(full, "row")), [*SHEET, "row"])
    found = join_counted(found, materialize(columns, "columns"), [*SHEET, "col"])
    box = ["min_row", "max_row", "min_col", "max_col"]
    counted = found.groupBy(*SHEET, *box).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    counted = materialize(counted, "boxes")
    around = full.groupBy(*SHEET).agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count("*").alias("n_cells"))
    rest = around.join(counted.select(*SHEET).distinct(), SHEET, "left_anti")
    area = (F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)
    order = Window.partitionBy(*SHEET).orderBy(F.desc("area"), F.desc("min_row"), F.desc("min_col"))
    regions = counted.unionByName(rest).withColumn("area", area.cast("long")).withColumn("region", F.row_number().over(order) - 1)
    return regions.select(*REGION, *box, "area", "n_cells")


def full_regions(cells: DataFrame) -> DataFrame:
    """Each sheet as one region."""
    return extents(cells).select(*SHEET, F.lit(0).alias("region"), F.lit(1).alias("min_row"), "max_row", F.lit(1).alias("min_col"), "max_col")


def rows_of(regions: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(sheet, row, beside): for each row of a run that regions have, the regions in it, side by side. A row is there once for each run that holds it."""
    beside = F.array_sort(F.collect_list(F.struct("min_col", "max_col", "region")))
    runs = regions.groupBy(*SHEET, "min_row", "max_row").agg(beside.alias("beside"))
    runs = runs.withColumn("s", F.explode(F.expr(f"sequence(min_row div {stretch}, max_row div {stretch})")))
    rows = F.expr(f"sequence(greatest(min_row, s * {stretch}), least(max_row, s * {stretch} + {stretch} - 1))")
    return runs.select(*SHEET, F.explode(rows.cast("array<int>")).alias("row"), "min_row", "max_row", "beside")


def in_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """The cells of each region, with its box.

    Regions are keyed by their rows, and those of one run of rows stand side by
    side there: cells find them by an equi-join on the row, so no more rows are
    made than there are cells, and a cell is compared with the runs of columns
    only.
    """
    found = cells.join(shuffled(rows_of(regions.select(*REGION, "min_row", "max_row", "min_col", "max_col"))), [*SHEET, "row"])
    own = F.filter("beside", lambda x: F.col("col").between(x["min_col"], x["max_col"]))
    return found.withColumn("_r", F.explode(own)).select("*", "_r.region", "_r.min_col", "_r.max_col").drop("beside", "_r")


def _beside(full: DataFrame, line: str, axis: str, stretch: int) -> DataFrame:
    """Each cell of full with the next one along axis, in the same line, if it is a neighbour: its place, and its look as b.

    Windows hold one stretch of a line. A stretch's first cell is also the last of the window before, so no pair is lost at a border.
    """
    at = F.expr(f"{axis} div {stretch}")
    cut = full.withColumn("s", F.explode(F.when(F.col(axis) % stretch == 0, F.array(at - 1, at)).otherwise(F.array(at))))
    after = Window.partitionBy(*REGION, line, "s").orderBy(axis)
    found = cut.select(*REGION, "row", "col", "a", F.col(line).alias(f"to_{line}"), F.lead(axis).over(after).alias(f"to_{axis}"), F.lead("a").over(after).alias("b"))
    return found.where(f"to_{axis} = {axis} + 1").select(*REGION, "row", "col", "a", "to_row", "to_col", "b")


def similar_edges(cells: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Pairs of nonblank neighbours, right and below, that look alike: row, col, to_row, to_col. cells has a region column."""
    look = F.struct("fill", "bold", "has_border", "py_type", "number_format")
    full = cells.where(~C.is_blank(F.col("v_str"))).select(*REGION, "row", "col", look.alias("a"))
    right, down = _beside(full, "row", "col", stretch), _beside(full, "col", "row", stretch)
    return right.unionByName(down).where(C.similar("a", "b")).drop("a", "b")


def components(edges: DataFrame, min_size: int = 4, stretch: int = STRETCH) -> DataFrame:
    """row, col, component (its first cell in row order) and size of the vertices of components with min_size cells or more.

    Cells that look alike one below the other are one vertex, within stretches of
    rows, so that the graph has as many vertices as there are such runs: its
    rounds don't carry tall columns, and no window holds a whole one. An edge
    over a stretch's border stays an edge. A run's first cell is its smallest,
    so components keep their names.
    """
    edges = materialize(edges.select(*REGION, "row", "col", "to_row", "to_col"), "neighbours")
    number = lambda r, c: F.col(r).cast("long") * WIDE + F.col(c)
    within = F.expr(f"col = to_col and to_row = row + 1 and row div {stretch} = to_row div {stretch}")
    at = [*REGION, "col", "s"]
    below = edges.where(within).withColumn("s", F.expr(f"row div {stretch}"))
    island = F.col("row") - F.dense_rank().over(Window.partitionBy(*at).orderBy("row"))
    runs = below.withColumn("i", island).groupBy(*at, "i").agg(F.min("row").alias("first"), F.max("to_row").alias("last"))
    runs = materialize(runs.select(*REGION, number("first", "col").alias("id"), "col", "first", "last"), "runs")
    member = F.explode(F.sequence("first", "last")).alias("row")
    members = runs.select(*REGION, "id", "col", member).select(*REGION, "id", number("row", "col").alias("cell"))
    rest = edges.where(~within).select(*REGION, number("row", "col").alias("u"), number("to_row", "to_col").alias("v"))
    for end in ("u", "v"):
        rest = rest.join(shuffled(members.withColumnsRenamed({"id": "run", "cell": end})), [*REGION, end], "left").withColumn(end, F.coalesce("run", end)).drop("run")
    found = materialize(graph.components(rest, REGION), "components")
    place = [F.expr(f"cast(id % {WIDE} as int)").alias("col"), *(F.expr(f"cast(id div {WIDE} as int)").alias(x) for x in ("first", "last"))]
    single = found.join(shuffled(runs), [*REGION, "id"], "left_anti").select(*REGION, "id", *place)
    named = runs.unionByName(single).join(shuffled(found), [*REGION, "id"], "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named, "named")
    free(edges, runs, found)
    sizes = named.groupBy(*REGION, "component").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("size"))
    large = join_counted(named, materialize(sizes.where(F.col("size") >= min_size), "sizes"), [*REGION, "component"])
    return large.select(*REGION, member, "col", "component", "size")


def component_boxes(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*REGION, "component").agg(*(f(x).alias(f"{n}_{x}") for x in ("row", "col") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("size"))


def expand(indices: DataFrame, axis: str, k: int, low: str, high: str) -> DataFrame:
    """Each index with its k neighbours on either side, within low..high, each once."""
    around = F.explode(F.sequence(F.greatest(F.col(axis) - k, F.col(low)), F.least(F.col(axis) + k, F.col(high))))
    return indices.where(f"{axis} + {k} >= {low} and {axis} - {k} <= {high}").select(*REGION, low, high, around.alias(axis)).distinct()


def anchors(cells: DataFrame, regions: DataFrame, axis: str, k: int = 2, parts: DataFrame | None = None) -> DataFrame:
    """Rows (or columns) at the edges of look-alike components, with k neighbours; the region's own edges where there are no components."""
    low, high = f"min_{axis}", f"max_{axis}"
    parts = components(similar_edges(in_regions(cells, regions))) if parts is None else parts
    edges = component_boxes(parts).select(*REGION, F.explode(F.array(low, high)).alias(axis)).distinct()
    edges = materialize(edges, "edges")
    counted = regions.select(*REGION, low, high).join(shuffled(edges.groupBy(*REGION).agg(F.count("*").alias("n"))), REGION)
    counted = materialize(counted, "anchored")
    spread = expand(join_counted(edges, counted, REGION), axis, k, low, high)
    none = regions.join(shuffled(counted.select(*REGION)), REGION, "left_anti").select(*REGION, low, high, F.explode(F.array_distinct(F.array(low, high))).alias(axis))
    return spread.unionByName(none)


def header_anchors(cells: DataFrame, axis: str, k: int = 2) -> DataFrame:
    """Anchors of the plain profile, for each whole sheet.

    Rows: those of the first 21 whose populated cells (of the first 21 columns)
    are mostly texts, else row 1. Columns: the first 10 with something in the
    first 50 rows, else the first 5. Each with k neighbours.
    """
    sheets = full_regions(cells)
    full = cells.where(~C.is_blank(F.col("v_str")))
    low, high = f"min_{axis}", f"max_{axis}"
    if axis == "row":
        counted = full.where("row <= 21 and col <= 21").groupBy(*SHEET, "row").agg((F.count_if(F.col("py_type") == "str") / F.count("*")).alias("share"))
        found = counted.where("share > 0.5").select(*SHEET, "row")
        first = F.array(F.lit(1))
    else:
        found = full.where("row <= 50").select(*SHEET, "col").distinct()
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))).where("n <= 10").drop("n")
        first = F.sequence(F.lit(1), F.least(F.lit(5), F.col(high)))
    none = sheets.join(found, SHEET, "left_anti").select(*REGION, low, high, F.explode(first).alias(axis))
    return expand(sheets.join(found, SHEET).select(*REGION, low, high, axis).unionByName(none), axis, k, low, high)


def kept(anchor: DataFrame, axis: str, k: int) -> DataFrame:
    """Anchors with k neighbours again, within the region."""
    return expand(anchor, axis, k, f"min_{axis}", f"max_{axis}").select(*REGION, axis)


def or_first(kept: dict[str, DataFrame], regions: DataFrame, most: int) -> dict[str, DataFrame]:
    """kept by axis; a region that has no kept rows or no kept columns gets its first rows and columns, most of each."""
    full = kept["row"].select(*REGION).distinct().join(kept["col"].select(*REGION).distinct(), REGION, "left_semi")
    none = regions.join(full, REGION, "left_anti")
    out = {}
    for axis, df in kept.items():
        low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
        first = none.select(*REGION, F.explode(F.sequence(low, F.least(low + most - 1, high))).alias(axis))
        out[axis] = df.join(full, REGION, "left_semi").unionByName(first)
    return out


def grid(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every kept row by every kept column, with the cell there or nulls: empty cells have formats too."""
    full = rows.join(cols, REGION).join(cells, [*SHEET, "row", "col"], "left")
    return full.withColumns({x: F.coalesce(x, F.lit(v)) for x, v in (("bold", False), ("has_border", False), ("fill", "none"), ("is_merge_start", False))})


def drop_blank_lines(full: DataFrame, axis: str) -> DataFrame:
    """Kept indices along axis that have something; the first of them where none has."""
    some = full.groupBy(*REGION, axis).agg(F.max((~C.is_blank(F.col("v_str"))).cast("int")).alias("some"))
    whole = Window.partitionBy(*REGION)
    return some.select("*", F.max("some").over(whole).alias("any"), F.min(axis).over(whole).alias("first")).where(f"some = 1 or (any = 0 and {axis} = first)").select(*REGION, axis)


def drop_uniform_lines(full: DataFrame, axis: str) -> DataFrame:
    """Kept indices along axis whose values, or formats, are not all the same; null is a value, and 1, 1.0 and true are one."""
    number = F.when(F.col("py_type") == "bool", F.when(F.lower("v_str") == "true", 1.0).otherwise(0.0)).when(F.col("py_type").isin("int", "float"), F.col("v_str").try_cast("double"))
    value = F.struct(number.alias("x"), F.when(number.isNull(), F.col("v_str")).alias("s"), F.when(number.isNull(), F.col("py_type")).alias("t"))
    kinds = full.groupBy(*REGION, axis).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.min(C.number_format(F.col("number_format"))).alias("f"), F.max(C.number_format(F.col("number_format"))).alias("g"))
    return kinds.where("not (a <=> b and f <=> g)").select(*REGION, axis)


#: Rows of one cell of the grid in which ranges are looked up.
_TALL = 256


def merged_lookup(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The merged range (r0, c0, r1, c1 of ranges) that each cell lies in: an equi-join on the sheet and strips of rows, then a test."""
    strip = F.explode(F.sequence(F.floor(F.col("r0") / _TALL), F.floor(F.col("r1") / _TALL))).alias("_strip")
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return cells.withColumn("_strip", F.floor(F.col("row") / _TALL)).join(ranges.select("*", strip), [*SHEET, "_strip"]).where(inside).drop("_strip")
