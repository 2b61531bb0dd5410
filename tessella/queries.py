"""A query for each operator over the test tables, and the same in SQL.

Tables have no blanks, formats, Chinese or spreadsheets, so these are built from
keys by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .operators import cover
from .operators import index as I
from .operators import profile as P
from .operators import structure as S
from .operators import tidy
from .operators.model import SHEET, cells_from_table
from .operators.scratch import materialize
from .operators.tidy import ROW
from .plans.plan import Plan
from .plans.validate import validate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- cells -------------------------------------------------------------------

NATION = """
SELECT 1 AS row, c.col, c.v AS v_str FROM (VALUES (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) c(col, v)
UNION ALL SELECT n_nationkey + 2, 1, CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT n_nationkey + 2, 2, n_name FROM nation
UNION ALL SELECT n_nationkey + 2, 3, CAST(n_regionkey AS VARCHAR) FROM nation
"""


def nation_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_from_table(table(spark, sf, "nation").withColumn(ROW, F.col("n_nationkey") + 1), ROW)


@query(NATION)
def cells_long(spark, sf):
    return nation_cells(spark, sf).select("row", "col", "v_str")


@query(f"SELECT v_str AS value, COUNT(*) AS n, MIN(row) AS min_row, MAX(row) AS max_row FROM ({NATION}) GROUP BY v_str")
def inverted_index(spark, sf):
    found = I.inverted_index(nation_cells(spark, sf), SHEET)
    rows = F.transform("cells", lambda c: c["row"])
    return found.select("value", F.size("cells").cast("long").alias("n"), F.array_min(rows).alias("min_row"), F.array_max(rows).alias("max_row"))


@query(f"""
WITH c AS (SELECT DISTINCT v_str AS v, row, col FROM ({NATION})),
g AS (SELECT v, col, row, row - ROW_NUMBER() OVER (PARTITION BY v, col ORDER BY row) AS k FROM c),
r AS (SELECT v, col, MIN(row) AS a, MAX(row) AS b FROM g GROUP BY v, col, k)
SELECT v AS value, STRING_AGG(chr(CAST(64 + col AS INT)) || a ||
    CASE WHEN b > a THEN ':' || chr(CAST(64 + col AS INT)) || b ELSE '' END, ', ' ORDER BY a, col) AS ranges
FROM r GROUP BY v
""")
def value_ranges(spark, sf):
    """Ranges of all values of nation. Columns that can share a value aren't neighbours, so SQL needs no ranges across columns."""
    found = I.value_ranges(nation_cells(spark, sf), SHEET)
    return found.select("value", F.array_join("ranges", ", ").alias("ranges"))


EMAIL_SQL = C.EMAIL.replace("\\n?", "")


@query(rf"""
SELECT doc_id, COUNT(*) AS n_emails, MIN(t) AS first_email FROM (SELECT doc_id, UNNEST(regexp_split_to_array(text, '[ \n]')) AS t FROM documents)
WHERE regexp_matches(t, '{EMAIL_SQL}') GROUP BY doc_id
""")
def email_cells(spark, sf):
    token = F.explode(F.split("text", "[ \n]")).alias("t")
    found = table(spark, sf, "documents").select("doc_id", token).where(C.is_email(F.col("t")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_emails"), F.min("t").alias("first_email"))


FORMATS = ["General", "@", "$#,##0.00", "0%", "0.00E+00", "# ?/?", "yyyy-mm-dd", "yyyy", "h:mm", "0", "#,##0.00", "[Red]0.000", "#,##0;[Red]#,##0", "0.0"]
CATEGORY_SQL = """
CASE WHEN kind NOT IN ('numeric', 'datetime') THEN 'not_applicable'
WHEN lower(nf) = 'general' THEN CASE WHEN kind = 'datetime' THEN 'datetime_general' ELSE 'general' END
WHEN nf = '@' THEN 'text_format' WHEN regexp_matches(nf, '[$€£¥]') THEN 'currency' WHEN contains(nf, '%') THEN 'percentage'
WHEN regexp_matches(lower(nf), 'e[+-]') THEN 'scientific' WHEN contains(nf, '#') AND contains(nf, '/') AND contains(nf, '?') THEN 'fraction'
WHEN regexp_matches(lower(nf), 'yy|mm|d') AND (regexp_matches(lower(nf), 'h|s|a/p') OR contains(nf, ':')) THEN 'datetime_custom'
WHEN regexp_matches(lower(nf), 'yy|mm|d') THEN 'date_custom' WHEN regexp_matches(lower(nf), 'h|s|a/p') OR contains(nf, ':') THEN 'time_custom'
WHEN kind = 'numeric' THEN
    CASE WHEN nf IN ('0', '#,##0') THEN 'integer' WHEN nf IN ('0.00', '#,##0.00', '0.0', '#,##0.0') THEN 'float' ELSE 'other_numeric' END
ELSE 'other_date' END"""
FORMAT_ROWS_SQL = f"""
SELECT *, {CATEGORY_SQL} AS category FROM (SELECT list_extract([{', '.join(f"'{f}'" for f in FORMATS)}], CAST(l_orderkey % {len(FORMATS)} AS INT) + 1) AS nf,
CASE l_linenumber % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'datetime' ELSE 'numeric' END AS kind,
CASE l_linenumber % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'datetime' WHEN 2 THEN 'int' ELSE 'float' END AS py FROM lineitem)"""


def _format_rows(spark, sf) -> DataFrame:
    n = F.pmod(F.col("l_linenumber"), F.lit(4))
    nf = F.element_at(F.array(*map(F.lit, FORMATS)), F.pmod("l_orderkey", F.lit(len(FORMATS))).cast("int") + 1)
    dtype = F.when(n == 0, "s").when(n == 1, "d").otherwise("n")
    py = F.when(n == 0, "str").when(n == 1, "datetime").when(n == 2, "int").otherwise("float")
    # A table has many cells and few kinds of them: these are counted first, and typed then.
    rows = table(spark, sf, "lineitem").groupBy(nf.alias("nf"), dtype.alias("dtype"), py.alias("py")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("kind", C.cell_type(F.lit("x"), F.col("py"), F.col("dtype")))
    return rows.withColumn("category", C.format_category(C.number_format(F.col("nf")), F.col("kind")))


@query(f"SELECT nf, kind, category, COUNT(*) AS n FROM ({FORMAT_ROWS_SQL}) GROUP BY nf, kind, category")
def number_format_category(spark, sf):
    return _format_rows(spark, sf).groupBy("nf", "kind", "category").agg(F.sum("n").alias("n"))


@query(f"""
SELECT nf, kind, py, CASE WHEN category IN ('percentage', 'currency') THEN category
WHEN category IN ('date_custom', 'datetime_custom', 'datetime_general', 'other_date') THEN
    CASE WHEN contains(lower(nf), 'yy') AND NOT regexp_matches(lower(nf), '[md]') THEN 'year' ELSE 'date' END
WHEN category = 'time_custom' THEN 'time' WHEN category = 'scientific' THEN 'scientific_notation'
WHEN kind = 'numeric' AND (py = 'int' OR category = 'integer') THEN 'integer' WHEN kind = 'numeric' AND (py = 'float' OR category = 'float') THEN 'float' ELSE kind END AS semantic,
COUNT(*) AS n FROM ({FORMAT_ROWS_SQL}) GROUP BY ALL""")
def semantic_type(spark, sf):
    rows = _format_rows(spark, sf).withColumn("semantic", C.semantic_type(F.col("kind"), F.col("category"), F.col("nf"), F.col("py")))
    return rows.groupBy("nf", "kind", "py", "semantic").agg(F.sum("n").alias("n"))


@query(rf"""
SELECT kind, COUNT(*) AS n, MIN(coalesce(v, '')) AS first FROM (SELECT *,
    CASE WHEN v IS NULL THEN 'empty' WHEN py = 'str' AND regexp_matches(v, '{EMAIL_SQL}') THEN 'email' WHEN dtype = 's' THEN 'text'
WHEN dtype = 'n' THEN 'numeric' WHEN dtype = 'b' THEN 'boolean' WHEN dtype = 'd' THEN 'datetime' WHEN dtype = 'e' THEN 'error'
WHEN dtype = 'f' THEN
    CASE WHEN py = 'str' THEN 'text' WHEN py IN ('int', 'float', 'bool') THEN 'numeric' ELSE 'formula_cached_value' END ELSE 'unknown' END AS kind
FROM (SELECT CASE event_id % 9 WHEN 0 THEN
    CASE WHEN value > 0.5 THEN event_type END WHEN 1 THEN event_type || '@' || user_id || '.org' WHEN 2 THEN props WHEN 3 THEN CAST(user_id AS VARCHAR) WHEN 4 THEN 'True'
WHEN 5 THEN strftime(ts, '%Y-%m-%d') WHEN 6 THEN '#N/A' WHEN 7 THEN CAST(user_id AS VARCHAR) ELSE event_type || '@x' END AS v,
list_extract(['str', 'str', 'str', 'int', 'bool', 'datetime', 'str', 'int', 'time'], CAST(event_id % 9 AS INT) + 1) AS py, list_extract(['s', 's', 'f', 'n', 'b', 'd', 'e', 'f', 'x'], CAST(event_id % 9 AS INT) + 1) AS dtype
    FROM events)) GROUP BY kind
""")
def cell_types(spark, sf):
    """Types of cells whose texts come from the table, nulls and addresses among them."""
    k = F.pmod("event_id", F.lit(9)).cast("int") + 1
    of = lambda *x: F.element_at(F.array(*x), k)
    user = F.col("user_id").cast("string")
    value = of(
        F.when(F.col("value") > 0.5, F.col("event_type")), F.concat("event_type", F.lit("@"), user, F.lit(".org")), F.col("props"), user, F.lit("True"),
        F.date_format("ts", "yyyy-MM-dd"), F.lit("#N/A"), user, F.concat("event_type", F.lit("@x")),
    )
    py, dtype = of(*map(F.lit, ("str", "str", "str", "int", "bool", "datetime", "str", "int", "time"))), of(*map(F.lit, "ssfnbdefx"))
    rows = table(spark, sf, "events").select(value.alias("v"), C.cell_type(value, py, dtype).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.coalesce("v", F.lit(""))).alias("first"))


LETTERS_SQL = """CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26)
ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) // 26) % 26) || chr(65 + (n - 1) % 26) END"""


@query(f"SELECT o_orderkey, {LETTERS_SQL} AS letters, n AS number FROM (SELECT o_orderkey, CAST(o_orderkey % 16384 + 1 AS INT) AS n FROM orders)")
def column_letters(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", C.column_letters(F.col("o_orderkey") % 16384 + 1).alias("letters"))
    return rows.withColumn("number", C.column_number(F.col("letters")))


@query(f"SELECT p_partkey, row, {LETTERS_SQL} AS letters FROM (SELECT p_partkey, CAST(p_partkey % 500 AS INT) + 1 AS row, CAST(p_partkey * 7 % 16384 + 1 AS INT) AS n FROM part)")
def split_cell_ref(spark, sf):
    ref = C.split_ref(C.cell_ref(F.pmod("p_partkey", F.lit(500)).cast("int") + 1, F.col("p_partkey") * 7 % 16384 + 1))
    return table(spark, sf, "part").select("p_partkey", ref["row"].alias("row"), ref["letters"].alias("letters"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS value FROM documents")
def stringify_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.shorten(F.col("text")).alias("value"))


@query("""
SELECT COUNT(*) AS n, CAST(2 + 2 * (COUNT(*) - 1) + 2 * COUNT(*) + SUM(length(chr(CAST(64 + col AS INT)) || row) + 2 + length(v_str) + 2) AS BIGINT) AS size
    FROM (%s)
""" % NATION)
def json_size(spark, sf):
    c = nation_cells(spark, sf)
    total = F.sum(C.json_quoted_size(C.cell_ref(F.col("row"), F.col("col"))) + C.json_quoted_size(F.col("v_str")))
    return c.agg(F.count("*").alias("n"), C.json_object_size(F.count("*"), total).alias("size"))


# --- structure ---------------------------------------------------------------

#: A grid of part: rows by key, four columns, every tenth row and every cell by a pattern blank.
PART_GRID_SQL = """
SELECT CAST(p_partkey AS INT) AS row, c.col, CASE c.col WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS v,
    CASE WHEN c.col = 3 THEN 'int' ELSE 'str' END AS py
FROM part, (VALUES (1), (2), (3), (5)) c(col) WHERE p_partkey % 10 <> 0 AND (p_partkey + c.col) % 7 <> 0
"""


def part_grid(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    of = lambda col, v, py: F.struct(F.lit(col).alias("col"), F.lit(py).alias("py_type"), F.col(v).cast("string").alias("v_str"))
    each = F.explode(F.array(of(1, "p_brand", "str"), of(2, "p_type", "str"), of(3, "p_size", "int"), of(5, "p_name", "str")))
    cells = p.select(F.col("p_partkey").cast("int").alias("row"), "p_partkey", each.alias("c")).select("row", "p_partkey", "c.*")
    cells = cells.where("p_partkey % 10 <> 0 and (p_partkey + col) % 7 <> 0")
    fixed = {"file": "part", "sheet": "s", "number_format": "General", "fill": "none"}
    cells = cells.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"bold": F.pmod("row", F.lit(5)) == 0, "has_border": F.lit(False), "dtype": F.when(F.col("py_type") == "int", "n").otherwise("s")})
    return cells.withColumns({"h_align": F.lit(None).cast("string"), "merged_range": F.lit(None).cast("string"), "is_merge_start": F.lit(False)}).drop("p_partkey")


@query(f"SELECT row, COUNT(*) AS n FROM ({PART_GRID_SQL}) GROUP BY row")
def nonblank_counts(spark, sf):
    return S.occupancy(part_grid(spark, sf), "row").select("row", "n")


REGIONS_SQL = f"""
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY (max_row - min_row + 1) * (max_col - min_col + 1) DESC, min_row DESC, min_col DESC) - 1 AS INT) AS region
    FROM (
WITH c AS ({PART_GRID_SQL}), r AS (SELECT row, row - ROW_NUMBER() OVER (ORDER BY row) AS g FROM (SELECT DISTINCT row FROM c)),
k AS (SELECT col, col - ROW_NUMBER() OVER (ORDER BY col) AS g FROM (SELECT DISTINCT col FROM c)),
ri AS (SELECT row, MIN(row) OVER (PARTITION BY g) AS a, MAX(row) OVER (PARTITION BY g) AS b
    FROM r), ki AS (SELECT col, MIN(col) OVER (PARTITION BY g) AS a, MAX(col) OVER (PARTITION BY g) AS b FROM k)
SELECT ri.a AS min_row, ri.b AS max_row, ki.a AS min_col, ki.b AS max_col, COUNT(*) AS n_cells FROM c JOIN ri USING (row) JOIN ki USING (col) GROUP BY ALL HAVING COUNT(*) >= 8)"""


@query(REGIONS_SQL)
def table_regions(spark, sf):
    return S.table_regions(part_grid(spark, sf)).select("region", "min_row", "max_row", "min_col", "max_col", "n_cells")


@query(f"""
WITH c AS ({PART_GRID_SQL}), h AS (SELECT row FROM c WHERE row <= 21 AND col <= 21
    GROUP BY row HAVING COUNT(*) FILTER (WHERE py = 'str') / COUNT(*) > 0.5), m AS (SELECT MAX(row) AS m FROM c)
SELECT DISTINCT CAST(r AS INT) AS row FROM (SELECT UNNEST(generate_series(greatest(row - 2, 1), least(row + 2, m))) AS r FROM h, m)
""")
def header_rows_v1(spark, sf):
    return S.header_anchors(part_grid(spark, sf), "row").select("row")


@query(f"""
WITH c AS ({PART_GRID_SQL}), h AS (SELECT col FROM c WHERE row <= 50 GROUP BY col ORDER BY col LIMIT 10), m AS (SELECT MAX(col) AS m FROM c)
SELECT DISTINCT CAST(r AS INT) AS col FROM (SELECT UNNEST(generate_series(greatest(col - 2, 1), least(col + 2, m))) AS r FROM h, m)
""")
def header_cols_v1(spark, sf):
    return S.header_anchors(part_grid(spark, sf), "col").select("col")


@query("""
SELECT DISTINCT CAST(r AS INT) AS row FROM (SELECT UNNEST(generate_series(greatest(p_partkey - 2, 5), least(p_partkey + 2, (SELECT MAX(p_partkey)
    FROM part)))) AS r FROM part WHERE p_partkey % 13 = 0)
""")
def k_neighborhood(spark, sf):
    """Neighbours of every thirteenth row, the anchors, in a region from row 5 to the table's last row."""
    p = table(spark, sf, "part")
    at = p.where("p_partkey % 13 = 0").select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.lit(0).alias("region"), F.col("p_partkey").cast("int").alias("row"), F.lit(5).alias("min_row"))
    at = at.crossJoin(F.broadcast(p.agg(F.max("p_partkey").cast("int").alias("max_row"))))
    return S.expand(at, "row", 2, "min_row", "max_row").select("row")


def _grid(spark, sf) -> DataFrame:
    """The grid of all rows and columns, blank cells as nulls, constant in every fourth row."""
    p = table(spark, sf, "part")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), v.alias("v_str")) for i, v in ((1, F.col("p_brand")), (2, F.col("p_type")), (3, F.col("p_size").cast("string"))))))
    rows = p.select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.lit(0).alias("region"), F.col("p_partkey").cast("int").alias("row"), each.alias("c")).select("file", "sheet", "region", "row", "c.*")
    value = F.when(F.col("row") % 6 == 0, None).when(F.col("row") % 4 == 0, "x").otherwise(F.col("v_str"))
    return rows.withColumn("v_str", value).withColumns({"py_type": F.lit("str"), "number_format": F.lit("General")})


GRID_SQL = """
SELECT CAST(p_partkey AS INT) AS row, c.col,
    CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'x' ELSE CASE c.col WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE CAST(p_size AS VARCHAR) END END AS v
FROM part, (VALUES (1), (2), (3)) c(col)"""


@query(f"SELECT row FROM ({GRID_SQL}) GROUP BY row HAVING COUNT(DISTINCT coalesce(v, '\x01')) > 1")
def homogeneous_rows(spark, sf):
    return S.drop_uniform_lines(_grid(spark, sf), "row").select("row")


@query(f"SELECT row FROM ({GRID_SQL}) GROUP BY row HAVING COUNT(v) > 0")
def blank_rows(spark, sf):
    return S.drop_blank_lines(_grid(spark, sf), "row").select("row")


@query(f"SELECT CAST(col AS INT) AS col FROM ({GRID_SQL}) GROUP BY col HAVING COUNT(DISTINCT coalesce(v, '\x01')) > 1")
def homogeneous_cols(spark, sf):
    return S.drop_uniform_lines(_grid(spark, sf), "col").select("col")


@query("""
WITH g AS (SELECT p_type, p_partkey, p_partkey - ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k
    FROM part), r AS (SELECT p_type, MIN(p_partkey) AS a, MAX(p_partkey) AS b FROM g GROUP BY p_type, k)
SELECT p_type AS value, COUNT(*) AS n_ranges, STRING_AGG('A' || a || CASE WHEN b > a THEN ':A' || b ELSE '' END, ', ' ORDER BY a) AS ranges FROM r
    GROUP BY p_type
""")
def merge_refs_vertical(spark, sf):
    cells = table(spark, sf, "part").select(F.col("p_type").alias("value"), F.col("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"))
    return cover.ranges(cells, ["value"]).select("value", F.size("ranges").cast("long").alias("n_ranges"), F.array_join("ranges", ", ").alias("ranges"))


@query()
def format_rectangles(spark, sf):
    full = part_grid(spark, sf).withColumn("region", F.lit(0))
    return I.format_rectangles(I.format_cells(full)).select("nf", "semantic", F.array_join("ranges", ", ").alias("ranges"))


EDGES_SQL = f"""
WITH c AS ({PART_GRID_SQL})
SELECT a.row, a.col, b.row AS to_row, b.col AS to_col FROM c a
    JOIN c b ON (b.row = a.row AND b.col = a.col + 1 OR b.row = a.row + 1 AND b.col = a.col)
WHERE ((a.row % 5 = 0) <> (b.row % 5 = 0))::INT + (a.py <> b.py)::INT <= 1"""


def _edges(spark, sf) -> DataFrame:
    return S.similar_edges(part_grid(spark, sf).withColumn("region", F.lit(0)))


@query(EDGES_SQL)
def similar_edges(spark, sf):
    return _edges(spark, sf).select("row", "col", "to_row", "to_col")


COMPONENTS_SQL = f"""
RECURSIVE e AS ({EDGES_SQL}), b AS (SELECT row * 100 + col AS u, to_row * 100 + to_col AS v FROM e
    UNION ALL SELECT to_row * 100 + to_col, row * 100 + col FROM e),
r(u, v) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u), m AS (SELECT u, MIN(v) AS c FROM r GROUP BY u), s AS (SELECT c, COUNT(*) AS n FROM m GROUP BY c HAVING COUNT(*) >= 4)"""


@query(f"""
WITH {COMPONENTS_SQL}
SELECT CAST(m.u // 100 AS INT) AS row, CAST(m.u % 100 AS INT) AS col, CAST(s.c // 100 AS INT) AS first_row, CAST(s.c % 100 AS INT) AS first_col, s.n AS size
    FROM m JOIN s USING (c)
""")
def components(spark, sf):
    found = S.components(_edges(spark, sf))
    return found.select("row", "col", F.expr("cast(component div 16777216 as int)").alias("first_row"), F.expr("cast(component % 16777216 as int)").alias("first_col"), "size")


@query(f"""
WITH c AS ({PART_GRID_SQL}), r AS (SELECT 'r' || p_partkey AS name, p_partkey AS r0, p_partkey + p_size AS r1, CAST(p_partkey % 3 AS INT) + 1 AS c0, CAST(p_partkey % 3 AS INT) + 2 AS c1
    FROM part WHERE p_partkey % 50 = 0)
SELECT c.row, c.col, r.name FROM c JOIN r ON c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1
""")
def merged_range_lookup(spark, sf):
    key, first = F.col("p_partkey").cast("int"), (F.col("p_partkey") % 3 + 1).cast("int")
    ranges = table(spark, sf, "part").where("p_partkey % 50 = 0").select(
        F.lit("part").alias("file"), F.lit("s").alias("sheet"), F.concat(F.lit("r"), key).alias("name"), key.alias("r0"), first.alias("c0"), (key + F.col("p_size")).alias("r1"), (first + 1).alias("c1")
    )
    return S.merged_lookup(part_grid(spark, sf), ranges).select("row", "col", "name")


@query(f"""
WITH {COMPONENTS_SQL}, g AS ({REGIONS_SQL}), x AS (SELECT s.c, MIN(m.u // 100) AS lo, MAX(m.u // 100) AS hi, MIN(m.u % 100) AS col FROM m
    JOIN s USING (c) GROUP BY s.c),
h AS (SELECT region, min_row, max_row, UNNEST([lo, hi]) AS k FROM x JOIN g ON lo BETWEEN min_row AND max_row AND col BETWEEN min_col AND max_col)
SELECT DISTINCT region, CAST(k AS INT) AS row FROM (SELECT region, UNNEST(generate_series(greatest(k - 2, min_row), least(k + 2, max_row))) AS k
    FROM h
UNION ALL SELECT region, UNNEST([min_row, max_row]) FROM g WHERE region NOT IN (SELECT region FROM h))
""")
def structural_anchors_v2(spark, sf):
    cells = part_grid(spark, sf)
    regions = materialize(S.table_regions(cells), "regions")
    return S.anchors(cells, regions, "row").select("region", "row")


# --- profiles ----------------------------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _gaps(spark, sf) -> DataFrame:
    """orders with the customer missing in every seventh row."""
    return table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({x}) AS n_null, round((COUNT(*) - COUNT({x})) * 100.0 / COUNT(*), 6) AS null_pct FROM orders" for c, x in ((c, "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END" if c == "o_custkey" else c) for c in ORDERS)))
def profile_nulls(spark, sf):
    return P.nulls(_gaps(spark, sf)).withColumn("null_pct", F.round("null_pct", 6))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def profile_distinct(spark, sf):
    counts = P.value_counts(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return counts.groupBy("column").agg(F.count("*").alias("n_distinct"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, round(AVG({c}), 6) AS mean, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in ("l_quantity", "l_tax", "l_linenumber")))
def profile_stats(spark, sf):
    found = P.statistics(table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_linenumber"))
    return found.select("column", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std")))


COUNTED = {"o_orderstatus": "o_orderstatus", "k73": "o_orderkey % 91 % 73", "k101": "o_orderkey % 101", "o_custkey": "o_custkey"}


@query(f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", CAST({x} AS VARCHAR) AS value, o_orderkey AS r FROM orders" for c, x in COUNTED.items())}),
g AS (SELECT "column", value, COUNT(*) AS n, MIN(r) AS first_row FROM c
    GROUP BY ALL), d AS (SELECT *, COUNT(*) OVER (PARTITION BY "column") AS d, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, first_row, value) AS k
    FROM g)
SELECT "column", value, n, first_row FROM d WHERE d <= 100 AND k <= 50
""")
def value_counts_top50(spark, sf):
    """Columns of three and 73 values, and of 101 and more, which have too many."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), *(F.expr(x).alias(c) for c, x in COUNTED.items()))
    return P.top_values(P.value_counts(rows, ROW)).select("column", "value", "n", "first_row")


@query("""
SELECT "column", list_aggregate("values", 'string_agg', ',') AS "values", n > 5 AS truncated
    FROM (SELECT "column", list(v ORDER BY f)[1:5] AS "values", COUNT(*) AS n FROM (
SELECT 'p_type' AS "column", p_type AS v, MIN(p_partkey) AS f FROM part GROUP BY p_type UNION ALL SELECT 'p_brand', p_brand, MIN(p_partkey) FROM part
    GROUP BY p_brand) GROUP BY "column")
""")
def unique_values(spark, sf):
    counts = P.value_counts(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    return P.unique_values(counts, 5).select("column", F.array_join("values", ",").alias("values"), "truncated")


#: Columns, their family and their SQL.
TYPED = {
    "o_orderkey": ("integer", "o_orderkey"), "o_totalprice": ("numeric", "o_totalprice"), "o_orderstatus": ("other", "o_orderstatus"), "o_orderpriority": ("other", "o_orderpriority"),
    "year": ("integer", "year(o_orderdate)"), "flag": ("other", "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no ' END"),
    "flag_na": ("other", "CASE o_orderkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Y' ELSE 'n' END"), "one_na": ("other", "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE 'T' END"),
    "ref": ("other", "'R' || o_orderkey"), "day": ("other", "strftime(o_orderdate, '%Y-%m-%d')"), "note": ("other", "'n' || o_orderkey % 1000 || o_orderpriority"), "few": ("other", "'k' || o_orderkey % 40"),
}


def _typed_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{family}' AS family, {'MIN(x)' if family == 'integer' else 'NULL'} AS lo, {'MAX(x)' if family == 'integer' else 'NULL'} AS hi, COUNT(*) AS n, COUNT(DISTINCT x) AS d, "
        f"CASE WHEN COUNT(DISTINCT x) <= 10 THEN list(DISTINCT lower(trim(CAST(x AS VARCHAR)))) ELSE [] END AS w, "
        f"AVG(CAST(try_strptime(CAST(x AS VARCHAR), '%Y-%m-%d') IS NOT NULL AS INT)) FILTER (WHERE r <= 10) AS dates FROM (SELECT {x} AS x, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS r FROM orders)"
        for c, (family, x) in TYPED.items()
    )
    na = "[" + ", ".join(f"'{w}'" for w in P.NA_WORDS) + "]"
    sets = ["[" + ", ".join(f"'{w}'" for w in words) + "]" for words in P.BOOLEAN_SETS]
    return f"""
    WITH c AS ({each}), v AS (SELECT *, list_filter(w, lambda x: NOT list_contains({na}, x)) AS words, list_has_any(w, {na}) AS na FROM c)
    SELECT "column", CASE WHEN family = 'integer' THEN
    CASE WHEN lo BETWEEN 1900 AND 2100 AND hi BETWEEN 1900 AND 2100 THEN 'year' ELSE 'integer' END WHEN family = 'numeric' THEN 'numeric'
    WHEN d <= 10 THEN CASE WHEN len(words) >= 2 AND ({" OR ".join(f"list_has_all({x}, words)" for x in sets)}) THEN CASE WHEN na THEN 'boolean_with_na' ELSE 'boolean' END
    WHEN len(words) = 1 AND na AND ({" OR ".join(f"list_has_all({x}, words)" for x in sets)}) THEN 'boolean_with_na' ELSE 'categorical' END
    WHEN d / n > 0.95 THEN 'identifier' WHEN d / n < 0.5 AND d <= 50 THEN 'categorical' WHEN dates > 0.7 THEN 'date' ELSE 'string' END AS column_type FROM v"""


@query(_typed_sql())
def infer_column_type(spark, sf):
    """Each type that a column of a table can have."""
    text = {"year(o_orderdate)": F.year("o_orderdate"), "strftime(o_orderdate, '%Y-%m-%d')": F.date_format("o_orderdate", "yyyy-MM-dd")}
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), *(text.get(x, F.expr(x)).alias(c) for c, (_, x) in TYPED.items()))
    return P.profile(o, ROW).select("column", "column_type")


@query("""
WITH o AS (SELECT o_orderkey AS k, 'priority' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 'path',
    CASE WHEN o_orderkey % 3 = 0 THEN 'a/b' ELSE 'a/b/' || o_orderstatus || ' (x)' END FROM orders
    UNION ALL SELECT o_orderkey, 'price', CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 5 < 3 THEN ';' ELSE '' END FROM orders),
s AS (SELECT c, v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY k) AS r
    FROM o QUALIFY r <= 20), d AS (SELECT c, v, r, UNNEST([' - ', '-', ' / ', '/', ' | ', '|', ':', ';', ',', '(', ')']) AS delimiter FROM s),
g AS (SELECT c, delimiter, COUNT(*) AS n, COUNT(*) FILTER (WHERE contains(v, delimiter)) AS frequency, MIN(len(string_split(v, delimiter))) FILTER (WHERE contains(v, delimiter)) AS a, MAX(len(string_split(v, delimiter))) FILTER (WHERE contains(v, delimiter)) AS b, arg_min(v, r) AS v
    FROM d GROUP BY c, delimiter)
SELECT c AS "column", delimiter, frequency, frequency / n AS share, a = b AS is_consistent, CAST(CASE WHEN a = b THEN a END AS INT) AS num_parts,
    CASE WHEN contains(v, delimiter) THEN array_to_string(string_split(v, delimiter), '~') END AS sample_split FROM g WHERE frequency * 2 >= n
""")
def detect_delimiters(spark, sf):
    path = F.when(F.col("o_orderkey") % 3 == 0, "a/b").otherwise(F.concat(F.lit("a/b/"), "o_orderstatus", F.lit(" (x)")))
    price = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 5 < 3, ";").otherwise(""))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_orderpriority").alias("priority"), path.alias("path"), price.alias("price"))
    found = P.delimiters(P.first_values(o, ROW, 20))
    return found.select("column", "delimiter", "frequency", "share", "is_consistent", "num_parts", F.array_join("sample_split", "~").alias("sample_split"))


@query("""
SELECT doc_id, regexp_matches(t, '[一-鿿]') AND regexp_matches(t, '[A-Za-z]') AS both_languages FROM (SELECT doc_id,
    CASE WHEN doc_id % 3 = 2 THEN text ELSE '類別' || text END AS t FROM documents)
""")
def bilingual_flag(spark, sf):
    """Whether each whole text has Chinese and Latin letters; two of three texts have a Chinese prefix before them."""
    t = F.when(F.col("doc_id") % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("類別"), "text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", (C.has_cjk(F.col("t")) & C.has_latin(F.col("t"))).alias("both_languages"))


@query("SELECT COUNT(*) AS n, SUM(CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_dates FROM orders")
def date_column_share(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select(text.alias("t")).agg(F.count("*").alias("n"), F.count_if(P.reads_as_date(F.col("t"))).alias("n_dates"))


# --- tidy tables -------------------------------------------------------------

WIDE_SQL = """SELECT o_orderpriority AS p, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority"""


@query(f"SELECT p AS o_orderpriority, 'F' AS status, f AS n FROM ({WIDE_SQL}) UNION ALL SELECT p, 'O', o FROM ({WIDE_SQL})")
def tidy_unpivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count().na.fill(0)
    return tidy.unpivot(wide, ["o_orderpriority"], {"n": {"F": "F", "O": "O"}}, "status")


@query("""
SELECT l_orderkey, l_linenumber, 'gross' AS measure, l_quantity AS amount, l_extendedprice AS price FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'rate', l_discount, l_tax FROM lineitem
""")
def tidy_unpivot_multi(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return tidy.unpivot(rows, ["l_orderkey", "l_linenumber"], {"amount": {"gross": "l_quantity", "rate": "l_discount"}, "price": {"gross": "l_extendedprice", "rate": "l_tax"}}, "measure")


@query("SELECT n_nationkey AS __row, n_name AS \"ALGERIA_x\", n_regionkey AS \"ALGERIA_y\" FROM (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation) WHERE n_nationkey > 1")
def promote_header(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias(ROW), F.col("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("b"))
    top = (F.col(ROW) == 0, F.col(ROW) == 1)
    shaped = n.select(ROW, F.when(top[0], "ALGERIA").when(top[1], "x").otherwise(F.col("a")).alias("a"), F.when(top[0], None).when(top[1], "y").otherwise(F.col("b")).alias("b"))
    return tidy.promote_header(shaped, [0, 1])


@query("SELECT p_partkey AS __row, p_name FROM part WHERE p_partkey BETWEEN 5 AND 60")
def slice_region(spark, sf):
    return tidy.slice_region(table(spark, sf, "part").select(F.col("p_partkey").alias(ROW), "p_name"), 5, 60)


@query("SELECT MIN(p_partkey) AS first_footer FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 50")
def footer_detect(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias(ROW), F.when((F.col("p_partkey") % 97 == 0) & (F.col("p_partkey") > 50), F.concat(F.lit("Source: "), F.col("p_name"))).otherwise(F.col("p_name")).alias("a"))
    return tidy.first_footer_row(rows, "a")


MARKED_SQL = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'S' || (event_id // 10) ELSE event_type END AS a, CASE WHEN event_id % 10 <> 0 THEN value END AS b FROM events"


@query(f"SELECT event_id AS __row, a, b, section FROM (SELECT *, last_value(CASE WHEN event_id % 10 = 0 THEN a END IGNORE NULLS) OVER (ORDER BY event_id) AS section FROM ({MARKED_SQL})) WHERE event_id % 10 <> 0")
def fill_section_markers(spark, sf):
    k = F.col("event_id") % 10
    rows = table(spark, sf, "events").select(F.col("event_id").alias(ROW), F.when(k == 0, F.concat(F.lit("S"), F.expr("event_id div 10").cast("string"))).otherwise(F.col("event_type")).alias("a"), F.when(k != 0, F.col("value")).alias("b"))
    return tidy.fill_section_markers(rows, "a", "section")


PAIRS_SQL = """SELECT (p_partkey - 1) // 2 AS pair_id, MAX(CASE WHEN p_partkey % 2 = 1 THEN p_name END) AS label_first, MAX(CASE WHEN p_partkey % 2 = 0 THEN p_name END) AS label_second,
MAX(CASE WHEN p_partkey % 2 = 1 THEN p_size END) AS n, MAX(CASE WHEN p_partkey % 2 = 0 THEN p_size END) AS {second} FROM part WHERE p_partkey > 0 GROUP BY 1"""


def _pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") - 1).alias(ROW), F.col("p_name").alias("label"), F.col("p_size").alias("n"))


@query(PAIRS_SQL.format(second="pct"))
def merge_bilingual_pairs(spark, sf):
    return tidy.merge_bilingual_pairs(_pairs(spark, sf), "label", ["n"], same_data=False, second_names={"n": "pct"})


@query(f"SELECT pair_id, label_first, label_second, coalesce(n, m) AS n FROM ({PAIRS_SQL.format(second='m')})")
def merge_bilingual_pairs_same(spark, sf):
    return tidy.merge_bilingual_pairs(_pairs(spark, sf), "label", ["n"])


@query("SELECT o_orderstatus AS label, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def drop_total_rows(spark, sf):
    rolled = table(spark, sf, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit(" Grand Total")).alias("label"), "n")
    return tidy.drop_total_rows(rolled, ["label"])


@query("SELECT p_partkey, p_name FROM part")
def drop_aggregate_columns(spark, sf):
    return tidy.drop_aggregate_columns(table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").alias("Total"), F.col("p_size").alias("合計")))


@query("""
WITH d AS (SELECT DISTINCT p_type AS v FROM part UNION SELECT DISTINCT p_type || ' - ' || p_brand FROM part)
SELECT a.v AS summary, ' - ' AS delimiter, b.v AS detail FROM d a JOIN d b ON starts_with(b.v, a.v || ' - ')
""")
def detect_implicit_agg(spark, sf):
    p = table(spark, sf, "part")
    both = p.select(F.col("p_type").alias("c")).unionByName(p.select(F.concat_ws(" - ", "p_type", "p_brand").alias("c")))
    return tidy.implicit_aggregation(both, "c")


MIXED_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' - ' || p_brand END AS c FROM part"


def _mixed(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat_ws(" - ", "p_type", "p_brand")).alias("c"))


@query(f"SELECT p_partkey, split_part(c, ' - ', 1) AS base, CASE WHEN contains(c, ' - ') THEN split_part(c, ' - ', 2) END AS extra FROM ({MIXED_SQL})")
def split_dimension(spark, sf):
    return tidy.split_dimension(_mixed(spark, sf), "c", " - ", "base", "extra")


@query("SELECT p_partkey, p_type FROM part WHERE p_partkey % 10 <> 0")
def exclude_summary_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "All types").otherwise(F.col("p_type")).alias("p_type"))
    return tidy.exclude_summary_rows(rows, "p_type", ["All types"], "rows with the sum over all types")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS i,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS f, CAST(o_custkey AS VARCHAR) AS s FROM orders
""")
def cast_types(spark, sf):
    k = F.col("o_orderkey") % 4 == 0
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k, "n/a").otherwise(F.format_number("o_custkey", 0)).alias("i"), F.when(k, "–").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).alias("f"), F.col("o_custkey").alias("s"))
    return tidy.cast_types(rows, {"i": "integer", "f": "float", "s": "string"})


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def select_rename(spark, sf):
    return tidy.select_rename(table(spark, sf, "customer"), {"c_custkey": "id", "c_mktsegment": "segment"})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def map_values(spark, sf):
    return tidy.map_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "finished", "O": "open"})


@query(f"""
WITH l AS (SELECT p, 'F' AS status, f AS n FROM ({WIDE_SQL}) UNION ALL SELECT p, 'O', o FROM ({WIDE_SQL}))
SELECT 'rows' AS "check", COUNT(*) > 0 AS passed FROM l
    UNION ALL SELECT 'columns', list_has_all(['o_orderpriority', 'status', 'n'], ['o_orderpriority', 'status', 'n', 'year'])
UNION ALL SELECT 'row_count', COUNT(*) BETWEEN 6 AND 24 FROM l UNION ALL SELECT 'sample', COUNT(*) > 0 FROM l WHERE status = 'F' AND abs(n - (SELECT f
    FROM ({WIDE_SQL}) ORDER BY p LIMIT 1)) < 0.01
UNION ALL SELECT 'sample', COUNT(*) > 0 FROM l WHERE status = 'O' AND n < 0
""")
def validate_result(spark, sf):
    result = tidy_unpivot(spark, sf)
    first = result.where("status = 'F'").orderBy("o_orderpriority").first()
    schema = {
        "target_columns": [{"name": c} for c in ("o_orderpriority", "status", "n", "year")],
        "expected_output": {"row_count_estimate": 12},
        "validation_samples": [{"expected_row": {"o_orderpriority": first["o_orderpriority"], "status": "F", "n": first["n"]}}, {"expected_row": {"status": "O", "n": -5}}],
    }
    return spark.createDataFrame([(c.name, c.passed) for c in validate(result, schema).checks], "check string, passed boolean")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10000")
def sample_rows(spark, sf):
    """The ten thousand rows of a sample; the limit is the operator's."""
    return P.sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 10_000, "o_orderkey")


@query("""
SELECT k AS start, t AS stop, CAST(UNNEST(CASE WHEN t - k + 1 <= 30 THEN range(k, t + 1) ELSE list_distinct(list_transform(range(0, 30), lambda i: CAST(floor(k + i * (CAST(t - k + 1 AS DOUBLE) / 30)) AS BIGINT))) END) AS INT) AS i
FROM (SELECT DISTINCT CAST(o_orderkey % 7 AS INT) AS k, CAST(o_custkey % 300 AS INT) + 7 AS t FROM orders)
""")
def spread_sample(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 7).cast("int").alias("start"), (F.col("o_custkey") % 300 + 7).cast("int").alias("stop")).distinct()
    return rows.select("start", "stop", F.explode(C.spread_sample(F.col("start"), F.col("stop"), 30)).alias("i"))


@query("""
SELECT 'S' || ((event_id // 10) % 5) AS section, event_type AS type, round(SUM(value), 4) AS total FROM events WHERE event_id % 10 <> 0 GROUP BY ALL
""")
def declarative_plan(spark, sf):
    """A plan read from JSON: markers filled, columns chosen, then summed."""
    k = F.col("event_id") % 10
    rows = table(spark, sf, "events").select(F.col("event_id").alias(ROW), F.when(k == 0, F.concat(F.lit("S"), F.pmod(F.expr("event_id div 10"), F.lit(5)).cast("string"))).otherwise(F.col("event_type")).alias("a"), F.when(k != 0, F.col("value")).alias("b"))
    plan = Plan.from_json('[{"operator": "fill_section_markers", "column": "a", "into": "section"}, {"operator": "select_rename", "columns": {"section": "section", "a": "type", "b": "v"}}]')
    return plan.apply(rows).groupBy("section", "type").agg(F.round(F.sum("v"), 4).alias("total"))


@query()
def encode_sheet(spark, sf):
    """The whole encoding of nation as one sheet: each value's ranges, and the sizes."""
    from .plans import encode as E

    found = E.encode(nation_cells(spark, sf), E.Options(profile="v1"))
    sheet = found["sheets"]["Sheet1"]
    sizes = found["compression_metrics"]["overall"]
    return spark.createDataFrame([(v, ", ".join(r), sizes["final_tokens"]) for v, r in sheet["cells"].items()], "value string, ranges string, final_size long")


def _encoded(spark, sf, profile: str) -> DataFrame:
    from .operators.scratch import materialize
    from .plans import encode as E

    cells = materialize(nation_cells(spark, sf), "cells")
    found = E.entries(E.build(cells, E.Options(profile=profile)), cells)
    return found.where("part = 'cells'").select(F.col("name").alias("value"), F.array_join("ranges", ", ").alias("ranges"))


def _encoded_sql(rows: str) -> str:
    return f"""
    WITH c AS (SELECT v_str AS v, row, col FROM ({NATION})
    WHERE {rows}), g AS (SELECT v, col, row, row - ROW_NUMBER() OVER (PARTITION BY v, col ORDER BY row) AS k FROM c),
    r AS (SELECT v, col, MIN(row) AS a, MAX(row) AS b FROM g GROUP BY v, col, k)
    SELECT v AS value, STRING_AGG(chr(CAST(64 + col AS INT)) || a || CASE WHEN b > a THEN ':' || chr(CAST(64 + col AS INT)) || b ELSE '' END, ', ' ORDER BY a, col) AS ranges FROM r GROUP BY v"""


@query(_encoded_sql("row <= 3"))
def encode_v1_values(spark, sf):
    """Profile v1 from cells to ranges. Only the header row is mostly text, so it and two rows below it are kept."""
    return _encoded(spark, sf, "v1")


@query(_encoded_sql("row <= 5 OR row >= (SELECT MAX(n_nationkey) + 2 FROM nation) - 4"))
def encode_v2_values(spark, sf):
    """Profile v2 from cells to ranges. All cells look alike, so the edges of the one region are kept, two times two rows deep."""
    return _encoded(spark, sf, "v2")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which cell ranges hold each value of nation."""
    found = I.value_ranges(nation_cells(spark, sf), SHEET)
    return found.select("value", F.array_join("ranges", ", ").alias("ranges"))
