"""Profiles, tidy operators, plans, sources and the whole pipeline."""

from __future__ import annotations

import datetime
import json
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.__main__ import main
from tessella.operators import profile as P
from tessella.operators import tidy
from tessella.operators.model import cells_from_table
from tessella.operators.tidy import ROW
from tessella.plans import encode as E
from tessella.plans import normalize as N
from tessella.plans import planner as pl
from tessella.plans.plan import Plan, parse_reply
from tessella.plans.validate import feedback, validate
from tessella.sources import tables, xlsx
from tessella.streaming import ingest


def numbered(spark, names: list[str], rows: list[tuple]):
    kinds = ["double" if all(isinstance(r[i], (int, float)) or r[i] is None for r in rows) and any(isinstance(r[i], float) for r in rows) else "long" if all(isinstance(r[i], int) or r[i] is None for r in rows) and any(r[i] is not None for r in rows) else "string" for i in range(len(names))]
    rows = [tuple(float(v) if k == "double" and v is not None else str(v) if k == "string" and v is not None else v for v, k in zip(r, kinds)) for r in rows]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_smoke_frame(spark):
    df = numbered(spark, ["Year/年份", "Category/类别", "Value/数值"], [(2020, "A", 100), (2021, "B", 200), (2022, "C", 300)])
    found = N.Normalizer(spark).encode_table(df)
    assert found["original_shape"] == (3, 3) and found["encoded_text"]
    assert [c["column_type"] for c in found["metadata"]["columns"]] == ["year", "categorical", "integer"]
    assert found["metadata"]["issues"] == [f"Multi-language column: {c}" for c in ("Year/年份", "Category/类别", "Value/数值")]


def test_profile(spark):
    rows = [(i, f"r{i}", ["yes", "No ", "N/A"][i % 3], "a - b" if i % 4 else "c - d - e", None if i % 5 else 1.5) for i in range(60)]
    df = numbered(spark, ["n", "ref", "flag", "mark", "x"], rows)
    found = {r["column"]: r for r in P.profile(df, ROW).collect()}
    assert [found[c]["column_type"] for c in ("n", "ref", "flag", "mark", "x")] == ["integer", "identifier", "boolean_with_na", "categorical", "numeric"]
    assert found["x"]["n_null"] == 48 and found["x"]["std"] == 0 and found["n"]["median"] == 29.5
    assert found["flag"]["values"] == ["yes", "No ", "N/A"] and found["flag"]["value_counts"]["yes"] == 20


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_001])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, rng.gauss(0, 1)]), rng.randint(0, 5), float(k), None) for k in range(n)]
    found = {r["column"]: r["median"] for r in P.medians(spark.createDataFrame(rows, "a double, b int, c double, d double"), ["a", "b", "c", "d"]).collect()}
    assert found == {c: statistics.median(v) for i, c in enumerate("abcd") for v in [[r[i] for r in rows if r[i] is not None]] if v}


def test_merged_ranges_dates_of_1904_and_sheets_in_order(spark, tmp_path):
    """A merged block of a million rows is two corners; sheets keep the workbook's order; day 0 may be in 1904."""
    path = str(tmp_path / "a.xlsx")
    xlsx.write(path, ["x", "n"], iter([("v", datetime.date(2020, 1, 2)), ("w", None)]), sheet="Zeta", merged=["A2:B1048576", "C1:D1"])
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    own = parts["xl/workbook.xml"].decode()
    own = own.replace("<sheets>", '<workbookPr date1904="1"/><sheets>').replace("</sheets>", '<sheet name="Alpha" sheetId="2" r:id="rId3"/></sheets>')
    links = parts["xl/_rels/workbook.xml.rels"].decode()
    link = links[links.index("<Relationship ") : links.index("/>") + 2]
    parts |= {"xl/workbook.xml": own.encode(), "xl/_rels/workbook.xml.rels": links.replace("</Relationships>", link.replace("rId1", "rId3").replace("sheet1", "sheet2") + "</Relationships>").encode(), "xl/worksheets/sheet2.xml": parts["xl/worksheets/sheet1.xml"]}
    with zipfile.ZipFile(path, "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
    cells = tables.read_cells(spark, path)
    found = {(r["sheet"], r["row"], r["col"]): r for r in cells.collect()}
    assert (found["Zeta", 2, 1]["is_merge_start"], found["Zeta", 3, 1]["merged_range"], found["Zeta", 3, 1]["is_merge_start"]) == (True, "A2:B1048576", False)
    assert found["Zeta", 1, 1]["merged_range"] is None and found["Zeta", 2, 2]["v_str"].startswith("2024-01-03")
    encoded = E.encode(cells)
    assert list(encoded["sheets"]) == ["Zeta", "Alpha"]
    both = cells.unionByName(cells.withColumn("file", F.lit("other")))
    with pytest.raises(ValueError, match="more than one file"):
        E.encode(both)
    assert {name: x["sheets"] for name, x in E.encode_files(both).items()} == {path: encoded["sheets"], "other": encoded["sheets"]}


@pytest.mark.parametrize("head", [1, 5, 40, 1024])
def test_first_values_by_heads_of_any_length(spark, head):
    data = [(i, f"v{i}", f"w{i}" if i % 3 == 0 else None, "late" if i > 95 else None, None) for i in range(100)]
    df = spark.createDataFrame(data, f"{ROW} long, a string, b string, `c.d` string, e string").repartition(7)
    found = {(r["column"], r["rank"]): r["value"] for r in P.first_values(df, ROW, 4, head).collect()}
    values = {"a": [r[1] for r in data], "b": [r[2] for r in data], "c.d": [r[3] for r in data]}
    assert found == {(c, k): v for c, all_ in values.items() for k, v in enumerate([x for x in all_ if x is not None][:4], 1)}
    assert P.first_values(df.limit(0), ROW, 4, head).count() == 0 and P.first_values(df.select(ROW), ROW, 4, head).count() == 0


def test_delimiters(spark):
    df = numbered(spark, ["c"], [(f"x{i} - y (z)" if i % 2 else f"x{i} - y" + ";" * (i // 2),) for i in range(20)])
    found = {r["delimiter"]: r for r in P.delimiters(P.first_values(df, ROW, 20)).collect()}
    assert found[" - "]["share"] == 1 and found[" - "]["num_parts"] == 2 and found["("]["share"] == 0.5 and "|" not in found
    assert (found[" - "]["name"], found[" - "]["frequency"], found[" - "]["sample_split"]) == ("space-dash-space", 20, ["x0", "y"])
    assert found["("]["sample_split"] is None and found["("]["num_parts"] == 2
    uneven = {r["delimiter"]: r for r in P.delimiters(P.first_values(numbered(spark, ["c"], [("a;b",), ("a;b;c",), ("d",)]), ROW, 20)).collect()}
    assert (uneven[";"]["is_consistent"], uneven[";"]["num_parts"], uneven[";"]["frequency"]) == (False, None, 2)


def test_header_and_unpivot(spark):
    df = numbered(spark, ["a", "b", "c", "d"], [("", "", "Region A", ""), ("Category", "Product", "Q1", "Q2"), ("x", "y", "1", "2"), ("Source: here", None, None, None)])
    df = df.select(ROW, *(F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) for c in "abcd"))
    flat = tidy.promote_header(tidy.drop_footer(df, "a"), [0, 1])
    assert flat.columns == [ROW, "Category", "Product", "Region A_Q1", "Region A_Q2"] and flat.count() == 1
    wide = numbered(spark, ["d", "n_1", "p_1", "n_2"], [("x", 1, 0.5, 2)])
    long = tidy.unpivot(wide.drop(ROW), ["d"], {"n": {"1": "n_1", "2": "n_2"}, "p": {"1": "p_1"}}, "v")
    assert plain(long) == [("x", "1", 1, 0.5), ("x", "2", 2, None)]


def test_markers_pairs_totals(spark):
    df = numbered(spark, ["a", "n", "m"], [("2018", None, None), ("x", 1, 2), ("y", 3, 4), ("2019", None, None), ("x", 5, 6)])
    assert [r["s"] for r in tidy.fill_section_markers(df, "a", "s").orderBy(ROW).collect()] == ["2018", "2018", "2019"]
    tall = spark.range(200_000).select(F.col("id").alias(ROW), F.when(F.col("id").isin(3, 70_000), F.concat(F.lit("S"), "id")).otherwise("x").alias("a"), F.when(~F.col("id").isin(3, 70_000), F.col("id")).alias("n"))
    filled = tidy.fill_section_markers(tall, "a", "s").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in filled} == {None: 3, "S3": 69_996, "S70000": 129_999}
    two = tall.where(f"{ROW} < 5").crossJoin(spark.createDataFrame([("p",), (None,)], "g string"))
    assert {(r["g"], r["s"]) for r in tidy.fill_section_markers(two.withColumn("a", F.concat("a", F.coalesce("g", F.lit("-")))), "a", "s", ["g"]).where(f"{ROW} = 4").collect()} == {("p", "S3p"), (None, "S3-")}
    pairs = numbered(spark, ["label", "n"], [("男", 10), ("Male", 40), ("女", 20), ("Female", 60)])
    assert plain(tidy.merge_bilingual_pairs(pairs, "label", ["n"], same_data=False, second_names={"n": "pct"})) == [(0, "男", "Male", 10, 40), (1, "女", "Female", 20, 60)]
    labels = numbered(spark, ["l"], [("a",), (" Total ",), ("Other",), (None,), ("合計",)])
    assert tidy.drop_total_rows(labels, ["l"]).count() == 3


def test_implicit_aggregation(spark):
    df = numbered(spark, ["c"], [("A",), ("A - x",), ("A - x - y",), ("B / z",), ("Asia/Pacific",), ("A",)])
    assert plain(tidy.implicit_aggregation(df, "c")) == sorted([("A", " - ", "A - x"), ("A", " - ", "A - x - y"), ("A - x", " - ", "A - x - y")], key=str)
    split = tidy.split_dimension(df.drop(ROW).distinct(), "c", " - ", "base", "extra")
    assert ("A", None) in plain(split) and ("A", "x - y") in plain(split)


@pytest.mark.parametrize(("guidance", "values", "needed"), [(None, ["Total"], False), ("none", ["Total"], False), ("drop", ["Total"], True), ("drop", ["small"], True), ("drop", ["x"], False), ("keep all rows", ["Total"], False)])
def test_filter_needed(guidance, values, needed):
    assert tidy.filter_needed(guidance, values) is needed


def test_cast_types(spark):
    df = numbered(spark, ["a", "b"], [("1,234", " 2.5 "), ("x", "n/a"), ("3.0", None)])
    assert plain(tidy.cast_types(df, {"a": "integer", "b": "float"}).drop(ROW)) == sorted([(1234, 2.5), (None, None), (3, None)], key=str)
    with pytest.raises(ValueError, match="decimal"):
        tidy.cast_types(df, {"a": "decimal"})


def test_plans(spark):
    df = numbered(spark, ["Store", "Jan", "Feb", "Total"], [("s", 1, 2, 3), ("t", 4, 5, 9)])
    plan = Plan().add("drop_aggregate_columns").add("unpivot", ids=["Store"], groups={"sales": {"Jan": "Jan", "Feb": "Feb"}}, variable="month").add("select_rename", columns={"Store": "store", "month": "month", "sales": "sales"})
    again = Plan.from_json(f"```json\n{plan.to_json()}\n```")
    assert plain(again.apply(df)) == [("s", "Feb", 2), ("s", "Jan", 1), ("t", "Feb", 5), ("t", "Jan", 4)]
    with pytest.raises(ValueError, match="no operator"):
        Plan.from_json('[{"operator": "exec"}]')
    with pytest.raises(ValueError, match="step 0"):
        Plan.from_json('[{"operator": "slice_region", "begin": 1}]')
    assert parse_reply('so: {"a": 1} ok') == {"a": 1}
    with pytest.raises(ValueError):
        parse_reply("nothing")


def test_validate_and_feedback(spark):
    df = numbered(spark, ["a", "n"], [("x", 1), ("y", None), ("z", None)])
    schema = {"target_columns": [{"name": "a"}, {"name": "n"}, {"name": "m"}], "expected_output": {"row_count_estimate": 10}, "validation_samples": [{"expected_row": {"a": "x", "n": 1.004, "gone": 3}}, {"description": "d", "expected_row": {"a": "q"}}]}
    found = validate(df, schema)
    assert not found.is_valid and [c.passed for c in found.checks] == [True, False, False, True, False]
    assert found.mostly_null == {"n": 66.7} and found.shape == (3, 2)
    assert [x["check"] for x in feedback(found)] == ["columns", "row_count", "sample"]
    many = validate(df, {"expected_output": {"row_count_estimate": 1}})
    assert many.is_valid and not many.checks[2].passed
    assert not validate(df.limit(0), {}).is_valid


def test_rule_planner(spark):
    df = numbered(spark, ["Store", "Product", "Total", "Jan", "Feb", "Mar"], [("s", "p", 6, 1, 2, 3), ("s", "q", 15, 4, 5, 6), ("Total", None, 21, 5, 7, 9)])
    planner = pl.RulePlanner()
    analysis = planner.analyze(df)
    assert analysis.aggregate_columns == ["Total"] and analysis.total_rows == [2] and analysis.header_rows == []
    schema = planner.schema(df, analysis)
    result = planner.plan(df, analysis, schema).apply(df)
    assert schema.rows == 6 == result.count() and validate(result, schema).is_valid
    assert result.columns == ["store", "product", "variable", "value"]
    assert "Total" not in pl.described(analysis, schema) and "6 rows" in pl.described(analysis, schema)


@pytest.mark.parametrize("sections", [20, 150])
def test_all_markers_and_totals_are_counted(spark, sections):
    rows = [r for k in range(sections) for r in ((f"Section {k}", None, None), (f"item {k}", 1, 2), ("Subtotal", 1, 2))]
    df = numbered(spark, ["a", "n", "m"], [*rows, ("Total", None, None)])
    planner = pl.RulePlanner()
    analysis = planner.analyze(df)
    schema = planner.schema(df, analysis)
    result = planner.plan(df, analysis, schema).apply(df)
    assert schema.rows == sections == result.count() and validate(result, schema).is_valid
    assert analysis.left_out == 2 * sections + 1


def test_totals_of_many_sections_are_left_out(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,n,m\n" + "".join(f"Section {k},,\nitem {k},1,2\nSubtotal,1,2\n" for k in range(150)))
    result = N.Normalizer(spark, N.Config(output_dir=str(tmp_path / "out"))).normalize(str(path))
    assert result.validation.is_valid and result.table.count() == 150
    assert result.table.where(F.lower("a") == "subtotal").count() == 0


def test_header_rows():
    names = ["Report", "Unnamed: 1", "Unnamed: 2", "Unnamed: 3"]
    blank, body = [None] * 4, ["x", "y", "1", "2.5"]
    assert pl.header_rows(names, [blank, ["a", "b", "c", "d"], body, body]) == [1]
    assert pl.header_rows(names, [["title", None, None, None], [None, "P", "North", "South"], ["C", None, "Q1", "Q2"], body]) == [1, 2]
    assert pl.header_rows(names, [["a", "b", "2019", "2020"], body]) == [0]
    assert pl.header_rows(["a", "b", "c", "d"], [["a", "b", "c", "d"], body]) == []
    assert pl.header_rows(names, [["a", "b", "c", "d"]] * 3) == [] and pl.header_rows(names, []) == []


def test_titled_sheet_with_two_header_levels(spark, tmp_path):
    """From a workbook in a file:// store to a tidy table: title, two levels, thousands, a total, a note, spellings."""
    path = f"{tmp_path}/report.xlsx"
    rows = [
        (None, None, None, None, None), ("Category", "Product", "Sales", None, "Stock"), (None, None, "Q1", "Q2", "Q1"), ("Food", "Rice", "1,200", 3, 7),
        ("food ", "Oil", 4, "n/a", 8), ("Food", "Salt", 5, 6, 9), ("Total", None, 9, 9, 24), ("Source: office", None, None, None, None),
    ]
    xlsx.write(path, ["Report 2020", "", "", "", ""], iter(rows))
    result = N.Normalizer(spark, N.Config(output_dir=str(tmp_path / "out"))).normalize(f"file://{path}")
    assert result.validation.is_valid and [s["operator"] for s in result.plan.steps][:3] == ["promote_header", "slice_region", "cast_types"]
    found = sorted(tuple(r) for r in result.table.drop(ROW).collect())
    assert result.table.drop(ROW).columns == ["category", "product", "variable", "sales", "stock"]
    assert found == [("Food", "Oil", "Q1", 4, 8), ("Food", "Oil", "Q2", None, None), ("Food", "Rice", "Q1", 1200, 7), ("Food", "Rice", "Q2", 3, None), ("Food", "Salt", "Q1", 5, 9), ("Food", "Salt", "Q2", 6, None)]


def test_sums_that_name_themselves_are_excluded(spark):
    df = numbered(spark, ["area", "n"], [("All - north", 1), ("All - south", 2), ("All", 3), ("x", 4)])
    planner = pl.RulePlanner()
    analysis = planner.analyze(df)
    result = planner.plan(df, analysis, planner.schema(df, analysis)).apply(df)
    assert sorted(map(tuple, result.collect()), key=str) == sorted([("All", "north", 1), ("All", "south", 2), ("x", None, 4)], key=str)


def test_documents_and_model_planner(spark):
    df = numbered(spark, ["a", "b"], [("x", 1), ("y", 2)])
    found = pl.Analysis.of({"data_region": {"start_row": -3, "end_row": 99}, "row_patterns": 5}, ["a", "b"], 2)
    assert (found.start, found.end, found.id_columns, found.total_rows) == (0, 1, ["a", "b"], [])
    assert pl.Analysis.of(found.document(), ["a", "b"], 2) == found and found.document()["data_region"] == {"start_row": 0, "end_row": 1}
    schema = pl.Schema([{"name": "a"}], 2, "all", "row")
    assert pl.Schema.of(schema.document()) == schema and pl.Schema.of("x") == pl.Schema()
    asked = []

    def ask(question, context):
        asked.append((question, context.get("last_error")))
        return {"plan": '[{"operator": "exec"}]' if asked[-1][1] is None else '[{"operator": "slice_region", "start": 1, "end": 1}]'}[question]

    planner = pl.ModelPlanner(ask, pl.RulePlanner())
    analysis = planner.analyze(df)
    assert planner.plan(df, analysis, planner.schema(df, analysis)).apply(df).count() == 1
    assert [q for q, _ in asked] == ["structure"] * 2 + ["schema"] * 2 + ["plan"] * 2 and "no operator" in asked[-1][1]


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx.write(path, ["Name", "N", "X"], iter([("a & b", 1, 1.5), ("類別", -2, None), ("c", True, 0.25)]), merged=["A2:B2"])
    cells = tables.read_cells(spark, path)
    found = {(r["row"], r["col"]): r for r in cells.collect()}
    assert found[1, 1]["bold"] and found[1, 1]["has_border"] and found[1, 1]["h_align"] == "center"
    assert (found[2, 1]["v_str"], found[2, 1]["merged_range"], found[2, 1]["is_merge_start"]) == ("a & b", "A2:B2", True)
    assert (found[3, 2]["v_str"], found[3, 2]["py_type"], found[4, 2]["py_type"], found[4, 3]["py_type"]) == ("-2", "int", "bool", "float")
    table = tables.read_table(spark, path).orderBy(ROW)
    assert [tuple(r) for r in table.collect()][1] == (1, "類別", "-2", None)
    days = str(tmp_path / "days.xlsx")
    moments = [datetime.datetime(2020, 2, 29, 13, 30), datetime.datetime(1999, 12, 31)]
    xlsx.write(days, ["t", "d"], iter([(moments[0], moments[0].date()), (None, None), (moments[1], moments[1].date())]))
    assert [(r["t"], r["d"]) for r in tables.read_table(spark, days).orderBy(ROW).collect()] == [(moments[0], datetime.datetime(2020, 2, 29)), (None, None), (moments[1], moments[1])]
    with pytest.raises(FileNotFoundError):
        tables.read_cells(spark, str(tmp_path / "b.xlsx"))
    with pytest.raises(ValueError):
        tables.check_input(__file__)


@pytest.mark.parametrize(("encoding", "separator"), [("utf-8", ","), ("utf-8", ";"), ("utf-8", "\t"), ("utf-16", "\t"), ("latin1", ";"), ("utf-8", "|")])
def test_csv_sniffing(spark, tmp_path, encoding, separator):
    path = tmp_path / "a.csv"
    path.write_text("\n".join(separator.join(x) for x in [("naïve", "n"), ("é", "1"), ("b", "2")]), encoding=encoding)
    assert tables.sniff(path.read_bytes()) == (encoding, separator)
    found = tables.read_csv(spark, str(path)).orderBy(ROW).collect()
    assert [(r["naïve"], r["n"]) for r in found] == [("é", 1), ("b", 2)]


@pytest.mark.parametrize(("encoding", "end", "want"), [("latin1", "naïve;é", ("naïve", "é")), ("utf-8", "naïve;é", ("naïve", "é")), ("utf-16", "naïve;é", ("naïve", "é")), ("utf-8", "類別;Ω", ("類別", "Ω"))])
def test_encoding_holds_for_the_whole_file(spark, tmp_path, encoding, end, want):
    path = tmp_path / "a.csv"
    path.write_text("a;b\n" + "plain;text\n" * 9000 + end + "\n", encoding=encoding)
    assert path.stat().st_size > tables.PROBE
    found = tables.read_csv(spark, str(path)).orderBy(ROW).collect()
    assert len(found) == 9001 and (found[-1]["a"], found[-1]["b"]) == want and found[0]["a"] == "plain"


def test_separator_holds_for_the_whole_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b;c\n" + "1,2;3\n" * 15000 + "1,2,3,4;5\n")
    assert path.stat().st_size > tables.PROBE
    assert set(tables.read_csv(spark, str(path)).columns) == {ROW, "a,b", "c"}


def test_one_column_in_latin1(spark, tmp_path):
    for n in (3, 40000):
        path = tmp_path / f"{n}.csv"
        path.write_text("a\n" + "x\n" * n + "é\n", encoding="latin1")
        assert [r["a"] for r in tables.read_csv(spark, str(path)).orderBy(ROW).collect()][-1] == "é"


def test_numbered_rows(spark):
    df = tables.numbered(spark.range(0, 1000, 1, 7))
    assert all(r["id"] == r[ROW] for r in df.collect())
    assert tables.numbered(spark.range(0)).count() == 0


def test_cells_from_table_is_one_projection(spark):
    df = spark.range(1, 4).select(F.col("id").alias("r"), F.col("id").alias("a"), F.lit("x").alias("b"))
    cells = cells_from_table(df, "r")
    assert cells.count() == 8 and "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()


def test_pipeline(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Store,Product,Total,Jan,Feb\ns,p,3,1,2\ns,q,7,3,4\nTotal,,10,4,6\n")
    config = N.Config(output_dir=str(tmp_path / "out"))
    result = N.Normalizer(spark, config).normalize(str(path))
    assert result.validation.is_valid and result.log["status"] == "success" and result.table.count() == 4
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"01_encoded_data.json", "02_structure_analysis.json", "03_schema.json", "04_transformation_plan.json", "pipeline_log.json", "normalized_output.csv"}
    assert (tmp_path / "out/normalized_output.csv").read_text().splitlines()[0] == "store,product,variable,value"
    assert "Valid: True" in N.summary(result)
    with pytest.raises(FileNotFoundError):
        N.Normalizer(spark, config).normalize(str(tmp_path / "none.csv"))
    assert json.loads((tmp_path / "out/pipeline_log.json").read_text())["status"] == "failed"


def test_cli(spark, tmp_path, capsys):
    assert main(["-i", str(tmp_path / "no.csv")]) == 1
    (tmp_path / "x.txt").write_text("a")
    assert main(["-i", str(tmp_path / "x.txt")]) == 1
    path = tmp_path / "a.csv"
    path.write_text("a,b\nx,1\ny,2\nz,3\n")
    assert main(["encode", str(path), "-o", str(tmp_path / "o.json")]) == 0
    assert "Sheet1" in json.loads((tmp_path / "o.json").read_text())["sheets"]


def test_stream_of_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        xlsx.write(str(tmp_path / f"in/{name}.xlsx"), ["x", "n"], iter([("v", 1)]))
    cells = ingest.workbook_stream(spark, str(tmp_path / "in"))
    ingest.write_typed_cells(cells, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 8 and {r["semantic"] for r in found.select("semantic").collect()} == {"text", "integer"}
