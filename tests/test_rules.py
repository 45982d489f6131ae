"""Rules over grids, pages, workbooks and the library on small known cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import policy
from docloom.operators import library, page_tables, phrases, search, sequences, tables, workbook
from docloom.sources import logs


def cells(spark, grids):
    rows = [(k, i, j, c) for k, g in grids.items() for i, r in enumerate(g) for j, c in enumerate(r)]
    return spark.createDataFrame(rows, "table_id string, row int, col int, cell string")


GRIDS = {
    "bar": [["Metric", "2022", "2023", "2024"], ["A", "100", "110", "120"], ["B", "10", "12", "15"]],
    "line": [["Metric", "2021", "2022", "2023", "2024"], ["Revenue", "1,000", "1,200", "(300)", "1,500"]],
    "long": [["Period", "Alpha", "Beta"], ["2022", "1", "5"], ["2024", "3", "7"], ["2023", "2", "6"]],
    "none": [["Col1", "Col2", "Col3"], ["1", "2", "3"], ["4", "5", "6"]],
    "hole": [["Metric", "2022", "2023", "2024"], ["A", "100", "", "120"]],
    "composition": [["Metric", "2022", "2023", "2024"], ["A", "30", "35", "35"]],
    "noted": [["Metric", "(CNY Million) 2025", "2024", "YoY"], ["A", "5", "4", "25%"], ["B", "9", "8", "12%"]],
    "ratio": [["Metric", "2023", "2024"], ["Margin", "10%", "12%"], ["Sales", "5", "6"]],
    "entity": [["Country", "Year", "Rank", "Total", "S1", "S2"], ["Somalia", "2023", "1", "111.9", "9.1", "2.5"], ["Kenya", "2023", "35", "87.8", "6.0", "3.5"]],
    "pie": [["Region", "Revenue"], ["North", "10"], ["South", "0"], ["West", "5.5"]],
    "snapshot": [["Region", "2024"], ["North", "10"], ["South", "20"]],
    "negative": [["Region", "Revenue"], ["North", "10"], ["South", "(2)"]],
}


@pytest.fixture(scope="module")
def grids(spark):
    return cells(spark, GRIDS).cache()


def test_chart_profiles(grids):
    got = {r.table_id: (r.orientation, r.period_count, r.metric_count, r.chart_type) for r in tables.chart_profiles(grids).collect()}
    assert got == {"bar": ("wide", 3, 2, "bar"), "line": ("wide", 4, 1, "line"), "long": ("long", 3, 2, "bar"), "noted": ("wide", 2, 2, "bar"), "ratio": ("wide", 2, 1, "bar")}
    series = {(r.table_id, r.name): [(p.period, p.value) for p in r.points] for r in tables.series(grids, tables.column_profiles(grids)).collect()}
    assert series["line", "Revenue"] == [("2021", 1000.0), ("2022", 1200.0), ("2023", -300.0), ("2024", 1500.0)]
    assert series["long", "Beta"] == [("2022", 5.0), ("2023", 6.0), ("2024", 7.0)]
    assert series["noted", "A"] == [("2024", 4.0), ("2025", 5.0)]


def test_entities_pies_and_attempts(grids):
    assert [(r.table_id, r.metric) for r in tables.entity_grids(grids).orderBy("col").collect()] == [("entity", "Total"), ("entity", "S1"), ("entity", "S2")]
    assert {(r.table_id, r.layout, r.slices, r.total) for r in tables.pies(grids).collect()} == {("pie", "category_value", 3, 15.5), ("snapshot", "category_value", 2, 30.0)}
    got = {r.table_id: r.chart for r in tables.chart_attempts(grids).collect()}
    assert got == {"bar": "bar", "line": "line", "long": "bar", "none": None, "hole": None, "composition": None, "noted": "bar", "ratio": "bar", "entity": "entity_grid", "pie": "pie", "snapshot": "pie", "negative": None}


def test_acceptance(spark):
    filler = [["x", "1", "2", "3"]] * 4
    bad = {
        "few": [["a", "b"], ["", ""]], "odd": [["a", "b", "c"], ["x", "1"], ["y", "2", "3"], ["z", "4", "5"]], "label": [["a", "b"], ["", "1"], ["x", "2"]], "lost": [["a", "b", "c"], ["x", "1", ""], ["y", "2", ""]],
        "collapsed": [["a", "", "", ""], ["x 1 2", "", "", ""], ["y 3", "", "", ""]], "same": [["t", "t", "t", "t", "t"], ["x", "1", "2", "3", "4"]], "prose": [["a", "b"], ["one", "two"], ["three", "four"], ["five", "six"], ["seven", "eight"]],
        "good": [["a", "b", "c", "d"], *filler], "blank rows go": [["", "", "", ""], ["a", "b", "c", "d"], *filler],
    }
    got = {r.table_id: r.reason for r in tables.acceptance(tables.cleaned(cells(spark, bad))).collect()}
    assert got == {"few": "too_few_rows", "odd": "misalignment", "label": "label_column_sparse", "lost": "empty_data_column", "collapsed": "column_collapse", "same": "degenerate_header", "prose": "no_tabular_data", "good": None, "blank rows go": None}


def test_label_columns_and_headers(spark):
    grid = cells(spark, {"m": [["2025", "Metric", "2024"], ["1", "Sales", "2"], ["3", "Costs", "4"]], "n": [["a", "b"], ["1", "2"], ["3", "4"]]})
    labels = tables.label_columns(grid)
    got = {r.table_id: r for r in labels.collect()}
    assert got["m"].label_col == 1 and got["m"].empty_ratio == 0 and got["n"].label_col is None and got["n"].empty_ratio == 1
    moved = {(r.row, r.col): r.cell for r in tables.labels_first(grid, labels).filter("table_id = 'm'").collect()}
    assert [moved[0, j] for j in range(3)] == ["Metric", "2025", "2024"] and moved[2, 0] == "Costs"
    sheets = cells(spark, {"titled": [["REPORT", "", ""], ["Name", "2024", ""], ["", "Actual", "Budget"], ["a", "1", "2"], ["b", "3", "4"]], "plain": [["Name", "Title"], ["a", "b"], ["c", "d"]], "titles": [["x", ""], ["y", ""]]})
    spans = tables.header_spans(sheets)
    assert {r.table_id: (r.first, r.end) for r in spans.collect()} == {"titled": (1, 3), "plain": (0, 1), "titles": (0, 1)}
    heads = {(r.table_id, r.col): r.header for r in tables.composed_headers(sheets, spans).collect()}
    assert [heads["titled", j] for j in range(3)] == ["Name", "2024 Actual", "2024 Budget"] and heads["plain", 1] == "Title"


def test_slices(spark):
    points = [("q", "plot 3 metrics", f"Alpha{i}" if i else "Alpha", i, str(2010 + j), j, float(i * j)) for i in range(5) for j in range(4)]
    points += [("r", "plot 2 periods", "One", 0, str(2010 + j), j, float(j)) for j in range(13)] + [("s", "", "One", 0, str(2010 + j), j, float(j)) for j in range(13)]
    df = spark.createDataFrame(points, "table_id string, query string, name string, place int, period string, at int, value double")
    got = tables.slice_series(df).collect()
    assert {r.name for r in got if r.table_id == "q"} == {"Alpha", "Alpha1", "Alpha2"} and len([r for r in got if r.table_id == "q"]) == 12
    assert sorted(r.at for r in got if r.table_id == "r") == [0, 1] and len([r for r in got if r.table_id == "s"]) == 12


def word(text, x, row, wide=None):
    return text, float(x), row * 14.0, x + (6.0 * len(text) if wide is None else wide), row * 14.0 + 10


def rebuilt(spark, pages, **more):
    rows = [(k, i, *w) for k, words in pages.items() for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "page string, ord int, text string, x0 double, top double, x1 double, bottom double")
    out = {k: {} for k in pages}
    for r in page_tables.rebuilt_cells(df, "page", **more).collect():
        out[r.page][r.row, r.col] = r.cell
    return {k: [[c[i, j] for j in range(1 + max(x for _, x in c))] for i in range(1 + max(y for y, _ in c))] if c else [] for k, c in out.items()}


def test_rebuilt_tables(spark):
    head, sales = [word("2023", 276, 0), word("2024", 376, 0)], [word("Net", 20, 1), word("sales", 60, 1), word("1,200", 270, 1), word("1,300", 370, 1)]
    below = [(t, x, top + 14, x1, bottom + 14) for t, x, top, x1, bottom in sales]
    two = [word("Sales", 20, 1), word("100", 282, 1), word("200", 382, 1)]
    got = rebuilt(
        spark,
        {
            "plain": [*head, *sales, word("Costs", 20, 2), word("900", 282, 2), word("950", 382, 2)],
            "wrapped": [*head, *two, word("Intelligent", 20, 2), word("Solution", 20, 3), word("26,158", 264, 4), word("45,018", 364, 4)],
            "labels below": [*head, *two, word("Other", 20, 2), word("7", 288, 3), word("8", 388, 3), word("(restated)", 20, 4), word("More", 20, 5), word("9", 288, 6)],
            "labels at the end": [*head, *two, word("Notes", 20, 2)],
            "spanning": [word("Group", 260, 0, 160.0), word("2023", 276, 1), word("2024", 376, 1), *below],
            "hole": [*head, *two, word("Costs", 20, 2), word("950", 382, 2)],
            "no header": [word("", 20, 0), word("  ", 80, 0), *sales],
            "no values": [word("only", 10, 0), word("words", 60, 0)],
        },
    )
    assert got["plain"] == [["Metric", "2023", "2024"], ["Net sales", "1,200", "1,300"], ["Costs", "900", "950"]]
    assert got["wrapped"][1:] == [["Sales", "100", "200"], ["Intelligent Solution", "26,158", "45,018"]]
    assert got["labels below"][1:] == [["Sales", "100", "200"], ["Other (restated) More", "7", "8"], ["", "9", ""]]
    assert got["labels at the end"][1:] == [["Sales", "100", "200"], ["Notes", "", ""]]
    assert got["spanning"] == [["Metric", "Group 2023", "Group 2024"], ["Net sales", "1,200", "1,300"]]
    assert got["hole"][1:] == [["Sales", "100", "200"], ["Costs", "", "950"]]
    assert got["no header"] == got["no values"] == []


def test_rows_by_reach(spark):
    # Tops that wander: a row begins where a word lies further from the row's first one than reach allows.
    words = [("2023", 276.0, 0.0, 300.0, 10.0), ("A", 20.0, 14.0, 26.0, 24.0), ("1", 290.0, 20.0, 296.0, 30.0), ("2", 390.0, 20.4, 396.0, 30.4), ("B", 20.0, 28.0, 26.0, 38.0), ("3", 290.0, 28.0, 296.0, 38.0), ("4", 390.0, 28.0, 396.0, 38.0)]
    assert rebuilt(spark, {"p": words})["p"][1:] == [["A", "1", "2"], ["B", "3", "4"]]
    assert rebuilt(spark, {"p": words}, reach=0.3)["p"][1:] == [["", "1", "2"], ["B", "3", "4"]]


def test_acceptance_of_a_grid_as_an_array(spark):
    rng = random.Random(2)
    grids = {"empty": [], "blank": [["", " "], [" ", ""]]}
    for k in range(300):
        width, cells_of = rng.randint(1, 6), rng.choice([["a", "1"], ["a", "1", "", " "], ["t", "t", ""], ["x 1", "y", ""]])
        grids[f"g{k}"] = [[rng.choice(cells_of) for _ in range(max(1, width - (rng.random() < 0.2)))] for _ in range(rng.randint(1, 7))]
    want = {r.table_id: r.reason for r in tables.acceptance(tables.cleaned(cells(spark, grids))).collect()}
    frame = spark.createDataFrame(list(grids.items()), "table_id string, grid array<array<string>>")
    got = {r.table_id: r.reason for r in frame.select("table_id", tables.grid_acceptance(F.col("grid")).alias("reason")).collect()}
    assert got == {k: want.get(k, "no_rows") for k in grids} and len(set(got.values())) >= 7


def test_pages_are_rebuilt_once(spark):
    # Words are shuffled once, no cells are, and a grid is found in one place of the plan; it was shuffled and found several times.
    words = [(k, i, *w) for k in ("near", "far") for i, w in enumerate([word("2023", 276, 0), word("2024", 376, 0), word("Sales", 20, 1), word("100", 282, 1), word("200", 382, 1), word("Costs", 20, 2), word("90", 282, 2), word("95", 382, 2)])]
    # The values of the one page stand below their labels, within reach of the wider rows alone.
    words = [(k, i, t, x0, top + (8.0 if k == "far" and x0 > 200 and top > 0 else 0.0), x1, bottom + (8.0 if k == "far" and x0 > 200 and top > 0 else 0.0)) for k, i, t, x0, top, x1, bottom in words]
    df = spark.createDataFrame(words, "page string, ord int, text string, x0 double, top double, x1 double, bottom double")
    found = page_tables.page_tables(df, "page")
    assert {r.page for r in found.collect()} >= {"near"}
    assert [r.cell for r in found.filter("page = 'near'").orderBy("row", "col").collect()] == ["Metric", "2023", "2024", "Sales", "100", "200", "Costs", "90", "95"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    assert plan.count(page_tables.WRAPPED) == len(page_tables.METHODS)


def test_pages_are_unpacked_by_bytes():
    # A whole batch of up to 10,000 pages was unpacked at once.
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([[{"t": "x" * 4000}] if i % 50 else [{"t": "y" * 200_000}] for i in range(500)])], names=["page", "w"])
    pieces = list(page_tables._pieces(batch, 100_000))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.nbytes <= 100_000 for p in pieces) and len(pieces) < 100
    assert list(page_tables._pieces(batch.slice(0, 0), 100_000)) == []


def test_reading_order_of_two_columns(spark):
    rng = random.Random(1)
    two = [(1, i, x, x + 30, float(row * 14)) for i, (x, row) in enumerate((c + rng.randrange(0, 4) * 50, r) for r in range(10) for c in (20, 330))]
    one = [(2, i, float(x), x + 30.0, float(row * 14)) for i, (x, row) in enumerate((x, r) for r in range(10) for x in range(20, 560, 40))]
    few = [(3, i, 20.0 if i % 2 else 400.0, 50.0 if i % 2 else 430.0, float(i)) for i in range(10)]
    words = spark.createDataFrame([(a, b, float(c), float(d), e) for a, b, c, d, e in [*two, *one, *few]], "page int, ord int, x0 double, x1 double, top double")
    got = {(r.page, r.ord): (r.band, r.place) for r in sequences.reading_order(words, "page", 600.0).collect()}
    bands = [[got[1, i][0] for i in range(len(two)) if (two[i][2] > 300) == side] for side in (False, True)]
    assert set(bands[0]) == {0} and set(bands[1]) == {1}
    assert max(got[1, i][1] for i in range(len(two)) if two[i][2] < 300) < min(got[1, i][1] for i in range(len(two)) if two[i][2] > 300)
    assert {got[2, i][0] for i in range(len(one))} == {got[3, i][0] for i in range(10)} == {0}


def test_sheet_cap_and_images(spark):
    rows = [("q", f"p{i}", 1, "xlsx", "main", "primary", 0.9 - i / 100, 10, 0) for i in range(3)] + [("q", f"s{i}", 1, "xlsx", f"s{i}", "satellite", 0.5 - i / 100, 10, 0) for i in range(6)] + [("q", "text", 1, "pdf", "", None, 0.1, 10, 0)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id int, source_format string, sheet_name string, sheet_role string, score double, length int, priority int")
    assert sorted(r.chunk_id for r in search.cap_sheets(hits).collect()) == ["p0", "s0", "s1", "s2", "s3", "text"]
    assert search.cap_sheets(hits.filter("chunk_id in ('p0', 'p1', 's0')")).count() == 3
    near = hits.withColumn("priority", F.when(F.col("chunk_id") == "p2", 2).otherwise(0))
    assert "p2" in {r.chunk_id for r in search.cap_sheets(near).collect()}
    images = spark.createDataFrame([("q", "i1", True, 0.9, 1, 1, 0.0, 0.0, 10.0, 10.0), ("q", "i2", True, 0.8, 1, 1, 0.0, 0.0, 10.0, 9.0), ("q", "n1", False, 0.95, 2, 1, 0.0, 0.0, 10.0, 10.0), ("q", "n2", False, 0.5, 2, 1, 50.0, 0.0, 60.0, 10.0)], "query_id string, image_id string, intent boolean, score double, doc_id int, page int, x0 double, top double, x1 double, bottom double")
    assert [r.image_id for r in search.display_images(images).orderBy("place").collect()] == ["i1", "n1"]


def test_workbook_roles(spark):
    sheets = {
        "titles": spark.createDataFrame([(str(i), f"t{i}") for i in range(20)], "id string, title string"), "cast": spark.createDataFrame([(str(i % 20), f"a{i}") for i in range(60)], "show_id string, actor string"),
        "countries": spark.createDataFrame([(str(i), f"c{i % 3}") for i in range(18)], "sid string, country string"), "notes": spark.createDataFrame([("n1", "zz")], "note string, x string"),
    }
    joins = workbook.pair_joins(workbook.column_overlaps(sheets))
    roles = {(r["sheet"], r["col"], r["hub"], r["hub_col"]) for r in workbook.assign_roles(joins)}
    assert roles == {("cast", "show_id", "titles", "id"), ("countries", "sid", "titles", "id")}


def test_digest_and_states(spark):
    long = [(1, "a.pdf", "pdf", i, 0, "text" if i % 2 else "table", f"Section {i} " + "x" * 200, None, None) for i in range(1, 12)]
    sheet = [(2, "b.xlsx", "xlsx", i, 0, "table", "ignored", None, s) for i, s in enumerate(["Main", "main", "Cast"], 1)]
    chunks = spark.createDataFrame([*long, *sheet], "doc_id int, filename string, source_format string, page_number int, block_index int, chunk_type string, section string, subsection string, sheet_name string")
    got = {r.doc_id: r for r in library.digests(chunks).collect()}
    assert got[1].digest.startswith("File: a.pdf (pdf)\nSize: 11 pages\nChunk types: table=5, text=6\nSections:\n- Section 1 ") and got[1].digest.endswith("\n...") and len(got[1].digest) <= 905 and len(got[1].sections) == 8
    assert got[2].digest == "File: b.xlsx (xlsx)\nSize: 3 sheets\nChunk types: table=3\nSheets: Main, Cast"


def test_routing_and_gates(spark):
    asked = ["how many films", "what did the chairman say in the pdf", "revenue in the document", "show orders please", "hello", "describe the image"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r[0] for r in df.select(policy.sql_route(F.col("q"), ["Orders"])).collect()] == ["sql", None, "hybrid", "sql", None, None]
    turns = spark.createDataFrame([([], 3), (["search_documents"], 3), (["query_database"], 3), (["query_database"], 0), (["search_documents", "query_database"], 3), (["list_documents"], 3)], "t array<string>, n int")
    yes = F.lit(True)
    got = turns.select(policy.stop_after_tools(F.col("t"), yes, yes, F.col("n")), policy.needs_documents(F.col("t"), yes, F.col("n")), policy.needs_database(F.col("t"), yes)).collect()
    assert list(map(tuple, got)) == [(False, False, False), (False, False, True), (False, True, False), (True, False, False), (True, False, False), (False, False, False)]
    calls = spark.createDataFrame([("SELECT 1",), ("DROP TABLE x",)], "sql string")
    assert [(r.allowed, r.reason) for r in policy.tool_gate(calls, "sql").collect()] == [(True, None), (False, "not a query")]


def test_profiles_and_anchor_phrases(spark):
    df = spark.createDataFrame([(1, 'tell me about the movie The Long Road, please: "Blue Moon"'), (2, "the of"), (3, None)], "k int, t string")
    got = {r.k: r for r in phrases.match_profiles(df, "k", "t").collect()}
    assert {"blue moon", "the long road", "long road"} & set(got[1].phrases) and {"movie", "long", "road", "blue", "moon"} <= set(got[1].tokens)
    assert got[2].phrases == got[2].tokens == got[3].phrases == got[3].tokens == []
    q = spark.createDataFrame([("who made it", ["I like The Long Road"]), ("about The Long Road", ["The Long Road"]), (" ", ["The Long Road"])], "q string, e array<string>")
    assert [r[0] for r in q.select(phrases.merge_anchor_phrases(F.col("q"), F.col("e"))).collect()] == ["The Long Road who made it", "about The Long Road", " "]


def test_mojibake(spark):
    from docloom.functions.text import repair_mojibake

    good = ["Bank’s “view” – naïve", "déjà vu", "plain", "", None, "漢字 😀", "Ärger über Öl", "cost 5€", "Ã is a letter", "©®"]
    broken = [x and x.encode().decode("latin-1") for x in good[:3]] + ["Bankâ€™s", "Ã¼ber"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(broken + good)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(repair_mojibake(F.col("x"))).collect()]
    assert got == good[:3] + ["Bank’s", "über"] + good


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-02 10:00:00")], "id int, what string, at string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        logs.append_log(rows, str(tmp_path / "log"), "at", ["id"])
    logs.append_log(rows.withColumn("id", F.col("id") + 10), str(tmp_path / "log"), "at", ["id"])
    assert sorted(r.id for r in logs.read_log(spark, str(tmp_path / "log")).collect()) == [1, 2, 11, 12]
    assert sorted(r.id for r in logs.read_log(spark, str(tmp_path / "log"), "2024-01-02").collect()) == [2, 12]
