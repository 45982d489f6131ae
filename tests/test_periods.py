"""Periods of headers, found without making a label anew for each rule."""

from pyspark.sql import functions as F

from docloom.functions.numeric import parse_number, period_key
from docloom.operators import tables


def test_period_keys_and_numbers(spark):
    labels = [None, "", "  ", "2023", "FY 2023", "cy2024", "3023", "Q3  2024", "h1", "H3", "P12", "t1", "12-A", "12.5%", "1,200", "sales 2019", "2019 to 2020", "x" * 45 + " 2019", "5-LOW 3", "12019"]
    frame = spark.createDataFrame([(x,) for x in labels], "t string")
    got = [r[0] for r in frame.select(period_key(F.col("t"))).collect()]
    assert got == [None, None, None, "2023", "2023", "2024", None, "Q32024", "H1", None, "P12", "T1", "12-A", None, None, "2019", None, None, None, None]
    cells = ["1,200", "($3.5)", "7%", "", "x", None, "-4"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in cells], "t string").select(parse_number(F.col("t"))).collect()] == [1200.0, -3.5, 7.0, None, None, None, None]


def test_a_label_is_made_once_for_all_rules(spark):
    frame = spark.createDataFrame([("a",)], "t string")
    assert frame.select(period_key(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t") == 1


def test_prepared_cells_chart_as_plain_ones(spark):
    rows = [["Metric", "2023", "2024", "YoY"], ["a", "1", "2", "5%"], ["b", "3", "(4)", "6%"]]
    cells = spark.createDataFrame([(1, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], "table_id long, row int, col int, cell string")
    ready = tables.prepared(cells)
    assert tables.prepared(ready) is ready and {"value", "period"} <= set(ready.columns)
    for find in (lambda x: tables.series(x, tables.column_profiles(x)), tables.chart_profiles, tables.chart_attempts):
        got, want = sorted(find(ready).collect()), sorted(find(cells).collect())
        assert got == want and got
