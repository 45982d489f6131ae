"""Tables as series: layout tests, unpivot and pivot, slicing and chart specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.numeric import parse_number, period_key

MAX_PERIODS, MAX_SERIES = 12, 8


def cells(grids: DataFrame, key: str = "table_id", grid: str = "grid") -> DataFrame:
    """(key, row, col, cell) of grids whose row 0 is the header; short rows are padded with ''."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    padded = F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rows = grids.select(key, F.posexplode(padded).alias("row", "r"))
    return rows.select(key, "row", F.posexplode("r").alias("col", "cell"))


def column_roles(grid_cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, col, header, period, role): label for column 0, then period, annotation (short, empty or mostly per cent) or other."""
    body = F.col("row") > 0
    filled = body & (F.trim("cell") != "")
    each = grid_cells.groupBy(key, "col").agg(F.max(F.when(F.col("row") == 0, F.trim("cell"))).alias("header"), F.count_if(filled).alias("n"), F.count_if(filled & F.col("cell").contains("%")).alias("p"))
    period = period_key(F.col("header"))
    note = F.col("header").rlike("^[A-Za-z]{1,3}$") | ((F.col("header") == "") & (F.col("n") == 0)) | ((F.col("n") > 0) & (F.col("p") >= 0.75 * F.col("n")))
    role = F.when(F.col("col") == 0, "label").when(period.isNotNull(), "period").when(note, "annotation").otherwise("other")
    return each.select(key, "col", "header", period.alias("period"), role.alias("role"))


def wide_layouts(roles: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, periods) of tables with three columns or more, two periods at least and no other column."""
    each = roles.groupBy(key).agg(F.count("*").alias("width"), F.count_if(F.col("role") == "other").alias("other"), F.count_distinct(F.when(F.col("role") == "period", F.col("period"))).alias("periods"))
    return each.filter("width >= 3 and other = 0 and periods >= 2").select(key, "periods")


def wide_series(grid_cells: DataFrame, roles: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, name, periods, values): a series for each row all of whose period cells are numbers; of columns with the same period the first counts."""
    chosen = roles.filter("role = 'period'").groupBy(key, "period").agg(F.min("col").alias("col"))
    names = grid_cells.filter("row > 0 and col = 0").select(key, "row", F.trim("cell").alias("name")).filter("name <> ''")
    data = grid_cells.filter("row > 0").join(chosen, [key, "col"]).withColumn("v", parse_number(F.col("cell")))
    rows = data.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("period", "v"))).alias("x"), F.count_if(F.col("v").isNull()).alias("holes")).filter("holes = 0")
    return rows.join(names, [key, "row"]).select(key, "row", "name", F.transform("x", lambda p: p["period"]).alias("periods"), F.transform("x", lambda p: p["v"]).alias("values"))


def long_series(rows: DataFrame, period: str, metrics: list[str]) -> DataFrame:
    """(metric, periods, values) of a table with one row a period."""
    melted = rows.unpivot([period], metrics, "metric", "value")
    packed = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col("value").cast("double").alias("v"))))
    return melted.groupBy("metric").agg(packed.alias("x")).select("metric", F.transform("x", lambda a: a["p"]).alias("periods"), F.transform("x", lambda a: a["v"]).alias("values"))


def chart_type(series: Column, periods: Column) -> Column:
    return F.when((series == 1) & (periods >= 3), "line").otherwise("bar")


def spread(values: Column) -> Column:
    """Largest over smallest magnitude of the values that aren't 0; null without any."""
    sizes = F.filter(F.transform(values, lambda v: F.abs(v)), lambda v: v > 0)
    return F.array_max(sizes) / F.array_min(sizes)


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) / 2).cast("int")))


def spec_error(kind: Column, labels: Column, series: Column) -> Column:
    """The first thing wrong with a chart: its kind, labels, series or their widths; null for a good one."""
    return (
        F.when(~kind.isin("bar", "line"), "unsupported chart type")
        .when(~F.size(labels).between(1, MAX_PERIODS), "labels out of bounds")
        .when(~F.size(series).between(1, MAX_SERIES), "series out of bounds")
        .when(F.exists(series, lambda s: F.size(s["values"]) != F.size(labels)), "widths differ")
        .when(F.exists(series, lambda s: F.exists(s["values"], lambda v: v.isNull())), "missing value")
    )


def chart_json(kind: Column, labels: Column, series: Column) -> Column:
    datasets = F.transform(series, lambda s: F.struct(s["name"].alias("label"), s["values"].alias("data")))
    return F.to_json(F.struct(kind.alias("type"), F.struct(labels.alias("labels"), datasets.alias("datasets")).alias("data")))
