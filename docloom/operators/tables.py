"""Rules over grids of cells: acceptance, label columns, header rows, layouts, their scores and what can be charted.

A grid is rows (key, row, col, cell), row 0 the header. Everything is grouped by table, row or column, so tables of any size
are summed before a shuffle; only orders of one table's rows and columns are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.numeric import is_financial_value, is_numeric_like, once, parse_number, period_key
from docloom.functions.text import normalize_whitespace
from docloom.sources.folders import staged

#: Thresholds of the rules.
MISALIGNED, LABELLED, EMPTY_COLUMNS, DISTINCT_HEADERS, NUMERIC_CELLS = 0.15, 0.9, 0.5, 0.5, 0.15
LABEL_HEADERS = ["country", "nation", "region", "name", "entity", "year", "rank", "id", "#"]
MAX_LABELS, MAX_SERIES, ORIENTATION_DELTA = 12, 8, 0.25


def prepared(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells with value, their number, and of headers and labels period, staged: charts read them several times. Prepared cells stay as they are."""
    if "value" in cells.columns:
        return cells
    named = F.when((F.col("row") == 0) | (F.col("col") == 0), period_key(F.col("cell")))
    return staged(cells.select(key, "row", "col", "cell", parse_number(F.col("cell")).alias("value"), named.alias("period")))


def _value(cells: DataFrame) -> Column:
    return F.col("value") if "value" in cells.columns else parse_number(F.col("cell"))


def _period(cells: DataFrame) -> Column:
    """Of a label's or header's cell."""
    return F.col("period") if "period" in cells.columns else period_key(F.col("cell"))


def cleaned(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells with white space collapsed; rows without text go, and the others are numbered anew from 0."""
    each = cells.select(key, "row", "col", normalize_whitespace(F.col("cell")).alias("cell"))
    kept = each.groupBy(key, "row").agg(F.max(F.col("cell") != "").alias("_any")).filter("_any")
    kept = kept.select(key, "row", (F.row_number().over(Window.partitionBy(key).orderBy("row")) - 1).alias("_new"))
    return each.join(kept, [key, "row"]).select(key, F.col("_new").alias("row"), "col", "cell")


def acceptance(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, reason) of every grid: the first rule that it breaks, null for an acceptable table."""
    full = F.col("cell") != ""
    rows = cells.groupBy(key, "row").agg(F.count("*").alias("width"), F.max((F.col("col") == 0) & full).alias("labelled"))
    head = rows.filter("row = 0").select(key, F.col("width").alias("head"))
    shape = rows.join(head, key).groupBy(key).agg(F.count("*").alias("n_rows"), F.max("head").alias("head"), F.count_if((F.col("row") > 0) & (F.col("width") != F.col("head"))).alias("odd"), F.count_if((F.col("row") > 0) & F.col("labelled")).alias("labelled"))
    columns = cells.groupBy(key, "col").agg(F.max(F.when(F.col("row") == 0, F.col("cell"))).alias("header"), F.count_if((F.col("row") > 0) & full).alias("filled"), F.count_if((F.col("row") > 0) & F.col("cell").rlike("[0-9]")).alias("digits"))
    empty = (F.col("col") > 0) & F.col("header").isNotNull() & (F.col("filled") == 0)
    named = F.coalesce(F.col("header") != "", F.lit(False))
    summed = columns.groupBy(key).agg(F.count_if(empty).alias("empty"), F.count_if(empty & named).alias("lost"), F.count_if(named).alias("heads"), F.count_distinct(F.when(named, F.col("header"))).alias("kinds"), F.sum("filled").alias("filled"), F.sum("digits").alias("digits"))
    return shape.join(summed, key).select(key, _reason(*[F.col(c) for c in ("n_rows", "head", "odd", "labelled", "empty", "lost", "heads", "kinds", "filled", "digits")]).alias("reason"))


def _reason(n_rows: Column, head: Column, odd: Column, labelled: Column, empty: Column, lost: Column, heads: Column, kinds: Column, filled: Column, digits: Column) -> Column:
    """The first rule that a grid of these counts breaks."""
    data = n_rows - 1
    return (
        F.when(n_rows < 2, "too_few_rows")
        .when(odd > MISALIGNED * data, "misalignment")
        .when(labelled < LABELLED * data, "label_column_sparse")
        .when(lost > 0, "empty_data_column")
        .when((head >= 4) & (empty > EMPTY_COLUMNS * (head - 1)), "column_collapse")
        .when((heads >= 3) & (kinds < DISTINCT_HEADERS * heads), "degenerate_header")
        .when((filled >= 6) & (digits < NUMERIC_CELLS * filled), "no_tabular_data")
    )


def grid_acceptance(grid: Column) -> Column:
    """The reason that acceptance(cleaned()) gives for a grid that is an array of rows of cells, none of them null; 'no_rows' where no cell has text."""

    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def judged(rows):
        return let(F.get(rows, F.lit(0)), lambda header: let(F.slice(rows, 2, F.size(rows)), lambda data: counted(rows, header, data)))

    def counted(rows, header, data):
        cells = F.flatten(data)
        named = F.filter(header, lambda h: h != "")
        # Of the header's columns beyond the first those without text below.
        empty = F.filter(F.transform(header, lambda h, j: F.when((j > 0) & ~F.exists(data, lambda r: F.coalesce(F.get(r, j) != "", F.lit(False))), h)), lambda h: h.isNotNull())
        counts = {
            "n_rows": F.size(rows), "head": F.size(header), "odd": F.size(F.filter(data, lambda r: F.size(r) != F.size(header))), "labelled": F.size(F.filter(data, lambda r: F.get(r, F.lit(0)) != "")),
            "empty": F.size(empty), "lost": F.size(F.filter(empty, lambda h: h != "")), "heads": F.size(named), "kinds": F.size(F.array_distinct(named)),
            "filled": F.size(F.filter(cells, lambda c: c != "")), "digits": F.size(F.filter(cells, lambda c: c.rlike("[0-9]"))),
        }
        return let(F.struct(*[c.alias(n) for n, c in counts.items()]), lambda x: _reason(*[x[n] for n in counts]))

    told = F.filter(F.transform(grid, lambda r: F.transform(r, normalize_whitespace)), lambda r: F.exists(r, lambda c: c != ""))
    return let(told, lambda rows: F.when(F.size(rows) == 0, "no_rows").otherwise(judged(rows)))


def label_columns(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, label_col, empty_ratio, numeric_ratio, label_loss): the column that holds row labels by the kinds of its cells, and whether the grid lost them."""
    data = cells.filter("row > 0")
    full, number = F.col("cell") != "", is_numeric_like(F.col("cell"))
    rows = cells.groupBy(key).agg(F.count_distinct(F.when(F.col("row") > 0, F.col("row"))).alias("n"))
    each = data.groupBy(key, "col").agg(F.count_if(full).alias("filled"), F.count_if(full & number).alias("numbers"))
    score = (F.col("filled") - 2 * F.col("numbers")) / F.nullif(F.col("filled"), F.lit(0))
    best = each.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct("col", "filled", "score"), F.when(F.col("filled") > 0, F.struct("score", -F.col("col")))).alias("best"), F.sum("filled").alias("filled"), F.sum("numbers").alias("numbers"))
    joined = rows.join(best, key, "left").withColumn("best", F.when(F.col("best.score") > 0.3, F.col("best")))
    empty = F.when(F.col("best").isNull(), 1.0).otherwise(1 - F.col("best.filled") / F.nullif(F.col("n"), F.lit(0)))
    numeric = F.coalesce(F.col("numbers") / F.nullif(F.col("filled"), F.lit(0)), F.lit(0.0))
    out = joined.select(key, "n", F.col("best.col").alias("label_col"), F.coalesce(empty, F.lit(0.0)).alias("empty_ratio"), numeric.alias("numeric_ratio"))
    loss = ((F.col("n") >= 4) & (F.col("numeric_ratio") >= 0.6) & (F.col("empty_ratio") >= 0.6)) | ((F.col("n") >= 3) & (F.col("numeric_ratio") <= 0.05))
    return out.withColumn("label_loss", loss).drop("n")


def labels_first(cells: DataFrame, labels: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells with each grid's label column moved to the front. labels: as label_columns gives them."""
    at = F.col("label_col")
    col = F.when(at.isNull() | (at <= 0) | (F.col("col") > at), F.col("col")).when(F.col("col") == at, 0).otherwise(F.col("col") + 1)
    return cells.join(labels.select(key, "label_col"), key, "left").select(key, "row", col.cast("int").alias("col"), "cell")


def header_spans(cells: DataFrame, key: str = "table_id", sample: int = 5) -> DataFrame:
    """(key, first, end): the header's rows of a sheet, from first to before end.

    Title rows (one filled cell at most) are skipped. The row after the first header row belongs to it if the rows below are
    mostly numbers, it isn't, and it is filled as well as the header.
    """
    full = F.col("cell") != ""
    number = F.col("cell").rlike("^\\(?-?[\\d,]+\\.?\\d*\\)?%?$")
    rows = cells.groupBy(key, "row").agg(F.count_if(full).alias("filled"), F.count("*").alias("width"), F.count_if(full & number).alias("numbers"))
    rows = rows.withColumn("share", F.coalesce(F.col("numbers") / F.nullif(F.col("filled"), F.lit(0)), F.lit(0.0))).withColumn("fill", F.col("filled") / F.col("width"))
    first = rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("filled") > 1, F.col("row"))), F.min("row")).alias("first"))
    placed = rows.join(first, key).withColumn("_at", F.col("row") - F.col("first"))
    one = placed.groupBy(key, "first").agg(F.max(F.when(F.col("_at") == 0, F.col("fill"))).alias("f0"), F.max(F.when(F.col("_at") == 1, F.col("fill"))).alias("f1"), F.max(F.when(F.col("_at") == 1, F.col("share"))).alias("s1"), F.avg(F.when(F.col("_at").between(2, 1 + sample), F.col("share"))).alias("body"))
    two = F.coalesce((F.col("body") >= 0.5) & (F.col("s1") <= 0.2) & (F.col("f1") >= F.col("f0")), F.lit(False))
    return one.select(key, "first", (F.col("first") + F.when(two, 2).otherwise(1)).alias("end"))


def composed_headers(cells: DataFrame, spans: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, col, header) of sheets: one row's cells, or of two rows the group label (which goes on to the right until the next one) and the label below it."""
    head = cells.join(spans, key).filter((F.col("row") >= F.col("first")) & (F.col("row") < F.col("end"))).withColumn("_two", F.col("end") - F.col("first") > 1)
    upper = F.last_value(F.nullif(F.trim("cell"), F.lit("")), F.lit(True)).over(Window.partitionBy(key, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    filled = head.withColumn("_cell", F.when(F.col("_two") & (F.col("row") == F.col("first")), F.coalesce(upper, F.lit(""))).otherwise(F.trim("cell")))
    each = filled.groupBy(key, "col").agg(F.max(F.when(F.col("row") == F.col("first"), F.col("_cell"))).alias("a"), F.max(F.when(F.col("row") > F.col("first"), F.col("_cell"))).alias("b"))
    both = F.filter(F.array_distinct(F.array_compact(F.array("a", "b"))), lambda x: x != "")
    return each.select(key, "col", F.array_join(both, " ").alias("header"))


def annotation(header: Column, filled: Column, shares: Column) -> Column:
    """A column that only comments on others. filled: its cells with text; shares: those that are per cent."""
    plain = F.when(header == "", filled == 0).otherwise(header.rlike("^\\p{L}{1,3}$") | (filled == 0) | (shares >= 0.75 * filled))
    return period_key(header).isNull() & plain


def column_profiles(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, col, header, period, annotation, filled, numbers) of every column; for what a label column is: years, small, text too."""
    data, text = F.col("row") > 0, F.col("cell") != ""
    value = _value(cells)
    each = cells.groupBy(key, "col").agg(
        F.coalesce(F.max(F.when(F.col("row") == 0, F.col("cell"))), F.lit("")).alias("header"),
        F.count_if(data & text).alias("filled"),
        F.count_if(data & text & value.isNotNull()).alias("numbers"),
        F.count_if(data & F.col("cell").contains("%") & value.isNotNull()).alias("_shares"),
        F.count_if(data & value.between(1900, 2099)).alias("years"),
        F.count_if(data & (value == F.floor(value)) & (value < 1000)).alias("small"),
        F.count_distinct(F.when(data, value)).alias("values"),
    )
    period = period_key(F.col("header"))
    return each.withColumn("period", period).withColumn("annotation", annotation(F.col("header"), F.col("filled"), F.col("_shares"))).drop("_shares")


def wide(profiles: DataFrame, key: str = "table_id") -> DataFrame:
    """Keys of grids with a row a metric and a column a period: three columns at least, each period or annotation."""
    other = F.count_if((F.col("col") > 0) & ~F.col("annotation") & F.col("period").isNull())
    periods = F.count_distinct(F.when((F.col("col") > 0) & ~F.col("annotation"), F.col("period")))
    return profiles.groupBy(key).agg(F.count("*").alias("width"), other.alias("other"), periods.alias("n_periods")).filter("width >= 3 and other = 0 and n_periods >= 2").select(key, "n_periods")


def long(cells: DataFrame, profiles: DataFrame, key: str = "table_id") -> DataFrame:
    """Keys of grids with a row a period and a column a metric: distinct periods, distinct named metrics, annotations aside."""
    metric = (F.col("col") > 0) & ~F.col("annotation")
    bad = metric & ((F.col("header") == "") | F.col("period").isNotNull())
    columns = profiles.groupBy(key).agg(F.count("*").alias("width"), F.count_if(bad).alias("bad"), F.count_if(metric).alias("metrics"), F.count_distinct(F.when(metric, F.col("header"))).alias("kinds"))
    label = cells.filter("row > 0 and col = 0").withColumn("period", _period(cells))
    rows = label.groupBy(key).agg(F.count("*").alias("n"), F.count("period").alias("named"), F.count_distinct("period").alias("n_periods"))
    return columns.join(rows, key).filter("width >= 3 and bad = 0 and metrics >= 1 and kinds = metrics and n >= 2 and named = n and n_periods = n").select(key, "n_periods", "metrics")


def period_cells(cells: DataFrame, profiles: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row, name, col, period, value, share) of the data cells below period columns; of columns of one period the first."""
    chosen = profiles.filter("col > 0 and not annotation and period is not null").groupBy(key, "period").agg(F.min("col").alias("col"))
    names = cells.filter("row > 0 and col = 0").select(key, "row", F.col("cell").alias("name"))
    data = cells.filter("row > 0").select(key, "row", "col", "cell", _value(cells).alias("value")).join(chosen, [key, "col"]).join(names, [key, "row"])
    value = F.col("value")
    return data.select(key, "row", "name", "col", "period", value.alias("value"), (F.col("cell").contains("%") & value.isNotNull()).alias("share"))


def layout_scores(cells: DataFrame, profiles: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, wide_score, long_score): null where a grid has not that layout, or too few labels or numbers for it."""
    label = cells.filter("row > 0 and col = 0")
    metric = (F.col("cell") != "") & _period(cells).isNull() & ~is_financial_value(F.col("cell"))
    named = label.groupBy(key).agg(F.avg(metric.cast("double")).alias("labels"))
    numeric = period_cells(cells, profiles, key).groupBy(key).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("numbers"))
    w = wide(profiles, key).join(named, key).join(numeric, key).filter("labels >= 0.6 and numbers >= 0.75")
    w = w.select(key, ((F.col("labels") + F.col("numbers") + 1) / 3).alias("wide_score"))
    metrics = profiles.filter("col > 0 and not annotation").select(key, "col")
    below = cells.filter("row > 0").join(metrics, [key, "col"]).groupBy(key).agg(F.avg(_value(cells).isNotNull().cast("double")).alias("numbers"))
    x = long(cells, profiles, key).join(below, key).filter("numbers >= 0.75").select(key, ((F.col("numbers") + 1) / 2).alias("long_score"))
    return w.join(x, key, "full_outer")


def series(cells: DataFrame, profiles: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, orientation, name, place, points) of wide and long grids; points: array of (period, value) in the order of periods.

    A wide row without a name, with a number for one, mostly per cent, or with a hole is no series; a long grid with a hole has none.
    """
    point = F.struct(_place(F.col("period")).alias("_place"), "period", "value")
    rows = period_cells(cells, profiles, key).join(wide(profiles, key).select(key), key)
    each = rows.groupBy(key, "row", "name").agg(F.array_sort(F.collect_list(point)).alias("points"), F.count_if(F.col("value").isNull()).alias("holes"), F.avg(F.col("share").cast("double")).alias("shares"))
    w = each.filter((F.col("name") != "") & ~is_financial_value(F.col("name")) & (F.col("holes") == 0) & (F.col("shares") < 0.75))
    w = w.select(key, F.lit("wide").alias("orientation"), "name", F.col("row").alias("place"), "points")
    labels = cells.filter("row > 0 and col = 0").select(key, "row", _period(cells).alias("period"))
    metrics = profiles.filter("col > 0 and not annotation").select(key, "col", F.col("header").alias("name"))
    numbers = cells.filter("row > 0").select(key, "row", "col", _value(cells).alias("value"))
    data = numbers.join(metrics, [key, "col"]).join(labels, [key, "row"]).join(long(cells, profiles, key).select(key), key)
    x = data.groupBy(key, "col", "name").agg(F.array_sort(F.collect_list(point)).alias("points"), F.count_if(F.col("value").isNull()).alias("holes"))
    whole = x.groupBy(key).agg(F.sum("holes").alias("_holes")).filter("_holes = 0").select(key)
    x = x.join(whole, key).select(key, F.lit("long").alias("orientation"), "name", F.col("col").alias("place"), "points")
    return w.unionByName(x).withColumn("points", F.transform("points", lambda p: F.struct(p["period"].alias("period"), p["value"].alias("value"))))


def _place(label: Column) -> Column:
    """The place of a period in the order of periods, as a struct."""

    def place(found: Column) -> Column:
        year = F.when(found.rlike("^\\d+$"), found.cast("long"))
        return F.struct(F.when(year.isNotNull(), 0).otherwise(1).alias("_kind"), F.coalesce(year, F.lit(0)).alias("_year"), F.when(year.isNull(), label).otherwise("").alias("_label"))

    return once(period_key(label), place)


def period_order(label: Column) -> tuple[Column, Column, Column]:
    """The order of periods: years by number, then other labels by their text."""
    place = _place(label)
    return place["_kind"], place["_year"], place["_label"]


def chart_profiles(cells: DataFrame, key: str = "table_id", profiles: DataFrame | None = None) -> DataFrame:
    """(key, orientation, period_count, metric_count, chart_type) of grids that reduce to metrics by periods.

    Where both layouts fit about equally, where no series is left, or where a series sums to about 100 (a composition), there is none.
    """
    cells = prepared(cells, key)
    profiles = staged(column_profiles(cells, key)) if profiles is None else profiles
    scores = layout_scores(cells, profiles, key)
    w, x = F.col("wide_score"), F.col("long_score")
    chosen = scores.filter(w.isNull() | x.isNull() | (F.abs(w - x) >= ORIENTATION_DELTA)).select(key, F.when(x.isNull() | (w > x), "wide").otherwise("long").alias("orientation"))
    values = F.transform("points", lambda p: p["value"])
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    composed = (F.size("points") >= 3) & F.forall(values, lambda v: v.between(0, 100)) & total.between(90, 110)
    each = series(cells, profiles, key).join(chosen, [key, "orientation"]).groupBy(key, "orientation").agg(F.max(F.size("points")).alias("period_count"), F.count("*").alias("metric_count"), F.max(composed).alias("_composed"))
    kind = F.when((F.col("metric_count") == 1) & (F.col("period_count") >= 3), "line").otherwise("bar")
    return each.filter(~F.col("_composed") & (F.col("period_count") >= 2)).select(key, "orientation", F.col("period_count").cast("long").alias("period_count"), "metric_count", kind.alias("chart_type"))


def entity_grids(cells: DataFrame, key: str = "table_id", profiles: DataFrame | None = None) -> DataFrame:
    """(key, col, metric, place) of the metric columns of grids with a row an entity: no period among headers, two metrics at least.

    The first column names the entity; annotations, label columns and mostly textual ones are no metrics.
    """
    cells = prepared(cells, key)
    profiles = staged(column_profiles(cells, key)) if profiles is None else profiles
    full = F.col("filled")
    text = 1 - F.col("numbers") / F.nullif(full, F.lit(0))
    whole = (full > 0) & (F.col("numbers") == full)
    years = whole & ((F.lower("header") == "year") | (F.col("years") == full))
    label = F.lower(F.trim("header")).isin(LABEL_HEADERS) | (full == 0) | F.when(years, F.col("values") <= F.greatest(F.lit(1), F.floor(full / 2))).when(whole & (F.col("small") == full), True).otherwise(text >= 0.5)
    metric = (F.col("col") > 0) & ~F.col("annotation") & ~label & (F.col("numbers") >= 0.5 * full)
    shaped = wide(profiles, key).select(key).union(long(cells, profiles, key).select(key))
    rows = cells.groupBy(key).agg(F.max("row").alias("_rows")).filter("_rows > 0").select(key)
    each = profiles.withColumn("metric", metric).join(shaped, key, "left_anti").join(rows, key)
    good = each.groupBy(key).agg(F.count("*").alias("width"), F.count_if((F.col("col") > 0) & F.col("period").isNotNull()).alias("periods"), F.count_if("metric").alias("metrics"), F.count_if(F.col("metric") & (F.col("header") == "")).alias("unnamed"))
    good = good.filter("width >= 3 and periods = 0 and metrics >= 2 and unnamed = 0").select(key)
    place = F.row_number().over(Window.partitionBy(key).orderBy("col"))
    return each.filter("metric").join(good, key).select(key, "col", F.col("header").alias("metric"), place.alias("place"))


def slice_limit(query: Column, most: int = MAX_LABELS) -> Column:
    """The first whole number from 1 to most among the words of a query."""
    numbers = F.transform(F.filter(F.split(query, "\\s+"), lambda t: t.rlike("^[0-9]{1,9}$")), lambda t: t.cast("int"))
    return F.get(F.filter(numbers, lambda n: n.between(1, most)), F.lit(0))


def name_overlap(query: Column, name: Column, digits: bool = False) -> Column:
    """The share of the query's distinct words that stand in a name; numbers of the query aside unless digits."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda t: t != ""))
    asked = words(query) if digits else F.filter(words(query), lambda t: ~t.rlike("^[0-9]+$"))
    return once(asked, lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, words(name))) / F.size(a)).otherwise(0.0))


def without_total(query: Column, name: Column) -> Column:
    """False for a series named total, unless the query says total."""
    return F.lower(query).contains("total") | (F.lower(F.trim(name)) != "total")


def metric_choice(metrics: DataFrame, key: str = "table_id", query: str = "query") -> DataFrame:
    """metrics (key, query, col, metric) that a query asks for, with pick from 1: the named ones, best first, else all; at most the number it says."""
    each = metrics.filter(without_total(F.col(query), F.col("metric"))).withColumn("_s", name_overlap(F.col(query), F.col("metric"), True))
    w = Window.partitionBy(key, query)
    each = each.withColumn("_top", F.max("_s").over(w)).filter((F.col("_top") == 0) | (F.col("_s") > 0))
    pick = F.row_number().over(w.orderBy(F.desc("_s"), "col"))
    return each.withColumn("pick", pick).filter(F.col("pick") <= F.coalesce(slice_limit(F.col(query)), F.lit(MAX_LABELS))).drop("_s", "_top")


def slice_series(points: DataFrame, key: str = "table_id", query: str = "query") -> DataFrame:
    """The points that a query and the output's caps leave of charts. points: key, query, name, place (of the series), period, at (of the period from 0), value.

    A number in the query cuts the larger side: series if there are as many as periods, else periods. Periods, then series,
    that the query names win over the first ones.
    """
    w = Window.partitionBy(key, query)
    asked = F.col(query)
    each = points.withColumn("_limit", slice_limit(asked)).withColumn("_ns", F.size(F.collect_set("place").over(w))).withColumn("_np", F.size(F.collect_set("at").over(w)))
    each = each.withColumn("_series", F.col("_limit").isNotNull() & (F.col("_ns") >= F.col("_np")) & (F.col("_ns") > 1))
    each = each.withColumn("_p", (name_overlap(asked, F.col("period")) > 0) & ~F.col("_series")).withColumn("_any_p", F.max("_p").over(w))
    most = F.when(F.col("_series"), F.lit(MAX_LABELS)).otherwise(F.coalesce("_limit", F.lit(MAX_LABELS)))
    each = each.filter(F.when(F.col("_any_p"), F.col("_p")).otherwise(F.col("at") < most))
    each = each.withColumn("_s", name_overlap(asked, F.col("name")) > 0).withColumn("_any_s", F.max("_s").over(w)).filter(~F.col("_any_s") | F.col("_s"))
    rank = F.dense_rank().over(w.orderBy("place"))
    return each.withColumn("_r", rank).filter(F.col("_r") <= F.coalesce("_limit", F.lit(MAX_SERIES))).select(*points.columns)


def pies(cells: DataFrame, key: str = "table_id", profiles: DataFrame | None = None) -> DataFrame:
    """(key, layout, slices, total) of grids that are one value for each of 2 to 12 categories: two columns, or one period column among others."""
    profiles = column_profiles(cells, key) if profiles is None else profiles
    shape = profiles.groupBy(key).agg(F.count("*").alias("width"), F.count_if((F.col("col") > 0) & F.col("period").isNotNull()).alias("periods"), F.min(F.when((F.col("col") > 0) & F.col("period").isNotNull(), F.col("col"))).alias("period_col"))
    shape = shape.filter("width = 2 or periods = 1").select(key, F.when(F.col("width") == 2, "category_value").otherwise("snapshot").alias("layout"), F.when(F.col("width") == 2, 1).otherwise(F.col("period_col")).alias("_at"))
    body = cells.filter("row > 0").join(shape, key)
    value = _value(cells)
    label = F.max(F.when(F.col("col") == 0, F.col("cell")))
    rows = body.groupBy(key, "layout", "row").agg(label.alias("label"), F.max(F.when(F.col("col") == F.col("_at"), value)).alias("value"))
    good = F.coalesce((F.col("label") != "") & ~is_financial_value(F.col("label")) & (F.col("value") >= 0), F.lit(False))
    each = rows.groupBy(key, "layout").agg(F.count("*").alias("slices"), F.min(good).alias("_good"), F.sum("value").alias("total"))
    return each.filter(F.col("_good") & F.col("slices").between(2, MAX_LABELS) & (F.col("total") > 0)).select(key, "layout", "slices", "total")


def chart_attempts(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, chart) of every grid: what can be drawn of it, tried in the order metrics by periods, entities, pie; null where nothing."""
    cells = prepared(cells, key)
    profiles = staged(column_profiles(cells, key))
    every = profiles.select(key).distinct()
    drawn = chart_profiles(cells, key, profiles).select(key, "chart_type")
    entity = entity_grids(cells, key, profiles).select(key, F.lit("entity_grid").alias("_e")).distinct()
    pie = pies(cells, key, profiles).select(key, F.lit("pie").alias("_p"))
    return every.join(drawn, key, "left").join(entity, key, "left").join(pie, key, "left").select(key, F.coalesce("chart_type", "_e", "_p").alias("chart"))
