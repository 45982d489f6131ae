"""Numbers, periods and units in table cells, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = "^\\s*\\(?[\\$€£¥]?\\s*([\\d,]+(?:\\.\\d+)?)\\s*%?\\)?\\s*$"


def parse_number(cell: Column) -> Column:
    """Currency, thousands commas, per cent; parentheses are a minus sign, a leading minus is none."""
    digits = F.translate(F.regexp_extract(cell, _NUMBER, 1), ",", "").try_cast("double")
    negative = F.trim(cell).startswith("(") & F.trim(cell).endswith(")")
    return F.when(negative, -digits).otherwise(digits)


def is_numeric_like(cell: Column) -> Column:
    return cell.rlike("^[\\s\\-$€£¥%(),.\\d]+$") & cell.rlike("\\d")


def is_year_like(cell: Column) -> Column:
    return F.trim(cell).rlike("^\\d{4}$")


def is_financial_value(cell: Column) -> Column:
    return is_numeric_like(cell) & ~is_year_like(cell)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is found once."""
    return F.transform(F.array(value), body)[0]


def period_key(label: Column) -> Column:
    """The period that a header names: a year, quarter, half, index, compact token, or the one year inside a longer header; else null."""

    def key(text: Column, upper: Column) -> Column:
        year = F.regexp_extract(upper, "^(?:FY|CY)?\\s*(\\d{4})$", 1)
        digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
        letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
        money = F.regexp_replace(text, "[,%]", "").try_cast("double").isNotNull()
        inner = F.regexp_extract_all(text, F.lit("(?<!\\d)(19\\d{2}|20\\d{2})(?!\\d)"), F.lit(1))
        other = (
            F.when(upper.rlike("^[QH][1-4](\\s*(FY|CY)?\\s*\\d{2,4})?$") & ~upper.rlike("^H[34]"), F.replace(upper, F.lit(" "), F.lit("")))
            .when(upper.rlike("^[PT]\\d{1,2}$"), upper)
            .when((F.length(text) <= 6) & ~money & (digits >= 2) & (letters <= 4), upper)
            .otherwise(once(inner, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))))
        )
        named = once(year, lambda y: F.when(y != "", F.when(y.cast("int").between(1900, 2099), y)).otherwise(other))
        return F.when((text == "") | (F.length(text) > 48), F.lit(None).cast("string")).otherwise(named)

    return once(F.trim(F.regexp_replace(label, "\\s+", " ")), lambda text: once(F.upper(text), lambda upper: key(text, upper)))


def is_unit_token(token: Column) -> Column:
    text = F.trim(F.regexp_replace(token, "\\s+", " "))
    return (text != "") & (F.length(text) <= 48) & (text.rlike("(?i)%|percent") | text.rlike("^[A-Z]{3}$") | text.rlike("(?i)\\b(million|billion|thousand|trillion|percent)\\b"))


def unit_tokens(cell: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(cell, F.lit("\\(([^)]+)\\)"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), is_unit_token)


def split_embedded_value(cell: Column) -> Column:
    """'Automotive 45,018' as struct(label, value); null for other cells."""
    value = F.regexp_extract(F.trim(cell), "^(.*[A-Za-z].*)\\s+([\\$€£¥(]?[\\d,]+(?:\\.\\d+)?[%)]?)$", 2)
    label = F.regexp_extract(F.trim(cell), "^(.*[A-Za-z].*)\\s+([\\$€£¥(]?[\\d,]+(?:\\.\\d+)?[%)]?)$", 1)
    return F.when(value != "", F.struct(F.trim(label).alias("label"), value.alias("value")))


def is_composition(values: Column) -> Column:
    """Three values or more, each from 0 to 100, that sum to 90 to 110."""
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return (F.size(values) >= 3) & F.forall(values, lambda v: v.between(0, 100)) & total.between(90, 110)


def upload_progress(seconds: Column) -> Column:
    return F.least(F.lit(95.0), 20 + 2.3 * seconds)
