"""Cutting texts and sheets into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalize_whitespace


def word_windows(words: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of size words that share overlap words; none starts after one that reaches the end."""
    step = max(size - overlap, 1)
    n = F.size(words)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def chunk_documents(docs: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(doc_id, ord, content): a row for each window of a document's words."""
    words = F.filter(F.split(normalize_whitespace(F.col("text")), " "), lambda w: w != "")
    return docs.select("doc_id", F.posexplode(word_windows(words, size, overlap)).alias("ord", "w")).select("doc_id", "ord", F.array_join("w", " ").alias("content"))


def band_size(columns: Column) -> Column:
    """Rows of a band: 30 for narrow sheets, 15 from 6 columns, 10 from 10."""
    return F.when(columns < 6, 30).when(columns < 10, 15).otherwise(10)


def row_bands(rows: DataFrame, sheet: list[str], order: list[str], cells: list[str]) -> DataFrame:
    """Bands of a sheet's rows: (sheet.., band, first_row, last_row, content), content a line for each row, cells joined by bars."""
    size = 30 if len(cells) < 6 else 15 if len(cells) < 10 else 10
    n = F.row_number().over(Window.partitionBy(*sheet).orderBy(*order))
    line = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]), " | ")
    numbered = rows.select(*sheet, n.alias("row"), line.alias("line")).withColumn("band", F.floor((F.col("row") - 1) / size))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return numbered.groupBy(*sheet, "band").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.array_join(lines, "\n").alias("content"))
