"""Stupid-backoff language-model scores, relationally: count tables partitioned by hash, joined to the n-grams of the documents.

count_join deals documents into blocks, which explode their texts into n-grams and sum them; hash partitions add the blocks'
counts up to the count tables and join the totals back; the block then sums the scores of its documents' words.

Score of a word: with the longest context that its document gives it (order - 1 words at most), c(context word) /
c(context) if the n-gram occurs min_count times, else alpha times the score with a context shorter by one word; a single
word has c(word) / N. N: all words of all documents. Logarithms are rounded to millionths one by one and summed as
integers, so a sum depends on no order.

Words: A-Z lower-cased, then runs of digits, letters and code points from U+0080.

All n-grams of all documents are counted, whatever their counts.

Cases: a very long text is one of its block's texts, whole; null or empty text, or one without words, has no words, score 0 and a null mean; rows that repeat an id or a text
all count and are scored each; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._storage import small_batches, staged
from docloom.llm._text import _ODD, ALNUM, U64, blocks, mix, word_hashes
from docloom.llm.count_join import deal, with_counts

#: A count of one says that an n-gram stands nowhere but in the document that is scored: it counts as unseen there.
ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bits of a hash that tell n-grams apart: of ten thousand million n-grams one in seven million shares its count with another.
COUNT_BITS = 56


def _ngrams(column, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(row of each word, for each n the hashes of n-grams, and the place of each one's first word)."""
    words, rows = [], []
    for lo, _, data, offsets in blocks(column):
        h, row = word_hashes(data, offsets, ALNUM)
        words.append(h)
        rows.append(row + lo)
    h = np.concatenate([*words, np.zeros(0, U64)])
    row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    grams, places = [], []
    for n in range(1, order + 1):
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        g = np.full(len(at), n, U64)
        for j in range(n):
            g += h[at + j] * _ODD[j]
        grams.append(mix(g))
        places.append(at)
    return row, grams, places


def count_and_score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_unigram, log_micro): log_micro lacks the -log N of each of the n_unigram words scored alone."""
    def explode(table: pa.Table) -> list[np.ndarray]:
        return _ngrams(table.column("text"), order)[1]

    scored = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_unigram", pa.int64()), ("log_micro", pa.int64())])

    def score(texts: pa.Table, counts: list[np.ndarray]) -> pa.Table:
        rows = texts.num_rows
        row, grams, places = _ngrams(texts.column("text"), order)
        first = np.searchsorted(row, np.arange(rows + 1))
        deep = np.arange(len(row)) - first[row]
        totals = []
        for n, (g, at) in enumerate(zip(grams, places, strict=True)):
            # The count of the n-gram that begins at each word.
            by_word = np.zeros(len(row), np.int64)
            if len(at):
                by_word[at] = counts[n][np.unique(g >> U64(64 - COUNT_BITS), return_inverse=True)[1]]
            totals.append(by_word)
        value = np.zeros(len(row), np.int64)
        todo = np.ones(len(row), bool)
        for n in range(order, 1, -1):
            at = np.flatnonzero(todo & (deep >= n - 1))
            at = at[totals[n - 1][at - n + 1] >= min_count]
            ratio = totals[n - 1][at - n + 1] / totals[n - 2][at - n + 1]
            steps = np.minimum(order, deep[at] + 1) - n
            value[at] = np.rint(1e6 * np.log(alpha**steps * ratio)).astype(np.int64)
            todo[at] = False
        at = np.flatnonzero(todo)
        value[at] = np.rint(1e6 * np.log(alpha ** (np.minimum(order, deep[at] + 1) - 1.0) * totals[0][at])).astype(np.int64)
        sums = np.add.reduceat(np.append(value, 0), first[:-1]) if rows else value
        sums = np.where(np.diff(first) > 0, sums, 0)
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), pa.array(np.diff(first)), pa.array(np.bincount(row[at], minlength=rows)), pa.array(sums)], schema=scored)

    small_batches(docs.sparkSession)
    dealt, size = deal(docs, text_col, id_col)
    return with_counts(dealt, size, explode, score, "doc_id long, n_words long, n_unigram long, log_micro long", COUNT_BITS)


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_unigram, log_score_micro, mean_log_score) of every row, scored by the counts of all rows."""
    found = staged(count_and_score(docs, order, alpha, min_count, text_col, id_col), "scores")
    total = found.agg(F.sum("n_words")).first()[0] or 1
    log = F.col("log_micro") - F.col("n_unigram") * F.lit(round(1e6 * math.log(total)))
    out = found.select("doc_id", "n_words", "n_unigram", log.cast("long").alias("log_score_micro"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score_micro") / 1e6 / F.col("n_words")))


#: The query's result for order 2, in SQL.
SQL_ORDER_2 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), p AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {MIN_COUNT}),
total AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT p.doc_id, CASE WHEN c2.n IS NOT NULL THEN CAST(round_even(1e6 * ln(c2.n / cv.n), 0) AS BIGINT)
    ELSE CAST(round_even(1e6 * ln((CASE WHEN p.v IS NULL THEN 1.0::DOUBLE ELSE {ALPHA}::DOUBLE END) * cw.n), 0) AS BIGINT) - CAST(round_even(1e6 * ln((SELECT n FROM total)), 0) AS BIGINT) END AS x,
    CASE WHEN c2.n IS NULL THEN 1 ELSE 0 END AS u
  FROM p JOIN c1 cw ON cw.w = p.w LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w
), g AS (SELECT doc_id, count(*) AS n_words, sum(u) AS n_unigram, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_words, 0) AS n_words, CAST(coalesce(g.n_unigram, 0) AS BIGINT) AS n_unigram, CAST(coalesce(g.x, 0) AS BIGINT) AS log_score_micro,
  CASE WHEN g.n_words > 0 THEN CAST(g.x AS DOUBLE) / 1e6 / g.n_words END AS mean_log_score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

#: The same for order 3, the production order.
SQL_ORDER_3 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), p AS (
  SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM w
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
total AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT p.doc_id, CASE WHEN c3.n >= {MIN_COUNT} THEN CAST(round_even(1e6 * ln(c3.n / cuv.n), 0) AS BIGINT)
    WHEN c2.n >= {MIN_COUNT} THEN CAST(round_even(1e6 * ln((CASE WHEN p.u IS NULL THEN 1.0::DOUBLE ELSE {ALPHA}::DOUBLE END) * (c2.n / cv.n)), 0) AS BIGINT)
    ELSE CAST(round_even(1e6 * ln(pow({ALPHA}::DOUBLE, CASE WHEN p.v IS NULL THEN 0 WHEN p.u IS NULL THEN 1 ELSE 2 END) * cw.n), 0) AS BIGINT) - CAST(round_even(1e6 * ln((SELECT n FROM total)), 0) AS BIGINT) END AS x,
    CASE WHEN coalesce(c3.n, 0) < {MIN_COUNT} AND coalesce(c2.n, 0) < {MIN_COUNT} THEN 1 ELSE 0 END AS alone
  FROM p JOIN c1 cw ON cw.w = p.w LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w
    LEFT JOIN c2 cuv ON cuv.v = p.u AND cuv.w = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
), g AS (SELECT doc_id, count(*) AS n_words, sum(alone) AS n_unigram, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_words, 0) AS n_words, CAST(coalesce(g.n_unigram, 0) AS BIGINT) AS n_unigram, CAST(coalesce(g.x, 0) AS BIGINT) AS log_score_micro,
  CASE WHEN g.n_words > 0 THEN CAST(g.x AS DOUBLE) / 1e6 / g.n_words END AS mean_log_score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
