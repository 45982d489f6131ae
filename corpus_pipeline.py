"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and all but the last return the columns of documents.

Between stages documents are written as Parquet and read again, so each stage starts from a table, whatever executors are
lost before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm._storage import staged
from docloom.llm.bpe_codec import digest_documents
from docloom.llm.decontaminate import clean_documents
from docloom.llm.line_dedup import drop_copies
from docloom.llm.ngram_join import keep_one_of_each
from docloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 20 words or more go from the texts, and documents left without a word."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one of the smallest id stays."""
    return keep_one_of_each(docs, k=5, part=80, whole=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    import public_tokenizers

    return digest_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_codec", bpe_codec),
]

#: A trained classifier and a tokenizer are beyond SQL: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
