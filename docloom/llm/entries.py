"""The registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.ngram_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents"), k=3, part=90, whole=100)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontaminate import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.line_dedup import dedup_lines

    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", F.col("n_lines_before").alias("n_lines"), F.col("n_lines_deleted").alias("n_deleted"), F.sha2("text", 256).alias("text_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.license_scan import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.chat_format import rotate_perspectives

    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.syncmer import compare_with_next

    return compare_with_next(_table(spark, sf_dir, "documents"), passages=True)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.token_store import read_token_store, write_token_store

    docs = _table(spark, sf_dir, "documents")
    return read_token_store(write_token_store(docs, _tokenizer("byte_bpe_50k.json"), end_id=2), docs)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.backoff_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.bpe_codec import digest_documents

    return digest_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.substring_dedup import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), joined=True, counts=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.hard_negatives import mine_hard_negatives, quantised

    rows = quantised(_table(spark, sf_dir, "embeddings"))
    noisy = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(noisy, F.col("id") % 50 == 0)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.token_alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from docloom.llm import backoff_lm, chat_format, hard_negatives, line_dedup

    return {"op3_line_dedup": line_dedup.SQL, "op6_chat_rotation": chat_format.SQL, "op9_backoff_lm": backoff_lm.SQL_ORDER_3, "op12_hard_negatives": hard_negatives.SQL}


def trigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.backoff_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), order=3)


def bigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.backoff_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), order=2)


def more_queries() -> dict:
    """Further queries of an operator, beside the one of its number."""
    return {"op9_backoff_lm_order3": trigram_lm, "op9_backoff_lm_order2": bigram_lm}


def more_oracle_sql() -> dict[str, str]:
    from docloom.llm import backoff_lm

    return {"op9_backoff_lm_order3": backoff_lm.SQL_ORDER_3, "op9_backoff_lm_order2": backoff_lm.SQL_ORDER_2}
