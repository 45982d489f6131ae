"""Files that arrive in a folder become chunks, and their documents' states a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import library, service
from docloom.operators.chunking import chunk_documents
from docloom.sources.batch_log import BatchLog
from docloom.sources.chunks import index_chunks, replace_documents, with_keys
from docloom.streaming.states import STEPS


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files of a folder, as they come."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def ingest(batch: DataFrame, chunk_path: str, status_path: str) -> None:
    """Chunk a batch of text files and record each document's state. Running a batch again replaces what it wrote.

    A document is a user's file (its folder's and its own name): users who name files alike share nothing.
    """
    docs = batch.select(F.element_at(F.split("path", "/"), -2).alias("user_id"), F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.decode("content", "utf-8").alias("text"))
    chunks = chunk_documents(docs.select(F.struct("user_id", "doc_id").alias("doc_id"), "text")).select("doc_id.user_id", "doc_id.doc_id", "ord", "content", F.lit(1).alias("page_number"), F.lit("text").alias("chunk_type"))
    index_chunks(chunks, chunk_path, docs)
    counts = chunks.groupBy("user_id", "doc_id").agg(F.count("*").alias("n"))
    status = docs.join(counts, ["user_id", "doc_id"], "left").select("user_id", "doc_id", F.when(F.col("n") > 0, "indexed").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("chunk_count"))
    replace_documents(status, status_path)


def start_ingestion(spark: SparkSession, folder: str, chunk_path: str, status_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    stream = landed(spark, folder).writeStream.foreachBatch(lambda batch, _: ingest(batch, chunk_path, status_path)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


#: Kinds of files that are read as text, and what a document says that could not be ingested.
SUFFIXES = ("txt", "md")
NO_TEXT, UNSUPPORTED = "No text or table content extracted from document", "Unsupported document format: "


def ingest_batch(batch: DataFrame, log: BatchLog, batch_id: int) -> None:
    """Chunks with vectors, digests and states of a batch of files, in place of what earlier batches hold of their documents.

    All of it counts at once, when the batch is committed at the end: one that dies before leaves the tables as they were,
    and one that runs again writes the same. A file that gives no chunk replaces its document by none, and its state says why.
    """
    name = F.element_at(F.split("path", "/"), -1)
    docs = batch.select(F.element_at(F.split("path", "/"), -2).alias("user_id"), name.alias("doc_id"), F.lower(F.element_at(F.split(name, "\\."), -1)).alias("suffix"), F.decode("content", "utf-8").alias("text"))
    known = F.col("suffix").isin(*SUFFIXES)
    key = F.struct("user_id", "doc_id")
    cut = chunk_documents(docs.filter(known).select(key.alias("doc_id"), "text")).select("doc_id.user_id", "doc_id.doc_id", "ord", "content", F.lit(1).alias("page_number"), F.lit("text").alias("chunk_type"))
    chunks = with_keys(cut)
    vectors = service.hash_embed(chunks.select("chunk_id", "content").distinct(), "chunk_id", "content")
    log.replace(docs, batch_id)
    log.stage("chunks", chunks.join(vectors, "chunk_id"), batch_id)
    written = log.spark.read.parquet(f"{log.path}/chunks/batch={batch_id}")
    told = written.select(key.alias("doc_id"), F.col("doc_id").alias("filename"), F.lit("txt").alias("source_format"), "page_number", F.col("ord").alias("block_index"), "chunk_type", *[F.lit(None).cast("string").alias(c) for c in ("section", "subsection", "sheet_name")])
    digests = library.digests(told).select("doc_id.user_id", "doc_id.doc_id", "digest")
    log.stage("digests", digests, batch_id)
    counts = written.groupBy("user_id", "doc_id").agg(F.count("*").alias("n"))
    why = F.when(~known, F.concat(F.lit(UNSUPPORTED), F.lit("."), F.col("suffix"))).when(F.col("n").isNull(), NO_TEXT)
    states = docs.join(counts, ["user_id", "doc_id"], "left").select("user_id", "doc_id", F.when(why.isNull(), "indexed").otherwise("failed").alias("status"), F.lit(100).alias("progress"), F.when(why.isNull(), STEPS["indexed"][1]).otherwise(STEPS["failed"][1]).alias("message"), F.coalesce("n", F.lit(0)).alias("chunk_count"), why.alias("error"))
    log.stage("states", states, batch_id)
    log.commit(batch_id)


def start_batches(spark: SparkSession, folder: str, tables: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Ingest the files that arrive in a folder into the batch log at tables; its batches are those of the stream."""
    log = BatchLog(spark, tables)
    stream = landed(spark, folder).writeStream.foreachBatch(lambda batch, n: ingest_batch(batch, log, n)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
