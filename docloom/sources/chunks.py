"""The chunk table: Parquet in a bounded number of hash partitions, with idempotent writes, deletes, counts and lookups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table, whatever its number of documents; a write rewrites those of its documents.
BUCKETS = 64


def with_keys(chunks: DataFrame) -> DataFrame:
    """chunk_id from the content (a rerun gives the same id) and the attachment key of document and page."""
    ident = F.sha2(F.concat_ws("\x1f", "user_id", "doc_id", "page_number", "chunk_type", "content", "ord"), 256)
    return chunks.withColumn("chunk_id", ident).withColumn("attachment_key", F.concat_ws(":", "doc_id", "page_number"))


def bucket_of(user_id, doc_id):
    return F.pmod(F.xxhash64(user_id, doc_id), F.lit(BUCKETS)).cast("int")


def replace_documents(rows: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """Write rows (user_id, doc_id, ...) in place of what the table holds of their documents, and of those of gone.

    Only the folders of these documents are rewritten, in one write that replaces each whole; one left without rows goes.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", bucket_of("user_id", "doc_id"))
    keys = (rows if gone is None else gone).select("user_id", "doc_id").distinct().withColumn("bucket", bucket_of("user_id", "doc_id"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = None
    emptied: set[int] = set()
    if old is not None:
        touched = {r["bucket"] for r in keys.select("bucket").distinct().collect()}  # BUCKETS at most
        kept = old.filter(F.col("bucket").isin(sorted(touched))).join(keys, ["user_id", "doc_id", "bucket"], "left_anti")
        new = new.unionByName(kept.select(*new.columns))
        emptied = touched - {r["bucket"] for r in new.select("bucket").distinct().collect()}
    # The folders that are read stay until the new ones are written whole.
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in emptied:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def index_chunks(chunks: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """Replace the chunks of the documents in chunks, and of those of gone, which may have none now."""
    replace_documents(with_keys(chunks), path, gone)


def read_chunks(spark: SparkSession, path: str, user_id: str | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """Chunks of a user and some documents; with both given only their folders are read."""
    chunks = spark.read.parquet(path)
    if user_id is not None and doc_ids is not None:
        wanted = spark.createDataFrame([(user_id, d) for d in doc_ids], "u string, d string").select(bucket_of("u", "d").alias("b")).distinct()
        chunks = chunks.filter(F.col("bucket").isin([r["b"] for r in wanted.collect()]))
    if user_id is not None:
        chunks = chunks.filter(F.col("user_id") == user_id)
    return chunks if doc_ids is None else chunks.filter(F.col("doc_id").isin(doc_ids))


def count_chunks(spark: SparkSession, path: str, user_id: str, doc_id: str) -> int:
    try:
        return read_chunks(spark, path, user_id, [doc_id]).count()
    except AnalysisException:
        return 0  # no table, or one without rows


def schema_digest(tables: dict[str, DataFrame], most_tables: int = 40, most_chars: int = 12_000) -> str:
    """'name(col:type, …)' for each table, cut at the caps."""
    lines = [f"{name}({', '.join(f'{c}:{t}' for c, t in df.dtypes)})" for name, df in sorted(tables.items())[:most_tables]]
    return "\n".join(lines)[:most_chars]


def jdbc_table(spark: SparkSession, url: str, table: str, timeout: int = 30, **options: str) -> DataFrame:
    """A table of a PostgreSQL database; other schemes are refused."""
    if not url.startswith("jdbc:postgresql://"):
        raise ValueError("only PostgreSQL connections are supported")
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).option("queryTimeout", str(timeout)).options(**options).load()
