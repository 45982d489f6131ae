"""Tables that grow by batches and are merged on reading.

A batch writes its rows of each table in a folder of its own, and says which documents they replace; what earlier batches hold
of those is left out on reading. A batch counts only once it is committed, which is one small file written last: until then
readers see nothing of it, and a batch that died half-way, or runs twice, writes its own folders anew. So a change writes in
proportion to its own size. compact() writes what is live as one batch, after which the batches before it aren't read.

Cases: a batch without rows leaves an empty folder, which may still replace documents; a table that no batch has written
yet reads as None; replacing what isn't there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLACED, LEDGER = "_replaced", "_ledger"


class BatchLog:
    """The tables in a folder, by name. key: the columns that name a document."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("user_id", "doc_id")):
        self.spark, self.path, self.key = spark, path, list(key)

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stage(self, name: str, rows: DataFrame, batch: int) -> None:
        """Write a batch's rows of a table, in place of what this batch wrote before."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def replace(self, documents: DataFrame, batch: int) -> None:
        """Documents whose rows of earlier batches the batch replaces, or deletes where it has none of them."""
        self.stage(REPLACED, documents.select(*self.key).distinct(), batch)

    def commit(self, batch: int, since: int | None = None) -> None:
        """Make the batch count. since: the batches before this one count no more."""
        self.stage(LEDGER, self.spark.range(0, 1, 1, 1).select(F.lit(since).cast("long").alias("since")), batch)

    def committed(self) -> list[int]:
        """The batches that count, in their order: a row each in the ledger."""
        if not self._exists(LEDGER):
            return []
        rows = self.spark.read.parquet(f"{self.path}/{LEDGER}").select(F.col("batch").cast("long").alias("batch"), "since").collect()
        first = max((r["since"] for r in rows if r["since"] is not None), default=None)
        return sorted(r["batch"] for r in rows if first is None or r["batch"] >= first)

    def _batches(self, name: str) -> DataFrame | None:
        counted = [b for b in self.committed() if self._exists(f"{name}/batch={b}")]
        if not counted:
            return None
        # Only the folders of batches that count are read.
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in counted]).withColumn("batch", F.col("batch").cast("long"))

    def read(self, name: str, documents: DataFrame | None = None) -> DataFrame | None:
        """The live rows of a table with their batch; documents: of these alone."""
        rows = self._batches(name)
        if rows is None:
            return None
        if documents is not None:
            rows = rows.join(documents.select(*self.key).distinct(), self.key, "left_semi")
        gone = self._batches(REPLACED)
        if gone is not None:
            last = gone.groupBy(*self.key).agg(F.max("batch").alias("_until"))
            rows = rows.join(last, self.key, "left").filter("_until is null or batch >= _until").drop("_until")
        return rows

    def compact(self, names: list[str], batch: int) -> None:
        """Write the live rows of tables as one batch, in place of all before it."""
        for name in names:
            rows = self.read(name)
            if rows is not None:
                self.stage(name, rows.drop("batch"), batch)
        self.commit(batch, since=batch)
