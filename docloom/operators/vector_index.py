"""Approximate nearest neighbours: an inverted file of vector cells.

Cells are the clusters of a bounded sample; every row of the table lies in the cell of its nearest centre. A question looks
into the few cells whose centres are nearest. Cells are put together to slots of about SLOT_ROWS rows, and a block of questions
meets each slot in one partition: there every question is compared with the rows of its cells by products of matrices, and
its first k of a block are shuffled, not every pair. A cell of many rows (copies of one vector) is dealt over parts, each a
slot of its own, so no task gets a whole large cell. With all cells probed the result is exact; retrieval.nearest is the
exact way without an index.

Cases: rows without a vector, with a component that is null or not finite, or of another length than the centres, are in no
cell and found by no question, and such questions find nothing; ties go by the smaller key; repeated rows are found as
often as they stand there; where the probed cells hold fewer than k rows, fewer come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators import best
from docloom.operators.retrieval import nearest

#: Rows that the centres are fitted on at most, those of the smallest hashes; cells at most; rows of a part of a cell.
SAMPLE_ROWS, MAX_CELLS, PART_ROWS = 20_000, 4096, 50_000
#: Rows of a slot, about; questions of a block, rows of a block; distances held at once; partitions that slots meet questions in at most.
SLOT_ROWS, QUESTIONS, ROWS, PAIRS, PARTITIONS = 32_768, 4096, 4096, 1 << 18, 4096
#: Rows, those of the smallest hashes, whose exact neighbours say how many cells a question has to look into, the neighbours
#: of each, and the share of them to be found: on vectors without clusters that takes most cells, on clustered ones a few.
MEASURED_ROWS, MEASURED_NEIGHBOURS, LEAST_RECALL = 200, 10, 0.95


def sound(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    return (F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


@dataclass(frozen=True)
class VectorIndex:
    """centres: (cell, centre, parts, probes, size), at most MAX_CELLS rows; rows: (cell, part, key, vector) of the whole table."""

    centres: DataFrame
    rows: DataFrame
    key: str
    vector: str

    def save(self, path: str) -> None:
        """Write the index: rows in a folder for each cell, of which a search reads those of its cells."""
        self.centres.write.parquet(f"{path}/centres")
        self.rows.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")


def load_index(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/rows"), key, vector)


def fit_centres(vectors: DataFrame, cells: int, key: str, vector: str, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Centres of clusters of the sample_rows rows with the smallest hashes of their key: the same whatever the partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = vectors.filter(sound(F.col(vector))).select(F.xxhash64(key).alias("h"), key, F.transform(vector, lambda c: c.cast("double")).alias("v"))
    sample = known.orderBy("h", key, "v").limit(sample_rows)
    usual = sample.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return np.zeros((0, 0))
    fitted = sample.filter(F.size("v") == usual["n"]).select(array_to_vector("v").alias("features")).persist()
    try:
        model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(fitted)
    finally:
        fitted.unpersist()
    return np.array(model.clusterCenters())


def _nearest_cells(rows: DataFrame, centres: np.ndarray, key: str, vector: str, many: int) -> DataFrame:
    """rows (key, vector) with cell and place: a row for each of the many nearest centres, the nearest in place 1."""
    kinds = dict(rows.dtypes)
    half = (centres**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = np.array(part.column(1).flatten(), float).reshape(part.num_rows, -1)
                far = half[None, :] - x @ centres.T
                cells = np.argmin(far, axis=1)[:, None] if many == 1 and len(centres) else np.argsort(far, axis=1, kind="stable")[:, :many]
                of = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(cells.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, cells.shape[1] + 1, dtype=np.int32), part.num_rows))], names=[key, vector, "cell", "place"])

    known = rows.select(key, vector).filter(sound(F.col(vector)) & (F.size(vector) == (centres.shape[1] if centres.size else -1)))
    return known.mapInArrow(run, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, cell int, place int")


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, least_recall: float = LEAST_RECALL) -> VectorIndex:
    """The index of all rows of vectors. cells: about the root of the number of rows unless given.

    The exact neighbours of MEASURED_ROWS rows are compared with what their nearest cells hold, and questions look into as
    many cells as gives least_recall there.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    centres = fit_centres(vectors, max(2, min(MAX_CELLS, cells or isqrt(n))), key, vector, sample_rows)
    placed = _nearest_cells(vectors, centres, key, vector, 1)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-sizes.get(i, 0) // part_rows)) for i in range(len(centres))]
    of_cell = F.get(F.array(*[F.lit(p) for p in parts]), "cell") if any(p > 1 for p in parts) else F.lit(1)
    rows = placed.withColumn("part", F.pmod(F.xxhash64(key), of_cell).cast("int")).select("cell", "part", key, vector)

    def index(probes: int) -> VectorIndex:
        return VectorIndex(spark.createDataFrame([(i, c.tolist(), parts[i], probes, sizes.get(i, 0)) for i, c in enumerate(centres)], "cell int, centre array<double>, parts int, probes int, size long"), rows, key, vector)

    if not len(centres):
        return index(0)
    known = vectors.filter(sound(F.col(vector)) & (F.size(vector) == centres.shape[1]))
    asked = known.orderBy(F.xxhash64(key), key).limit(MEASURED_ROWS).select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    return index(probes_for(index(0), asked, nearest(known, asked, MEASURED_NEIGHBOURS, key, vector), least_recall))


def _centres(index: VectorIndex) -> tuple[list, np.ndarray]:
    found = sorted((r["cell"], r["centre"], r["parts"], r["probes"], r["size"]) for r in index.centres.collect())
    return found, np.array([c[1] for c in found]) if found else np.zeros((0, 0))


def probes_for(index: VectorIndex, questions: DataFrame, exact: DataFrame, least: float = 0.9) -> int:
    """The smallest number of probed cells with which the questions' exact neighbours (query_id, key) are found to at least this share."""
    _, table = _centres(index)
    places = _nearest_cells(questions, table, "query_id", "query", len(table)).select("query_id", "cell", "place")
    met = exact.select("query_id", index.key).join(index.rows.select(index.key, "cell"), index.key).join(places, ["query_id", "cell"])
    counts = met.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    wanted, seen = least * sum(r["n"] for r in counts), 0
    for r in counts:
        seen += r["n"]
        if seen >= wanted:
            return r["place"]
    return len(table)


def _sound_questions(questions: DataFrame, dims: int) -> DataFrame:
    return questions.select("query_id", F.transform("query", lambda c: c.cast("double")).alias("query")).filter(sound(F.col("query")) & (F.size("query") == dims))


def _probes(x: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    """For each row of x, which cells are among the many nearest."""
    out = np.zeros((len(x), len(centres)), bool)
    half = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), 2048):
        cells = np.argsort(half[None, :] - x[lo : lo + 2048] @ centres.T, axis=1, kind="stable")[:, :many]
        np.put_along_axis(out[lo : lo + 2048], cells, True, axis=1)
    return out


def _slots(centres: list) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, slot of its part 0, parts) of each cell and the number of slots: cells of one part share slots of about SLOT_ROWS rows."""
    out, n, rows, shared = [], 0, 0, None
    for cell, _, parts, _, size in centres:
        if parts > 1:
            out.append((cell, n, parts))
            n += parts
            continue
        if shared is None or rows + size > SLOT_ROWS:
            shared, rows, n = n, 0, n + 1
        rows += size
        out.append((cell, shared, 1))
    return out, max(n, 1)


class _Asked:
    """A block of questions: their vectors, the cells each looks into, and how near its k-th row so far is."""

    def __init__(self, ids: pa.Array, data: bytes, cells: bytes, dims: int, many_cells: int, k: int):
        self.ids, self.k = ids, k
        self.y = np.frombuffer(data).reshape(len(ids), dims)
        self.y2 = (self.y * self.y).sum(1)
        self.cells = np.unpackbits(np.frombuffer(cells, np.uint8).reshape(len(ids), -1), axis=1, count=many_cells).astype(bool)
        self.top = np.full((len(ids), k), np.inf)

    def near(self, keys: pa.Array, cells: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, row, distance): of rows x, which stand by cell, the first k of each question that can be among its k nearest."""
        x2, tie = (x * x).sum(1), best.ranks(keys)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        kth = self.top.max(axis=1)
        begins = np.flatnonzero(np.diff(cells, prepend=-1))
        for begin, end in zip(begins, np.append(begins[1:], len(x)), strict=True):
            asking = np.flatnonzero(self.cells[:, cells[begin]])
            step = max(1, PAIRS // (end - begin))
            for q in (asking[at : at + step] for at in range(0, len(asking), step)):
                with np.errstate(invalid="ignore", over="ignore"):
                    square = x2[None, begin:end] + self.y2[q, None] - 2 * (self.y[q] @ x[begin:end].T)
                    # What the product may be off.
                    off = 1e-9 * (x2[begin:end].max() + self.y2[q]) + 1e-30
                    reach = kth[q] ** 2 + off
                    near = ~(square > reach[:, None])
                    if np.count_nonzero(near) > 4 * self.k * len(q) and end - begin > self.k:
                        square = np.where(np.isnan(square), np.inf, np.maximum(square, 0))
                        low = np.partition(square, self.k - 1, axis=1)[:, self.k - 1]
                        near &= ~(square > ((np.sqrt(low + off)) ** 2 + off)[:, None])
                i, r = np.nonzero(near)
                r += begin
                # Distances are summed place by place, as functions.vectors.l2_distance does.
                for at in range(0, len(i), PAIRS):
                    to = slice(at, at + PAIRS)
                    found.append((q[i[to]], r[to], best.distances(x[r[to]], self.y[q[i[to]]])))
        q, r, d = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = best.first_places(q, d, tie[r], self.k)
        q, r, d = q[kept], r[kept], d[kept]
        # Those kept stand by question, the nearest first.
        new = np.full_like(self.top, np.inf)
        new[q, np.arange(len(q)) - np.searchsorted(q, q)] = d
        self.top = np.partition(np.concatenate([self.top, new], axis=1), self.k - 1, axis=1)[:, : self.k]
        return q, r, d


def search_index(index: VectorIndex, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of each question's probed cells, as many as the index says unless given. questions: query_id, query, a stated set."""
    spark = questions.sparkSession
    centres, table = _centres(index)
    dims = table.shape[1] if len(centres) else -1
    many = min(len(centres), probes or max((c[3] for c in centres), default=0))
    slots, n_slots = _slots(centres)
    key, vector = index.key, index.vector
    key_type, query_type = index.rows.schema[key].dataType, questions.schema["query_id"].dataType
    keys_of, ids_of = f"array<{key_type.simpleString()}>", f"array<{query_type.simpleString()}>"
    single = index.rows.schema[vector].dataType.elementType.simpleString() == "float"
    kind = np.dtype("<f4" if single else "<f8")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(_probes(x, table, many).any(axis=0)).astype(np.int32))], names=["cell"])

    # The cells that any question looks into, at most MAX_CELLS, with their slots: no other cell's rows are read.
    asked = _sound_questions(questions, dims)
    wanted = asked.select("query").mapInArrow(probed, "cell int").distinct()
    of_cell = spark.createDataFrame(slots, "cell int, slot int, parts int").join(wanted, "cell", "left_semi")
    slot = (F.col("slot") + F.when(F.col("parts") > 1, F.col("part")).otherwise(0)).alias("slot")
    rows = index.rows.join(F.broadcast(of_cell), "cell").select(slot, "cell", key, vector if single else F.transform(vector, lambda c: c.cast("double")).alias(vector))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(slot)) + 1, len(slot))
            for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                for lo in range(begin, end, ROWS):
                    part = batch.slice(lo, min(ROWS, end - lo))
                    data = np.array(part.column(3).flatten()).astype(kind).tobytes()
                    keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(2))
                    yield pa.RecordBatch.from_arrays([pa.array([slot[lo]], pa.int32()), pa.array([part.column(1).to_numpy().astype("<i4").tobytes()], pa.binary()), keys, pa.array([data], pa.binary())], names=["slot", "cells", "keys", "data"])

    row_blocks = rows.repartition(n_slots, "slot").sortWithinPartitions("slot", "cell").mapInArrow(pack_rows, f"slot int, cells binary, keys {keys_of}, data binary")

    n_blocks = max(1, -(-questions.count() // QUESTIONS))
    ids_type = to_arrow_type(query_type)

    def pack_questions(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = np.array(group.column("query").combine_chunks().flatten(), float).reshape(group.num_rows, -1)
        ids = pa.array([group.column("query_id").to_pylist()], pa.list_(ids_type))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "cells": pa.array([np.packbits(_probes(x, table, many), axis=1).tobytes()], pa.binary()), "ids": ids, "data": pa.array([x.tobytes()], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    asked_blocks = dealt.groupBy("block").applyInArrow(pack_questions, f"block int, cells binary, ids {ids_of}, data binary")

    # Every block of questions meets every slot in one partition, the questions first.
    pair = (F.col("block").cast("long") * n_slots + F.col("slot")).alias("pair")
    left = asked_blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1)))).select(pair, F.lit(0).alias("place"), "cells", "ids", F.lit(None).cast(keys_of).alias("keys"), "data")
    right = row_blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(pair, F.lit(1).alias("place"), "cells", F.lit(None).cast(ids_of).alias("ids"), "keys", "data")
    meetings = left.unionAll(right).repartition(min(n_blocks * n_slots, PARTITIONS), "pair").sortWithinPartitions("pair", "place")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = of = None
        for batch in batches:
            for i in range(batch.num_rows):
                pair, place, cells, data = (batch.column(c)[i].as_py() for c in ("pair", "place", "cells", "data"))
                if place == 0:
                    asking, of = _Asked(batch.column("ids")[i].values, data, cells, dims, len(centres), k), pair
                elif pair == of:
                    keys = batch.column("keys")[i].values
                    x = np.frombuffer(data, kind).reshape(len(keys), dims).astype(float)
                    q, r, d = asking.near(keys, np.frombuffer(cells, "<i4"), x)
                    yield pa.RecordBatch.from_arrays([asking.ids.take(pa.array(q)), keys.take(pa.array(r)), pa.array(d)], names=["query_id", key, "distance"])

    near = meetings.mapInArrow(find, f"query_id {query_type.simpleString()}, `{key}` {key_type.simpleString()}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
