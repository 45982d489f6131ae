"""Hard negatives: rows of another label that score just below an anchor's positives, by exact integer inner products.

Scores come from float32 matrix products in a residue number system: the components are taken modulo a few primes, so small
that a sum of products of residues stays below 2^24 and is exact in float32; of each entry's residues, Chinese remaindering
restores the signed score. There are as many primes as the largest score needs: by Cauchy and Schwarz it is at most the
largest square of a vector.

Anchors are a stated set, taken against all rows in blocks: a block of anchors meets every group of row blocks in one
partition, the anchors first and then the row blocks one by one. No join puts them together, so nothing is broadcast whatever
Spark takes the tables' sizes for, and what a task holds follows from the sizes of blocks and tiles. Rows of a block stand by
label, so positives need the products of their own label only. A task keeps the first few of each anchor over its group,
which also say what a later row must reach; a window over the anchor selects among the groups. Positives come first; their
scores then bound the windows in which negatives are taken, in a second pass of products.

Cases: rows with a null id, label or vector, or with a component that is null or not finite, take no part; rows of one id
are one, the first by label and vector; ties in score go by the smaller id; a shorter vector is filled up with zeros; an
anchor with fewer positives or negatives has fewer rows; an anchor without positives has none; vectors whose squares reach
2^50 are refused, as their scores need more bits than a block's order has; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._storage import discard, measured, small_batches, staged, tidy

#: Rows of a block of anchors and of a block of rows, of BLOCK_BYTES at most; anchors of a tile; components of one product.
ANCHORS, ROWS, TILE, DEPTH, BLOCK_BYTES = 4096, 4096, 64, 4096, 8 << 20
#: Row blocks of a group; partitions that blocks of anchors and groups are dealt over at most.
GROUP, PARTITIONS = 8, 4096
NONE = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(table: DataFrame, scale: int = 256, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, label, x) of the rows that take part; x: floor(scale * component), of components as doubles."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.when(~bad, F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double")))).alias("x"))
    return rows.filter("id is not null and label is not null and x is not null")


def primes_for(depth: int, bound: int) -> list[int]:
    """The largest primes whose residues' products can be summed depth times in float32, as many as tell scores of up to bound in size apart."""
    top = 2 * isqrt(((1 << 24) - 1) // max(depth, 1)) + 1
    found: list[int] = []
    product = 1
    while product <= 2 * bound:
        if top < 3:
            raise ValueError("no primes left")
        if all(top % p for p in range(2, isqrt(top) + 1)):
            found.append(top)
            product *= top
        top -= 1
    return found or [3]


def _reduce(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in place, centred about zero, as far as x / p is precise."""
    q = x * x.dtype.type(1 / p)
    np.rint(q, out=q)
    q *= p
    x -= q
    return x


class Residues:
    """A matrix of integers modulo each prime, centred about zero, in float32."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = []
        for p in primes:
            r = x % p
            self.parts.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        # Two small primes are remaindered in float32: quotients stay precise enough, and scores below 2^24.
        depth = min(x.shape[1], DEPTH)
        self.kind = np.float32 if len(primes) <= 2 and max(primes) <= 2000 and depth * (max(primes) // 2) ** 2 + max(primes) < 1 << 24 else np.float64

    def products(self, others: Residues, a: int, b: int, columns: slice = slice(None)) -> np.ndarray:
        """The exact signed inner products of rows a to b with the others, as whole numbers in self.kind."""
        value, modulus = None, 1
        for p, mine, theirs in zip(self.primes, self.parts, others.parts, strict=True):
            r = None
            for k in range(0, max(mine.shape[1], 1), DEPTH):
                # Each product of at most DEPTH components is an exact integer.
                part = _reduce((mine[a:b, k : k + DEPTH] @ theirs[columns, k : k + DEPTH].T).astype(self.kind, copy=False), p)
                r = part if r is None else r + part
            if value is None:
                # Large products may be off by one p; small numbers are not.
                value = _reduce(r, p)
            else:
                r -= _reduce(value.copy(), p)
                inverse = pow(modulus, -1, p)
                r *= inverse - p if inverse > p // 2 else inverse
                _reduce(r, p)
                r *= modulus
                value += r
            modulus *= p
        return value


def _pack(rows: DataFrame, blocks: int, name: str, dims: int, kind: np.dtype) -> DataFrame:
    """Staged (name, ids, labels, x): one row a block, by label and ascending id."""
    schema = pa.schema([(name, pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("id", "ascending")]).combine_chunks()
        x = np.zeros((table.num_rows, dims), kind)
        vectors = table.column("x").combine_chunks()
        n = np.array(vectors.value_lengths())
        x[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.array(vectors.flatten())
        parts = [np.array(table.column(c)).astype("<i8").tobytes() for c in ("id", "label")]
        return pa.Table.from_pylist([{name: table.column(name)[0].as_py(), "ids": parts[0], "labels": parts[1], "x": x.tobytes()}], schema=schema)

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return staged(dealt.groupBy(name).applyInArrow(pack, f"{name} int, ids binary, labels binary, x binary"), "vectors", free=True)


class _Block:
    """Rows by label and id: their residues, and their places by id, the smallest last."""

    def __init__(self, row: dict, dims: int, kind: np.dtype, primes: list[int]):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.n = len(self.ids)
        self.by_id = np.argsort(self.ids)[::-1]
        self.behind = np.empty(self.n, np.int64)
        self.behind[self.by_id] = np.arange(self.n)
        self.residues = Residues(np.frombuffer(row["x"], kind).reshape(self.n, dims).astype(np.int64), primes)

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _firsts(scores: np.ndarray, fit: np.ndarray, k: int, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first k of each row that fit, by score and then by the larger behind."""
    many = int(behind.max(initial=0)) + 1
    n = fit.shape[1]
    # Scores are below 2^50 and blocks have 2^13 rows at most.
    keys = np.where(fit, scores.astype(np.int64) * many + behind, NONE)
    at = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), keys.shape)
    r, c = np.nonzero(np.take_along_axis(keys, at, axis=1) != NONE)
    return r, at[r, c]


class _Best:
    """The first k rows found so far of each of many groups, by score, then id."""

    def __init__(self, groups: int, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64),) * 3]
        #: What a row must reach: the score of the k-th, if there is one.
        self.least = np.full(groups, NONE)

    def add(self, group: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        self.found.append((group.astype(np.int64), score.astype(np.int64), other))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, other = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((other, -score, group))
        group, score, other = group[order], score[order], other[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        last = place == self.k - 1
        self.least[group[last]] = score[last]
        kept = place < self.k
        self.found = [(group[kept], score[kept], other[kept])]
        return self.found[0]


def _add_same(best: _Best, mine: _Block, theirs: _Block) -> None:
    """The rows of an anchor's own label."""
    for label in np.intersect1d(mine.labels, theirs.labels).tolist():
        own, rows = mine.of(label), theirs.of(label)
        others, behind = theirs.ids[rows], theirs.behind[rows]
        for at in range(own.start, own.stop, TILE):
            to = min(at + TILE, own.stop)
            scores = mine.residues.products(theirs.residues, at, to, rows)
            fit = (scores >= best.least[at:to, None]) & (mine.ids[at:to, None] != others[None, :])
            r, c = _firsts(scores, fit, best.k, behind)
            best.add(r + at, scores[r, c], others[c])
    best.settle()


def _add_below(best: _Best, mine: _Block, theirs: _Block, least: np.ndarray, most: np.ndarray) -> None:
    """The rows of other labels with scores from least to most, in a group for each anchor and column of those."""
    many = least.shape[1]
    floor = np.maximum(least, best.least.reshape(least.shape))
    for at in range(0, mine.n if many else 0, TILE):
        to = min(at + TILE, mine.n)
        scores = mine.residues.products(theirs.residues, at, to)
        # Thresholds beyond all scores are brought to where a float is exact.
        end = 1 << (23 if scores.dtype == np.float32 else 52)
        low, high = (np.clip(x[at:to], -end, end).astype(scores.dtype) for x in (floor, most))
        fit = scores >= low.min(axis=1)[:, None]
        fit &= mine.labels[at:to, None] != theirs.labels[None, :]
        if np.count_nonzero(fit) > fit.size // 8:
            for j in range(many):
                r, c = _firsts(scores, fit & (scores >= low[:, j, None]) & (scores <= high[:, j, None]), best.k, theirs.behind)
                best.add((r + at) * many + j, scores[r, c], theirs.ids[c])
            continue
        r, c = np.nonzero(fit)
        s = scores[r, c]
        order = np.lexsort((theirs.ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        for j in range(many):
            took = np.flatnonzero((s >= low[r, j]) & (s <= high[r, j]))
            took = took[np.arange(len(took)) - np.searchsorted(r[took], r[took]) < best.k]
            best.add((r[took] + at) * many + j, s[took], theirs.ids[c[took]])
    best.settle()


def _windows(ids: np.ndarray, anchors: np.ndarray, scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, least, most) of anchors by ids, a column for each of an anchor's bounds; columns that an anchor lacks are empty windows."""
    by_id = np.argsort(ids)
    order = np.lexsort((scores, anchors))
    anchors, scores = anchors[order], scores[order]
    column = np.arange(len(anchors)) - np.searchsorted(anchors, anchors)
    row = by_id[np.searchsorted(ids[by_id], anchors)]
    bounds = np.zeros((len(ids), int(column.max(initial=-1)) + 1), np.int64)
    least, most = np.ones_like(bounds), np.zeros_like(bounds)
    bounds[row, column], least[row, column], most[row, column] = scores, -(-low * scores // 100), high * scores // 100
    return bounds, least, most


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """RESULT for every anchor and each of its first positives rows of the same label: the first negatives rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score. rows: (id, label, x) of whole numbers.
    """
    spark = rows.sparkSession
    first = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    square = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    kept, seen = measured(first, "rows", anchors=F.count(F.when(anchors, 1)), dims=F.max(F.size("x")), square=F.max(square), widest=F.max(F.array_max(F.transform("x", F.abs))))
    if (seen["square"] or 0) >= 2.0**50:
        raise ValueError("scores of these vectors do not fit: scale them down")
    dims = seen["dims"] or 0
    kind = np.dtype("<i2" if (seen["widest"] or 0) < 1 << 15 else "<i8")
    primes = primes_for(min(dims, DEPTH), int((seen["square"] or 0) * 1.001) + 1)
    most_rows = max(1, BLOCK_BYTES // max(1, dims * kind.itemsize))
    n_rows, n_anchors = max(1, -(-seen["n"] // min(ROWS, most_rows))), max(1, -(-seen["anchors"] // min(ANCHORS, most_rows)))
    n_groups = -(-n_rows // GROUP)
    row_blocks = _pack(kept, n_rows, "b", dims, kind)
    anchor_blocks = _pack(kept.filter(anchors), n_anchors, "a", dims, kind)
    discard(kept)
    small_batches(spark)
    columns = ["ids", "labels", "x"]
    no_bounds = F.lit(None).cast("array<struct<anchor:bigint,score:bigint>>").alias("bounds")

    def meetings(blocks: DataFrame) -> DataFrame:
        """(pair, place, ids, labels, x, bounds): blocks of anchors (a, ids, labels, x, bounds) with each group of row blocks, the anchors in place 0."""
        pair = F.col("a") * F.lit(n_groups).cast("long") + F.col("g")
        left = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select(pair.alias("pair"), F.lit(0).alias("place"), *columns, "bounds")
        grouped = row_blocks.withColumn("g", (F.col("b") % n_groups).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
        right = grouped.select(pair.alias("pair"), F.lit(1).alias("place"), *columns, no_bounds)
        return left.unionAll(right).repartition(min(n_anchors * n_groups, PARTITIONS), "pair").sortWithinPartitions("pair", "place")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, bool, pa.ListScalar]]:
        """(pair, block, whether it is one of anchors, its bounds); a pair may lack its anchors, where none of them has a bound."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                yield batch.column("pair")[i].as_py(), _Block(row, dims, kind, primes), batch.column("place")[i].as_py() == 0, batch.column("bounds")[i]

    found_schema = pa.schema([("anchor", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = best = of = None

        def out() -> pa.RecordBatch:
            at, score, other = best.settle()
            return pa.RecordBatch.from_arrays([pa.array(mine.ids[at]), pa.array(other), pa.array(score)], schema=found_schema)

        for pair, block, is_anchors, _ in blocks_of(batches):
            if is_anchors:
                if mine is not None:
                    yield out()
                mine, of, best = block, pair, _Best(block.n, positives)
            elif pair == of:
                _add_same(best, mine, block)
        if mine is not None:
            yield out()

    def first_of(found: DataFrame, keys: list[str], many: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
        return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= many)

    near = meetings(anchor_blocks.withColumn("bounds", no_bounds)).mapInArrow(tidy(nearest), "anchor long, other long, score long")
    chosen = staged(first_of(near, ["anchor"], positives, "place"), "positives", free=True)
    # The scores that bound the windows: a few an anchor, with the anchor's block.
    bounds = chosen.select(F.pmod(F.xxhash64("anchor"), F.lit(n_anchors)).cast("int").alias("a"), "anchor", "score").distinct().groupBy("a").agg(F.collect_list(F.struct("anchor", "score")).alias("bounds"))

    window_schema = pa.schema([("anchor", pa.int64()), ("bound", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = best = of = None
        windows: tuple = ()

        def out() -> pa.RecordBatch:
            at, score, other = best.settle()
            many = windows[0].shape[1]
            return pa.RecordBatch.from_arrays([pa.array(mine.ids[at // max(many, 1)]), pa.array(windows[0].ravel()[at]), pa.array(other), pa.array(score)], schema=window_schema)

        for pair, block, is_anchors, told in blocks_of(batches):
            if is_anchors:
                if mine is not None:
                    yield out()
                anchor, score = (np.array(told.values.field(c)) for c in ("anchor", "score"))
                mine, of, windows = block, pair, _windows(block.ids, anchor, score, low, high)
                best = _Best(windows[0].size, negatives)
            elif pair == of:
                _add_below(best, mine, block, *windows[1:])
        if mine is not None:
            yield out()

    kept_below = meetings(anchor_blocks.join(bounds.hint("merge"), "a")).mapInArrow(tidy(below), "anchor long, bound long, other long, score long")
    hard = first_of(kept_below, ["anchor", "bound"], negatives, "rank")
    named = hard.select("anchor", "bound", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    picked = chosen.select("anchor", F.col("score").alias("bound"), F.col("other").alias("positive_id"))
    return picked.join(named, ["anchor", "bound"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("bound").alias("positive_score"), "negative_score")


#: The query's rows, said in SQL: all scores of the anchors, in doubles that hold whole numbers.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
