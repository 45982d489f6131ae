import random
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import hard_negatives
from docloom.llm.hard_negatives import Residues, mine_hard_negatives, primes_for, quantised


def plain(rows, is_anchor, positives, negatives, low, high):
    out = []
    for i, label, x in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, other) for j, other, y in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("dims,size", [(1, 3), (64, 300), (200, 20_000), (5000, 90), (3, 10**6)])
def test_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-size, size + 1, (37, dims)), rng.integers(-size, size + 1, (51, dims))
    a[0], b[0] = size, -size
    bound = int(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max()))
    primes = primes_for(min(dims, hard_negatives.DEPTH), bound)
    assert min(dims, hard_negatives.DEPTH) * (max(primes) // 2) ** 2 < 1 << 24
    assert (Residues(a, primes).products(Residues(b, primes), 0, len(a)) == a @ b.T).all()


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS", 23)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    rng = random.Random(seed)
    spread = [1, 3, 300, 40_000][seed]
    same = [rng.randint(-spread, spread) for _ in range(6)]
    rows = [(i, rng.randrange(4), same if rng.random() < 0.3 else [rng.randint(-spread, spread) for _ in range(6)]) for i in rng.sample(range(-100, 400), 150)]
    rows.append((1000, 99, [1] * 6))
    frame = spark.createDataFrame(rows, "id long, label long, x array<long>").repartition(3)
    got = mine_hard_negatives(frame, F.col("id") % 5 == 0, 5, 3, 50, 95)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    want = plain(rows, lambda i: i % 5 == 0, 5, 3, 50, 95)
    assert sorted(map(tuple, got.collect())) == want and want


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.5, -0.001], 3), (2, None, 3), (3, [0.5, None], 3), (4, [nan, 0.0], 3), (5, [inf, 0.0], 3), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (7, [], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, quantised(frame).collect())) == [(1, 3, [128, -1]), (7, 2, [])]


def test_repeated_rows_short_vectors_and_empty_tables(spark):
    rows = [(0, 1, [10, 0]), (0, 1, [10, 0]), (0, 2, [99, 99]), (1, 1, [10]), (2, 2, [8, 1]), (2, 2, [8, 1]), (3, 2, [9, 5])]
    frame = spark.createDataFrame(rows, "id long, label long, x array<long>")
    got = mine_hard_negatives(frame, F.col("id") == 0).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1, 3, 100, 90), (0, 1, 2, 2, 100, 80)]
    assert mine_hard_negatives(frame.limit(0), F.col("id") == 0).count() == 0
    assert mine_hard_negatives(frame, F.col("id") == 77).count() == 0
    with pytest.raises(ValueError):
        mine_hard_negatives(spark.createDataFrame([(1, 1, [1 << 40])], "id long, label long, x array<long>"), F.col("id") == 1)


@pytest.mark.parametrize("shift", [0, 500])
def test_groups_of_blocks(spark, monkeypatch, shift):
    """Several groups, and windows that hold a few rows of a block or nearly all of them."""
    for name, value in (("ANCHORS", 9), ("ROWS", 40), ("GROUP", 2), ("TILE", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(shift)
    rows = [(i, rng.randrange(3), [rng.randint(-99, 99) + shift for _ in range(8)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, label long, x array<long>").repartition(3)
    want = plain(rows, lambda i: i % 10 == 0, 5, 3, 50, 95)
    assert sorted(map(tuple, mine_hard_negatives(frame, F.col("id") % 10 == 0).collect())) == want and want


def test_blocks_of_anchors_without_positives(spark, monkeypatch):
    """Their pairs have no anchors in the second pass, and must not meet those of the pair before."""
    for name, value in (("ANCHORS", 1), ("ROWS", 10), ("GROUP", 1), ("PARTITIONS", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(5)
    # Half of the anchors have a label of their own.
    rows = [(i, i if i % 20 == 0 else 1 + (i // 10) % 2, [rng.randint(1, 50) for _ in range(4)]) for i in range(160)]
    frame = spark.createDataFrame(rows, "id long, label long, x array<long>")
    want = plain(rows, lambda i: i % 10 == 0, 5, 3, 50, 95)
    assert sorted(map(tuple, mine_hard_negatives(frame, F.col("id") % 10 == 0).collect())) == want and want


def test_no_repeated_blocks_are_broadcast(spark):
    """Blocks that are repeated for their pairs are far larger than the tables they come from, after which Spark chose to broadcast them."""
    frame = spark.range(200).selectExpr("id", "id % 3 as label", "array(id, 7L) as x")
    todo, seen = [mine_hard_negatives(frame, F.col("id") % 10 == 0)._jdf.queryExecution().sparkPlan()], 0
    while todo:
        p = todo.pop()
        seen += p.nodeName() == "Generate"
        if p.nodeName() == "BroadcastHashJoin":
            side = (p.left() if str(p.buildSide()) == "BuildLeft" else p.right()).toString()
            assert "Generate" not in side or "MapInArrow" in side
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert seen
