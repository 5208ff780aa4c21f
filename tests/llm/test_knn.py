import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import knn

SCHEMA = "vec_id long, embedding array<float>, score string, v int"


def brute(rows, k):
    good = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q, a in good:
        if q % 3 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)
    return sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 3 == 0, **kw).collect())


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(size=8) * (0.1 if i % 2 else 1)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # many of one vector: ties
    rows += [(500, None), (501, []), (502, [None] * 8), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (510, [0.0] * 8), (511, [1.0, 2.0]), (513, [3.0, 4.0]), rows[0]]
    assert run(spark, rows, k=5, pivots=12, block=20, chunk=50) == brute(rows, 5)


def test_fewer_candidates_than_k_and_none(spark):
    assert run(spark, [(3, [1.0]), (4, [2.0])], k=10) == [(3, 1, 4, 1024 * 2048)]
    assert run(spark, [(3, [1.0])], k=10) == []
    assert run(spark, [], k=10) == []


def test_large_values_stay_exact():
    big = np.array([[2**40 + 1, 3]])
    assert knn._products(big, np.array([[2**20, 1]]))[0, 0] == (2**40 + 1) * 2**20 + 3


@pytest.mark.parametrize("seed", range(5))
def test_best_breaks_ties_by_id(seed):
    rng = np.random.default_rng(seed)
    scores, ids = rng.integers(0, 4, (6, 30)), rng.permutation(30)
    rows, cols = knn._best(scores, ids, np.arange(6), 7)
    for q in range(6):
        expected = sorted((-scores[q, j], ids[j]) for j in range(30) if ids[j] != q)[:7]
        assert [(-scores[q, c], ids[c]) for c in cols[rows == q]] == expected


def test_clusters_are_pruned(spark, monkeypatch):
    """Far clusters: a group of queries meets little more than its own clusters."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(24, 16)) * 20
    rows = [(i, [float(x) for x in centers[i % 24] + rng.normal(size=16) * 0.3]) for i in range(3000)]
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(x))
    got = sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 3 == 0, k=5, pivots=24, block=100, chunk=500).collect())
    assert got == brute(rows, 5)
    least = next(x[0] for x in sent if isinstance(x, tuple) and len(x) == 3 and getattr(x[0], "ndim", 0) == 2)
    cells = next(x[0] for x in sent if isinstance(x, tuple) and isinstance(x[0], knn.Cells))
    cell, dist = cells.place(np.floor(1024 * np.array([e for _, e in rows], np.float32).astype(float)))
    assert len(least) > 5 and np.mean([dist >= one[cell] for one in least]) < 0.3


def test_few_queries_copy_the_data_once(spark):
    cells = knn.Cells(np.random.default_rng(2).normal(size=(96, 4)))
    assert set(knn._groups(cells, np.full(96, 5), 8192)) == {0}
    groups = knn._groups(cells, np.full(96, 5000), 8192)
    assert len(set(groups)) == 96


def test_many_lengths(spark):
    """More lengths than have pivots of their own; repeated rows among the rare ones."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 14)]) for i in range(250)]
    rows += rows[:40]
    assert run(spark, rows, k=4, block=3, chunk=7) == brute(rows, 4)
