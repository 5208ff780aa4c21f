import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.operators import vector

FRUIT = [("doc:apple", "apple fruit", [1.0, 0.0, 0.0]), ("doc:banana", "banana fruit", [0.9, 0.1, 0.0]), ("doc:car", "car engine", [0.0, 1.0, 0.0])]


@pytest.fixture
def stored(spark):
    return vector.stored(spark.createDataFrame(FRUIT, "question string, answer string, vector array<float>"))


def test_search(stored):
    got = [(r.question, round(r.score, 6)) for r in vector.search(stored, [1, 0, 0], 2, 0.0).collect()]
    assert got == [("doc:apple", 1.0), ("doc:banana", 0.993884)]
    assert [r.question for r in vector.nearest(stored, [1, 0, 0], 0.999).collect()] == ["doc:apple"]
    assert vector.nearest(stored, [1, 0], 0.5).count() == 0
    with pytest.raises(ValueError):
        vector.search(stored, [1, 0, 0], 0)
    assert "TakeOrderedAndProject" in vector.search(stored, [1, 0, 0], 2)._jdf.queryExecution().executedPlan().toString()


def test_search_many_in_blocks(spark, stored):
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(9)], "query_id int, q array<float>")
    whole = {tuple(r) for r in vector.search_many(stored, queries, 2).select("query_id", "rank", "question").collect()}
    parts = {tuple(r) for r in vector.search_many(stored, queries, 2, block=2).select("query_id", "rank", "question").collect()}
    assert whole == parts and len(whole) == 18


def test_search_many_equals_search(spark):
    rng = random.Random(1)
    rows = [(f"q{i}", f"a{i}", [float(rng.randrange(-2, 3)) for _ in range(4 if i % 7 else 3)]) for i in range(200)]  # many ties
    stored = vector.stored(spark.createDataFrame(rows, "question string, answer string, vector array<float>"))
    asked = [(i, rows[i][2]) for i in range(0, 40, 3)] + [(900, [0.0] * 4), (901, None), (902, [1.0])]
    queries = spark.createDataFrame(asked, "query_id int, q array<double>")
    got = vector.search_many(stored, queries, 5, 0.2, block=4, chunk=30).collect()
    for i, q in asked[:-3]:
        if any(q):
            exact = [(r.question, r.answer, round(r.score, 9)) for r in vector.search(stored, q, 5, 0.2).collect()]
            assert [(r.question, r.answer, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == exact
    assert {r.query_id for r in got} <= {i for i, _ in asked[:-3]}
    assert vector.search_many(stored, queries.limit(0), 5).count() == 0 and vector.search_many(stored.limit(0), queries, 5).count() == 0


def test_get(spark, stored):
    assert [tuple(r) for r in vector.get(stored, "doc:car").collect()] == [("doc:car", "car engine")] and vector.get(stored, "doc:bus").count() == 0
    asked = spark.createDataFrame([("doc:car", "x", 1), ("doc:bus", "y", 2)], "question string, answer string, norm int")
    assert sorted((r.question, r.answer, r.norm) for r in vector.get_many(asked, stored).collect()) == [("doc:bus", None, 2), ("doc:car", "car engine", 1)]


def test_lsh_finds_what_exact_finds(stored):
    assert [r.question for r in vector.search_lsh(stored, [1.0, 0.0, 0.0], 2, 0.5).collect()] == ["doc:apple", "doc:banana"]


@pytest.mark.parametrize(
    "dim,text,reply",
    [(3, "0,0,0", "ERR vector set failed"), (3, "1,0", "ERR vector set failed"), (2, "1,,2", "OK"), (0, "1", "ERR invalid dim"), (1, "nan", "ERR vector set failed"), (1, "1x", "ERR vector set failed"), (2, " 1e1,-.5", "OK"), (1, "1e99", "ERR vector set failed")],
)
def test_validation(spark, dim, text, reply):
    row = vector.validated(spark.createDataFrame([(dim, text)], "dim int, text string")).first()
    assert row.reply == reply


def test_latest_and_parse(spark):
    rows = spark.createDataFrame([("q", "old", 1), ("q", "new", 2)], "question string, answer string, seq long")
    assert [tuple(r) for r in vector.latest(rows).select("question", "answer").collect()] == [("q", "new")]


def test_lsh_sends_no_pairs_and_no_copies_for_tables(spark):
    """The plan neither explodes vectors by table nor joins, and blocks of any size find what all pairs compared give."""
    rng = np.random.default_rng(5)
    rows = [(f"q{i}", f"a{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))] + [("odd", "x", [float("nan")] * 8), ("short", "y", [1.0, 2.0]), ("q1", "again", [1.0] * 8)]
    stored = vector.stored(spark.createDataFrame(rows, "question string, answer string, vector array<float>"))
    queries = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 300, 20)] + [(900, [0.0] * 8), (901, None)], "query_id int, q array<float>")
    exact = {(r.query_id, r.question, r.answer) for i, q in ((i, rows[i][2]) for i in range(0, 300, 20)) for r in vector.search(stored, np.float32(q).tolist(), None, 0.3).withColumn("query_id", F.lit(i)).collect()}
    assert len(exact) > 300 and (0, "odd", "x") in exact
    for block, chunk in ((65_536, 32_768), (4, 50)):
        found = vector._near(stored, queries, 8, 0.3, vector.LSH_TABLES, vector.LSH_WIDTH, block, chunk).collect()
        keys = [(r.query_id, r.question, r.answer) for r in found]
        assert len(keys) == len(set(keys)) and set(keys) <= exact and len(keys) >= 0.9 * len(exact)
        assert vector.count_reaching(stored, queries, 0.3, block=block, chunk=chunk).first().n == len(exact)
        assert vector.count_reaching(stored, queries, 0.3, vector.LSH_TABLES, block=block, chunk=chunk).first().n == len(keys)
    assert len(vector._near(stored, queries, 8, 0.3, 2, 0.1).collect()) < 0.9 * len(exact)  # narrow buckets lose pairs
    plan = vector.search_lsh_many(stored, queries, 8, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashes" not in plan
    assert vector.count_reaching(stored.limit(0), queries, 0.3).first().n == 0


@pytest.mark.parametrize("threshold,most", [(0.3, 0.2), (0.6, 0.005), (0.9, 0.002)])
def test_lsh_leaves_most_pairs_out(threshold, most):
    """Candidates are few, whatever the blocks, and hold nine tenths of what all pairs compared give; only they are scored."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3_000, 64))
    v[1::3] = v[::3] + rng.standard_normal((1_000, 64)) * rng.uniform(0.2, 3, (1_000, 1))  # pairs of any nearness
    v[-50:] = v[0]
    q = v[::10].copy()
    q[5], v[7] = np.nan, np.inf  # no direction: they meet all
    q_norm, v_norm = np.sqrt((q**2).sum(1)), np.sqrt((v**2).sum(1))
    with np.errstate(invalid="ignore"):
        run = vector._candidates(q, q_norm, v, v_norm, threshold, vector.LSH_TABLES, vector.LSH_WIDTH)
        pairs = {(i, j) for i, js in run(0, 300) for j in js.tolist()}
        exact, found = ({(a, b) for i, j, _ in vector._reached(q, q_norm, v, v_norm, threshold, tables, vector.LSH_WIDTH) for a, b in zip(i.tolist(), j.tolist())} for tables in (0, vector.LSH_TABLES))
    odd = {(5, j) for j in range(3_000)} | {(i, 7) for i in range(300)}
    assert odd <= pairs and odd <= found
    assert found == exact & pairs and len(found - odd) >= 0.9 * len(exact - odd) > 300
    far = len(pairs - odd - exact) / (300 * 3_000)
    assert far < most
    assert sum(len(js) for _, js in run(0, 150)) + sum(len(js) for _, js in run(150, 300)) == len(pairs)


@pytest.mark.parametrize("n", [1, 2, 64])
@pytest.mark.parametrize("width", [0.1, 0.4, 1.5])
def test_lsh_counts_shared_buckets(n, width):
    """Sketches differ in as many tables as the buckets themselves do, and pairs at the threshold are found at any width."""
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((40, n))
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    lines = vector._projections(n, 100)
    assert lines.shape == (100, n) and np.allclose((lines**2).sum(1), 1)
    buckets, sketches = vector._buckets(unit, lines, width), vector._sketches(unit, lines, width)
    for i in range(40):
        assert vector._differing(sketches[:, :, i], sketches).tolist() == (buckets[:, [i]] != buckets).sum(0).tolist()
    for threshold in (-2, -0.5, 0.3, 1, 2):
        assert 0 <= vector._most_differing(lines, threshold, width) < 100
