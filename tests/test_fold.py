import random

import pytest

from keyfold.operators import fold
from keyfold.schema import COMMAND, ENGINES
from keyfold.streaming.replay import apply
from tests.simulator import Keyspace

OPS = ("SET", "GET", "DEL", "MOD", "EXIST", "EXPIRE", "TTL", "SETEX")


def random_log(seed, engine="array", n=3000, keys=150):
    rng = random.Random(seed)
    now, rows = 1_000_000, []
    for seq in range(n):
        now += rng.choice((0, 0, 1, 500, 1000, 1500))
        op = rng.choice(OPS)
        rows.append((seq, now, engine, op, f"k{rng.randrange(keys)}", f"v{seq}", rng.choice((-1000, 0, 1, 40_000, 90_000, 200_000))))
    return rows


def simulated(rows, engine):
    space, out = Keyspace(engine), {}
    for seq, now, _, op, key, value, ttl in rows:
        out[seq] = space.run(op, key, value, ttl, now)
    return out, space


@pytest.mark.parametrize("engine", [*ENGINES, "logical"])
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_simulator(spark, engine, seed):
    rows = random_log(seed)
    expected, space = simulated(rows, engine)
    log = spark.createDataFrame(rows, COMMAND)
    got = {r.seq: r.reply for r in fold.replies(log, engine).collect()}
    assert got == expected
    now = rows[-1][1]
    state = {r.key: (r.value, r.expire_ms) for r in fold.state(log, now, engine).collect()}
    assert state == space.live(now)


def test_fold_as_of_and_effective(spark):
    rows = random_log(7, "rbtree")
    log = spark.createDataFrame(rows, COMMAND)
    cut = rows[1500][1]
    _, space = simulated([r for r in rows if r[1] <= cut], "rbtree")
    assert {r.key: (r.value, r.expire_ms) for r in fold.state(log, cut).collect()} == space.live(cut)
    # replaying only what changed data gives the same live keys
    short = fold.effective(log)
    now = rows[-1][1]
    assert short.count() < log.count()
    compact = {(r.key, r.value, r.ttl_ms) for r in fold.compacted(log, now).collect()}
    assert compact == {(k, v, None if u is None else u - now) for k, (v, u) in simulated(rows, "rbtree")[1].live(now).items()}


def test_mixed_engines_are_separate_namespaces(spark):
    rows = [(s * 4 + i, t, e, op, k, v, ttl) for s, t, _, op, k, v, ttl in random_log(3, n=800) for i, e in enumerate(ENGINES)]
    got = {r.seq: r.reply for r in fold.replies(spark.createDataFrame(rows, COMMAND)).collect()}
    for engine in ENGINES:
        expected, _ = simulated([r for r in rows if r[2] == engine], engine)
        assert {s: got[s] for s in expected} == expected


def test_stateful_step_equals_simulator():
    for engine in ENGINES:
        rows = random_log(5, engine)
        expected, _ = simulated(rows, engine)
        held = {}
        for seq, now, _, op, key, value, ttl in rows:
            held[key], reply = apply(held.get(key), engine, op, value, ttl, now)
            assert reply == expected[seq], (engine, seq, op)


SECOND = 1000


@pytest.mark.parametrize(
    "engine,commands,expected",
    [
        ("array", [("GET", 0), ("TTL", 0), ("DEL", 0), ("EXPIRE", 0), ("EXIST", 0), ("MOD", 0)], [None, "-2", "0", "0", "0", "ERR no such key"]),
        ("array", [("SET", 0), ("TTL", 0)], ["OK", "-1"]),
        ("array", [("SETEX", 0, 10), ("SET", 1), ("TTL", 1)], ["OK", "OK", "-1"]),
        ("array", [("SETEX", 0, 10), ("MOD", 0), ("TTL", 0)], ["OK", "OK", "10"]),
        ("rbtree", [("SETEX", 0, 1), ("MOD", 2)], ["OK", "OK"]),
        ("hash", [("SETEX", 0, 1), ("MOD", 2)], ["OK", "ERR no such key"]),
        ("array", [("SETEX", 0, 1), ("EXPIRE", 2, 10), ("GET", 3)], ["OK", "1", "v"]),
        ("array", [("SETEX", 0, 1), ("GET", 2), ("EXPIRE", 3, 10)], ["OK", None, "0"]),
        ("hash", [("SETEX", 0, 1), ("EXIST", 2), ("EXPIRE", 3, 10)], ["OK", "0", "1"]),
        ("skiplist", [("SETEX", 0, 1), ("EXIST", 2), ("EXPIRE", 3, 10)], ["OK", "0", "0"]),
    ],
)
def test_golden_cases(spark, engine, commands, expected):
    rows = [(i, 5_000_000 + c[1] * SECOND, engine, c[0], "k", "v", (c[2] if len(c) > 2 else 0) * SECOND) for i, c in enumerate(commands)]
    got = {r.seq: r.reply for r in fold.replies(spark.createDataFrame(rows, COMMAND)).collect()}
    assert [got[i] for i in range(len(rows))] == expected


def test_ttl_rounds_up(spark):
    rows = [(0, 0, "array", "SETEX", "k", "v", 2001), (1, 1000, "array", "TTL", "k", None, None), (2, 1001, "array", "TTL", "k", None, None), (3, 2000, "array", "TTL", "k", None, None)]
    got = {r.seq: r.reply for r in fold.replies(spark.createDataFrame(rows, COMMAND)).collect()}
    assert (got[1], got[2], got[3]) == ("2", "1", "1")


@pytest.mark.parametrize("engine", ["array", "hash", "skiplist"])
def test_hot_keys_are_folded_in_ranges(spark, monkeypatch, engine):
    """One key holds nearly all commands; in ranges the replies, states and effective commands are the same."""
    rows = [(s, t, e, op, "hot" if s % 10 else k, v, ttl) for s, t, e, op, k, v, ttl in random_log(21, engine, 1500, 20)]
    log = spark.createDataFrame(rows, COMMAND)
    whole = [sorted(map(str, f.collect())) for f in (fold.replies(log), fold.state(log), fold.effective(log))]
    expected, _ = simulated(rows, engine)
    assert {r.seq: r.reply for r in fold.replies(log).collect()} == expected
    cut = fold._cut
    monkeypatch.setattr(fold, "LEAST_BYTES", 0)
    monkeypatch.setattr(fold, "_cut", lambda log, _: cut(log, 100))
    parts = cut(log, 100).filter("key = 'hot'").groupBy("__part").count().collect()
    assert len(parts) > 40 and max(r["count"] for r in parts) < 100
    assert [sorted(map(str, f.collect())) for f in (fold.replies(log), fold.state(log), fold.effective(log))] == whole


def test_extra_columns_may_have_any_names(spark):
    log = spark.createDataFrame([(1, 0, "array", "SET", "k", "v", None, "x", 7)], "seq long, ts_ms long, engine string, op string, key string, value string, ttl_ms long, stored string, val int")
    assert [r.asDict() for r in fold.effective(log).collect()] == [r.asDict() for r in log.collect()]
    assert fold.replies(log).first().reply == "OK"
