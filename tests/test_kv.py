from keyfold.functions import expressions as X
from keyfold.operators import kv
from keyfold.schema import KV
from pyspark.sql import functions as F


def table(spark):
    return spark.createDataFrame([("array", "a", "1", None), ("array", "b", "2", 100), ("array", "c", "3", 200)], KV)


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_reads(spark):
    probes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    t = table(spark)
    assert rows(kv.get(probes, t, 150), "key", "value") == {("a", "1"), ("b", None), ("c", "3"), ("d", None)}
    assert rows(kv.missing(probes, t, 150), "key") == {("b",), ("d",)}
    assert rows(kv.exist(probes, t, 150), "key", "exist") == {("a", 1), ("b", 0), ("c", 1), ("d", 0)}
    assert rows(kv.ttl(probes, t, 150), "key", "ttl") == {("a", -1), ("b", 0), ("c", 1), ("d", -2)}
    assert rows(kv.expired(t, 150), "key") == {("b",)}


def test_writes(spark):
    t = table(spark)
    writes = spark.createDataFrame([("array", "a", "x", 5, 1), ("array", "a", "y", None, 2), ("array", "z", "w", 7, -9)], "engine string, key string, value string, expire_ms long, seq long")
    assert rows(kv.upsert(t, writes), "key", "value", "expire_ms") == {("a", "y", None), ("b", "2", 100), ("c", "3", 200), ("z", "w", 7)}
    changes = spark.createDataFrame([("b", "n"), ("q", "n")], "key string, new_value string")
    assert rows(kv.modify(t, changes), "key", "value", "expire_ms") == {("a", "1", None), ("b", "n", 100), ("c", "3", 200)}
    assert rows(kv.delete(t, changes.select("key")), "key") == {("a",), ("c",)}
    seconds = spark.createDataFrame([("a", 2), ("b", 1)], "key string, seconds long")
    assert rows(kv.expire(t, seconds, 1000), "key", "expire_ms") == {("a", 3000), ("b", 2000), ("c", 200)}


def test_key_equality_reaches_the_scan(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "kv"))
    plan = spark.read.parquet(str(tmp_path / "kv")).filter("key = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(X.frame(F.lit("RSET"), F.lit("key"), F.lit("é"))) == "*3\r\n$4\r\nRSET\r\n$3\r\nkey\r\n$2\r\né\r\n"
    assert [value(X.lenient_int(F.lit(s))) for s in ("12x", "abc", " -7", "")] == [12, 0, -7, 0]
    assert value(X.byte_sum(F.lit("abc"))) == 294 and value(X.byte_sum(F.lit(""))) == 0
    assert value(X.byte_sum(F.lit("é"))) == (0xC3 + 0xA9) % 1024
    assert value(X.encode_reply(F.lit("bulk"), F.lit(None).cast("string"))) == "$-1\r\n"


def test_probes_may_have_any_columns(spark):
    table = spark.createDataFrame([("array", "a", "1", None), ("array", "b", "2", 5)], "engine string, key string, value string, expire_ms long")
    probes = spark.createDataFrame([("a", "x", 1, True), ("c", "y", 2, False)], "key string, value string, expire_ms long, present boolean")
    for out, name, expected in ((kv.exist(probes, table, 3), "exist", {"a": 1, "c": 0}), (kv.ttl(probes, table, 3), "ttl", {"a": -1, "c": -2})):
        rows = out.collect()
        assert {r.key: r[name] for r in rows} == expected and {(r.key, r.value, r.expire_ms, r.present) for r in rows} == {("a", "x", 1, True), ("c", "y", 2, False)}
    assert {r.key: r.value for r in kv.get(probes, table, 3).collect()} == {"a": "1", "c": None}
    assert {r.key: r.present for r in kv.probe(probes, table).collect()} == {"a": True, "c": None}
