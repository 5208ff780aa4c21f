"""The generated tables as keyspaces, command log and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.expressions import millis, norm

#: The clock of the registered queries: 2024-01-20 UTC for the event log, 1997-01-01 UTC for orders.
EVENT_CLOCK = 1_705_708_800_000
ORDER_CLOCK = 852_076_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyspace(spark: SparkSession, sf_dir: str, engine: str) -> DataFrame:
    """``schema.KV`` of one engine."""
    name, prefix, key, value = {
        "array": ("customer", "cust:", "c_custkey", "c_name"),
        "rbtree": ("part", "part:", "p_partkey", "p_name"),
        "hash": ("supplier", "supp:", "s_suppkey", "s_name"),
        "skiplist": ("orders", "order:", "o_orderkey", "o_orderpriority"),
    }[engine]
    rows = table(spark, sf_dir, name)
    never = F.lit(None).cast("long")
    expire = F.when(F.col("o_orderkey") % 3 != 0, millis(F.col("o_orderdate")) + (F.col("o_orderkey") % 30) * 86_400_000) if engine == "skiplist" else never
    return rows.select(F.lit(engine).alias("engine"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.col(value).alias("value"), expire.alias("expire_ms"))


def all_keyspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = (keyspace(spark, sf_dir, e) for e in ("array", "rbtree", "hash", "skiplist"))
    for other in rest:
        first = first.unionByName(other)
    return first


def command_log(spark: SparkSession, sf_dir: str, engine: str = "array") -> DataFrame:
    """``schema.COMMAND`` from events."""
    kind, n = F.col("event_type"), F.col("event_id") % 4
    op = (
        F.when(kind == "click", "SET")
        .when(kind == "view", "GET")
        .when(kind == "purchase", "SETEX")
        .when(kind == "signup", "EXPIRE")
        .when(n == 0, "DEL")
        .when(n == 1, "MOD")
        .when(n == 2, "EXIST")
        .otherwise("TTL")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        millis(F.col("ts")).alias("ts_ms"),
        F.lit(engine).alias("engine"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        ((F.col("event_id") % 7 + 1) * 3_600_000).alias("ttl_ms"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, answer, vector, norm, seq) from embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    named = rows.select(
        F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("question"),
        F.concat(F.lit("label:"), F.col("label").cast("string")).alias("answer"),
        F.col("embedding").alias("vector"),
        F.col("vec_id").alias("seq"),
    )
    return named.withColumn("norm", norm(F.col("vector"))).filter("norm > 0")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector as a query; equality reaches the scan."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])
