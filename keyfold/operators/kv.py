"""Batch operations over a key-value table (``schema.KV``): DataFrame in, DataFrame out.

Keys are probed by equi-join; Spark picks broadcast or sort-merge by measured size, and equality on a
literal key reaches the Parquet scan. A null ``expire_ms`` means never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions.expressions import live, ttl_seconds


def _now(now_ms: int | Column) -> Column:
    return now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("long")


def probe(probes: DataFrame, kv: DataFrame) -> DataFrame:
    """Left join by key; ``present`` tells a stored null from a missing key. Columns of the probes with the names of those added are replaced."""
    own = ("value", "expire_ms", "present")
    return probes.drop(*own).join(kv.select("key", "value", "expire_ms", F.lit(True).alias("present")), "key", "left")


def _met(probes: DataFrame, kv: DataFrame) -> DataFrame:
    """Probes, whatever their columns, with the expiry and presence of their key under names of their own."""
    return probes.join(kv.select("key", F.col("expire_ms").alias("__expire_ms"), F.lit(True).alias("__present")), "key", "left")


def get(probes: DataFrame, kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """Probes with the live value, or null; a column ``value`` of the probes is replaced."""
    now = _now(now_ms)
    return probes.drop("value").join(kv.filter(live(F.col("expire_ms"), now)).select("key", "value"), "key", "left")


def missing(probes: DataFrame, kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """Probes without a live value."""
    return probes.join(kv.filter(live(F.col("expire_ms"), _now(now_ms))).select("key"), "key", "left_anti")


def exist(probes: DataFrame, kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """Probes with 1 or 0."""
    alive = F.col("__present").isNotNull() & live(F.col("__expire_ms"), _now(now_ms))
    return _met(probes, kv).withColumn("exist", alive.cast("int")).drop("__expire_ms", "__present")


def ttl(probes: DataFrame, kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """Probes with -2 (missing), -1 (no expiry) or seconds left, rounded up."""
    left = F.when(F.col("__present").isNull(), F.lit(-2).cast("long")).otherwise(ttl_seconds(F.col("__expire_ms"), _now(now_ms)))
    return _met(probes, kv).withColumn("ttl", left).drop("__expire_ms", "__present")


def upsert(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """Last writer wins: ``writes`` has (engine, key, value, expire_ms, seq); of a key's writes the highest seq counts, and any write beats the table. A write without expiry clears it."""
    old = kv.select("engine", "key", F.struct(F.lit(None).cast("long").alias("seq"), "value", "expire_ms").alias("row"))
    new = writes.select("engine", "key", F.struct(F.col("seq").cast("long").alias("seq"), "value", F.col("expire_ms").cast("long").alias("expire_ms")).alias("row"))
    best = old.union(new).groupBy("engine", "key").agg(F.max_by("row", F.coalesce(F.col("row.seq"), F.lit(-(2**63) + 1))).alias("row"))
    return best.select("engine", "key", "row.value", "row.expire_ms")


def modify(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """New values for keys that are present; expiry stays. ``changes``: distinct (key, new_value)."""
    joined = kv.join(changes, "key", "left")
    return joined.select("engine", "key", F.coalesce("new_value", "value").alias("value"), "expire_ms")


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among ``keys``; expiry plays no part."""
    return kv.join(keys, "key", "left_anti").select("engine", "key", "value", "expire_ms")


def expire(kv: DataFrame, changes: DataFrame, now_ms: int | Column) -> DataFrame:
    """Set expiry to now + seconds for keys that are present, expired ones too. ``changes``: distinct (key, seconds)."""
    at = F.when(F.col("seconds").isNotNull(), _now(now_ms) + F.col("seconds").cast("long") * 1000).otherwise(F.col("expire_ms"))
    return kv.join(changes, "key", "left").select("engine", "key", "value", at.alias("expire_ms"))


def expired(kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """Rows whose expiry has passed."""
    return kv.filter(F.col("expire_ms") <= _now(now_ms))


def purge(kv: DataFrame, now_ms: int | Column) -> DataFrame:
    """The table without expired rows: what an active scan leaves."""
    return kv.filter(live(F.col("expire_ms"), _now(now_ms)))
