"""Point-in-time snapshots of all keyspaces.

The working form is a Parquet table partitioned by engine (``write_table``), which prunes and pushes filters. The
binary form, for exchange, is a Python data source, ``format("keyfold_snapshot")``: per task one file of
records, written aside and renamed, committed by ``_SUCCESS``. The path of the binary form must be
mounted on all machines. A truncated record ends its file without an error.

Fixed values, little-endian: key-value record u8 type (1 array, 2 rbtree, 3 hash, 4 skiplist), i64 expiry (-1: never),
i32 length, key, i32 length, value. Vector record u8 5, i32 length, question, i32 length, answer, i32 dim, i32
length, vector as text of six decimals.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyfold.functions.expressions import parse_vector, vector_text

TYPES = {"array": 1, "rbtree": 2, "hash": 3, "skiplist": 4}
VECTOR = 5
SCHEMA = "type int, expire_ms long, key string, value string, dim int, vector_text string"


def write_table(kv: DataFrame, path: str) -> None:
    """Parquet by engine, sorted by key within files so that their statistics bound keys."""
    kv.repartition("engine", F.pmod(F.xxhash64("key"), F.lit(64))).sortWithinPartitions("key").write.mode("overwrite").partitionBy("engine").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, expire_ms long, engine string").parquet(path).select("engine", "key", "value", "expire_ms")


def records(kv: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Key-value rows and vectors (question, answer, vector) as snapshot records."""
    kind = F.lit(None).cast("int")
    for name, number in TYPES.items():
        kind = F.when(F.col("engine") == name, number).otherwise(kind)
    out = kv.select(kind.alias("type"), "expire_ms", "key", "value", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("string").alias("vector_text"))
    if vectors is None:
        return out
    own = vectors.select(F.lit(VECTOR).alias("type"), F.lit(None).cast("long").alias("expire_ms"), F.col("question").alias("key"), F.col("answer").alias("value"), F.size("vector").alias("dim"), vector_text(F.col("vector")).alias("vector_text"))
    return out.unionByName(own)


def keyspaces(rows: DataFrame) -> DataFrame:
    """Key-value rows of snapshot records; null expiry means never."""
    engine = F.lit(None).cast("string")
    for name, number in TYPES.items():
        engine = F.when(F.col("type") == number, name).otherwise(engine)
    return rows.filter(F.col("type") != VECTOR).select(engine.alias("engine"), "key", "value", "expire_ms")


def vectors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("type") == VECTOR).select(F.col("key").alias("question"), F.col("value").alias("answer"), parse_vector(F.col("vector_text")).alias("vector"))


def encode(row) -> bytes:
    kind, expire_ms, key, value, dim, text = row
    key, value = (key or "").encode(), (value or "").encode()
    if kind == VECTOR:
        text = (text or "").encode()
        return struct.pack("<Bi", kind, len(key)) + key + struct.pack("<i", len(value)) + value + struct.pack("<ii", dim, len(text)) + text
    return struct.pack("<Bqi", kind, -1 if expire_ms is None else expire_ms, len(key)) + key + struct.pack("<i", len(value)) + value


def decode(data: bytes) -> Iterator[tuple]:
    at = 0

    def take(form: str):
        nonlocal at
        (value,) = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return value

    def text() -> str:
        nonlocal at
        size = take("i")
        if size < 0 or at + size > len(data):
            raise struct.error("cut off")
        at += size
        return data[at - size : at].decode("utf-8", "replace")

    try:
        while at < len(data):
            kind = take("B")
            if kind == VECTOR:
                key, value = text(), text()
                yield kind, None, key, value, take("i"), text()
            else:
                expire_ms = take("q")
                yield kind, None if expire_ms == -1 else expire_ms, text(), text(), None, None
    except struct.error:
        return


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        if os.path.isfile(self.path):  # one file of records, as a server leaves it
            return [_File(self.path)]
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.startswith("part-")]

    def read(self, partition: _File):
        with open(partition.path, "rb") as file:
            yield from decode(file.read())


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        os.makedirs(path, exist_ok=True)

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        aside = os.path.join(self.path, "_" + name)
        with open(aside, "wb") as file:
            for row in rows:
                file.write(encode(row))
        return _Written(name)

    def commit(self, messages):
        names = {m.name for m in messages if m is not None}
        for old in os.listdir(self.path):
            if self.overwrite and old.startswith("part-") and old not in names:
                os.remove(os.path.join(self.path, old))
        for name in names:
            os.replace(os.path.join(self.path, "_" + name), os.path.join(self.path, name))
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(aside := os.path.join(self.path, "_" + m.name)):
                os.remove(aside)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyfold_snapshot"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)


def write_binary(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("keyfold_snapshot").mode("overwrite").save(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("keyfold_snapshot").load(path)
