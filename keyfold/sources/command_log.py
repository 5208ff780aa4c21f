"""Command logs: a folder of segments, each a plain concatenation of frames (arrays of bulk strings).

Writing is native: frames are built as columns and written as text; a command without a key is refused, and a time to live is
rounded up to seconds, so that no expiry comes early. Reading goes through Spark's binary file
source, so any file system works and each segment (2 GB at most) is a task; frames are cut by their lengths, as values may
hold line ends. A segment's first bad or partial frame ends it, without an error; ``unread`` tells how many bytes that leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions.expressions import frame_of, lenient_int
from keyfold.schema import PREFIX

#: Limits of a frame: arguments, bytes of one.
MOST_ARGS, MOST_BYTES = 1_024, 512 << 20


def frames(data: bytes) -> Iterator[list[bytes]]:
    """Arguments of each whole frame, up to the first that is bad or cut off."""
    for args, _ in placed_frames(data):
        yield args


def placed_frames(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """As ``frames``, each with the place where it ends."""
    at, end = 0, len(data)

    def number(mark: bytes) -> int | None:
        nonlocal at
        stop = data.find(b"\r\n", at)
        if data[at : at + 1] != mark or stop < 0:
            return None
        digits = data[at + 1 : stop]
        at = stop + 2
        return int(digits) if digits.isdigit() else None

    while at < end:
        count = number(b"*")
        if not count or count > MOST_ARGS:
            return
        args = []
        for _ in range(count):
            size = number(b"$")
            if size is None or size > MOST_BYTES or data[at + size : at + size + 2] != b"\r\n":
                return
            args.append(data[at : at + size])
            at += size + 2
        yield args, at


def argv_of(log: DataFrame) -> Column:
    """A command row (``schema.COMMAND``) as arguments; seconds of SETEX and EXPIRE, rounded up, stand last. A null key is an error."""
    prefix = F.lit("")
    for engine, p in PREFIX.items():
        prefix = F.when(F.col("engine") == engine, p).otherwise(prefix)
    verb = F.concat(prefix, F.col("op"))
    seconds = F.ceil(F.coalesce("ttl_ms", F.lit(0)) / 1000).cast("string")
    value = F.coalesce("value", F.lit(""))
    key = F.when(F.col("key").isNull(), F.raise_error(F.concat(F.lit("a command without a key: seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("key"))
    return (
        F.when(F.col("op").isin("SET", "MOD"), F.array(verb, key, value))
        .when(F.col("op") == "SETEX", F.array(verb, key, value, seconds))
        .when(F.col("op") == "EXPIRE", F.array(verb, key, seconds))
        .otherwise(F.array(verb, key))
    )


def write_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write commands in order of seq; each range of seq is a segment, and segments' names sort in order."""
    ordered = log.repartitionByRange("seq").sortWithinPartitions("seq")
    # a frame ends with a line end, which the text writer adds
    text = F.expr("substring(f, 1, length(f) - 2)")
    ordered.select(frame_of(argv_of(log)).alias("f")).select(text.alias("value")).write.mode(mode).option("lineSep", "\r\n").text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(seq from 1, argv) in order of segment and place. Only the segments' counts are brought together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                found = [[a.decode("utf-8", "replace") for a in args] for args in frames(data)]
                for begin in range(0, len(found), 10_000):
                    part = found[begin : begin + 10_000]
                    yield pd.DataFrame({"path": name, "place": range(begin + 1, begin + len(part) + 1), "argv": part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, place long, argv array<string>")
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("path", before.alias("before"))
    return rows.join(starts, "path").select((F.col("before") + F.col("place")).alias("seq"), "argv")


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, unread): of each segment the bytes that a bad or partial frame keeps from being read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [max((end for _, end in placed_frames(data)), default=0) for data in batch["content"]]
            sizes = [len(data) for data in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "size": sizes, "unread": [n - e for n, e in zip(sizes, ends)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, size long, unread long")


def arguments(framed: DataFrame, frame: str = "frame") -> DataFrame:
    """``framed`` with ``argv``, the arguments of the first frame in the column ``frame``, cut by their lengths; null where it is bad or cut off."""

    @F.pandas_udf("array<string>")
    def first(rows: pd.Series) -> pd.Series:
        found = (next(frames(x.encode()), None) if x is not None else None for x in rows)
        return pd.Series([None if f is None else [a.decode("utf-8", "replace") for a in f] for f in found], dtype=object)

    return framed.withColumn("argv", first(F.col(frame)))


def commands_of(rows: DataFrame, ts_ms: Column) -> DataFrame:
    """Arguments as ``schema.COMMAND``; ``ts_ms`` anchors relative expiry. Verbs of no keyspace are left out."""
    verb = F.col("argv")[0]
    engine, op = F.lit(None).cast("string"), F.lit(None).cast("string")
    verbs = ("SET", "GET", "DEL", "MOD", "EXIST", "EXPIRE", "TTL", "SETEX")
    for name, prefix in PREFIX.items():
        own = verb.isin(*(prefix + v for v in verbs))
        engine = F.when(own, name).otherwise(engine)
        op = F.when(own, F.expr(f"substring(argv[0], {len(prefix) + 1})")).otherwise(op)
    value = F.when(op.isin("SET", "MOD", "SETEX"), F.get("argv", F.lit(2)))
    seconds = F.when(op == "SETEX", F.get("argv", F.lit(3))).when(op == "EXPIRE", F.get("argv", F.lit(2)))
    ttl = F.when(seconds.isNotNull(), lenient_int(seconds) * 1000)
    return rows.select("seq", ts_ms.alias("ts_ms"), engine.alias("engine"), op.alias("op"), F.get("argv", F.lit(1)).alias("key"), value.alias("value"), ttl.alias("ttl_ms")).filter("engine IS NOT NULL")
