"""Replay of a command stream with keyed state, and a follower kept current from a snapshot and a stream.

``replay_stream`` is ``transformWithStateInPandas`` keyed by (engine, key): the state of a key is its value,
expiry and the last seq that was applied. Rows of a batch are sorted by (ts_ms, seq); rows at or below
the last seq applied are repeats of a sender and are dropped, so at-least-once delivery is harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyfold.functions.expressions import live
from keyfold.operators import fold
from keyfold.schema import MOD_NEEDS_LIVE, REMOVES
from keyfold.sources import snapshot

REPLIES = "seq long, engine string, op string, key string, reply string"


def apply(state: tuple | None, engine: str, op: str, value: str | None, ttl_ms: int | None, now_ms: int) -> tuple[tuple | None, str | None]:
    """One command on one key: (value, expiry) or None before and after, and the reply."""
    if state is not None and state[1] is not None and state[1] <= now_ms:
        alive = False
    else:
        alive = state is not None
    if op in ("SET", "SETEX"):
        return (value or "", now_ms + int(ttl_ms) if op == "SETEX" else None), "OK"
    if op == "DEL":
        return None, str(int(state is not None))
    left = None if state is not None and not alive and op in REMOVES[engine] else state
    if op == "GET":
        return left, state[0] if alive else None
    if op == "EXIST":
        return left, str(int(alive))
    if op == "MOD":
        if not (alive if engine in MOD_NEEDS_LIVE else state is not None):
            return left, "ERR no such key"
        return (value or "", state[1]), "OK"
    if op == "EXPIRE":
        return (None, "0") if state is None else ((state[0], now_ms + int(ttl_ms)), "1")
    if op == "TTL":
        if state is None:
            return None, "-2"
        return state, "-1" if state[1] is None else str(max(0, -(-(state[1] - now_ms) // 1000)))
    return state, f"ERR unknown command '{op}'"


class ReplayProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kv", "present boolean, value string, expire_ms long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        engine, name = key
        kept, last = None, None
        if self.state.exists():
            present, value, expire_ms, last = self.state.get()
            kept = (value, expire_ms) if present else None
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        out = []
        for r in batch.itertuples():
            if last is not None and r.seq <= last:
                continue
            ttl = None if pd.isna(r.ttl_ms) else int(r.ttl_ms)
            kept, reply = apply(kept, engine, r.op, None if pd.isna(r.value) else r.value, ttl, int(r.ts_ms))
            last = int(r.seq)
            out.append((last, engine, r.op, name, reply))
        if last is not None:
            self.state.update((kept is not None, kept[0] if kept else None, kept[1] if kept else None, last))
        yield pd.DataFrame(out, columns=["seq", "engine", "op", "key", "reply"])

    def close(self) -> None: ...


def replay_stream(commands: DataFrame) -> DataFrame:
    """A reply for each command of a stream (``schema.COMMAND``); seq must grow with time within a key."""
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return commands.groupBy("engine", "key").transformWithStateInPandas(ReplayProcessor(), REPLIES, "Append", "None")


class Follower:
    """A table kept current: loads a snapshot, then applies batches of effective commands after its seq.

    Each batch is folded per key, so a batch may be sent again: rows up to the seq held are left out.
    Each version is written whole before it becomes the current one: a row of ``held`` (version, seq) is added after it. A
    follower that is started again at the same path goes on from the last such row. The version before the current
    one stays for readers that have begun; older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.seq = 0, 0
        if self._exists("held"):
            last = spark.read.schema("version long, seq long").parquet(f"{self.path}/held").orderBy(F.desc("version")).first()
            if last is not None:
                self.version, self.seq = last

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._folder(name)
        return files.exists(path)

    def _commit(self, table: DataFrame, seq: int) -> None:
        version = self.version + 1
        snapshot.write_table(table, f"{self.path}/v{version}")
        self.spark.createDataFrame([(version, seq)], "version long, seq long").coalesce(1).write.mode("append").parquet(f"{self.path}/held")
        self.version, self.seq = version, seq
        files, old = self._folder(f"v{version - 2}")
        files.delete(old, True)

    def load(self, kv_table: DataFrame, seq: int) -> None:
        """Start from a snapshot that holds all commands up to ``seq``."""
        self._commit(kv_table, seq)

    def table(self) -> DataFrame:
        return snapshot.read_table(self.spark, f"{self.path}/v{self.version}")

    def refuses(self, op: str) -> str | None:
        """A follower takes writes from its leader only."""
        return "READONLY" if op in ("SET", "SETEX", "MOD", "DEL", "EXPIRE") else None

    def apply_batch(self, commands: DataFrame, batch_id: int | None = None) -> None:
        """To be given to ``foreachBatch``."""
        new = commands.filter(F.col("seq") > self.seq)
        top = new.agg(F.max("seq")).first()[0]
        if top is None:
            return
        old = self.table()
        touched = old.join(new.select("engine", "key").distinct(), ["engine", "key"], "left_semi")
        # what is stored becomes the first command of its key
        first = touched.select(
            F.lit(self.seq).cast("long").alias("seq"),
            F.lit(0).cast("long").alias("ts_ms"),
            "engine",
            F.when(F.col("expire_ms").isNull(), "SET").otherwise("SETEX").alias("op"),
            "key",
            "value",
            F.col("expire_ms").alias("ttl_ms"),
        )
        log = first.unionByName(new.select(*first.columns))
        changed = fold.folded(log).groupBy("engine", "key").agg(F.max_by(F.struct("present_after", "val", "exp"), F.struct("ts_ms", "seq")).alias("s"))
        changed = changed.filter("s.present_after").select("engine", "key", F.col("s.val").alias("value"), F.col("s.exp").alias("expire_ms"))
        rest = old.join(new.select("engine", "key").distinct(), ["engine", "key"], "left_anti")
        self._commit(rest.unionByName(changed), top)


def deduplicated(commands: DataFrame) -> DataFrame:
    """Repeats of a resending sender removed."""
    return commands.dropDuplicates(["seq"])


def gaps(commands: DataFrame, flow: str, seq: str = "seq") -> DataFrame:
    """Where a flow's sequence jumps: (flow, after, before, missing)."""
    order = Window.partitionBy(flow).orderBy(seq)
    rows = commands.select(flow, F.lag(seq).over(order).alias("after"), F.col(seq).alias("before"))
    return rows.filter(F.col("before") > F.col("after") + 1).withColumn("missing", F.col("before") - F.col("after") - 1)


def current(table: DataFrame, now_ms: int) -> DataFrame:
    """A follower's live rows."""
    return table.filter(live(F.col("expire_ms"), F.lit(now_ms)))
