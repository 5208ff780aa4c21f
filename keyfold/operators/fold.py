"""Replay of an ordered command log as a windowed fold.

Rows of a key are ordered by (ts_ms, seq). Running last values over the key tell, before each row, whether a value is
stored (SET and SETEX store, DEL removes), which one, and when it expires (SET and DEL clear expiry). A stored
value is dead once an operation that removes expired keys (``schema.REMOVES``) has met it expired, until it
is stored anew. All windows are on the key with one order, so the log is shuffled and sorted once.

A key that holds very many commands is cut into ranges of time. What a range needs of those before it is the last value of
each kind, so the ranges' last values are carried over the few ranges of a key, and each range is folded
by a task of its own. Only commands of one millisecond are never parted.

Input: ``schema.COMMAND`` (op without prefix). A log may mix keyspaces; each is a namespace of its own.
Negative or zero ttl means expired at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.expressions import ttl_seconds
from keyfold.schema import MOD_NEEDS_LIVE, REMOVES


def _one_of(mode: str | None, table: dict[str, tuple[str, ...]] | tuple[str, ...]) -> Column:
    """Is the row's op among those of the mode (None: of the row's own keyspace)?"""
    if mode is not None:
        return F.col("op").isin(*table[mode])
    out = F.lit(False)
    for engine, ops in table.items():
        out = out | ((F.col("engine") == engine) & F.col("op").isin(*ops))
    return out


KEY = ["engine", "key"]
COLUMNS = ["seq", "ts_ms", "engine", "op", "key", "value", "ttl_ms"]
#: Commands from which on a key is cut into ranges, how many ranges, and keys of which the ranges may be broadcast (512 bytes each).
HOT_ROWS, RANGES, MOST_HOT = 1_000_000, 64, 50_000
#: A command takes more bytes than this, so a log of fewer bytes has no key that needs ranges.
LEAST_BYTES = 16


def _cut(log: DataFrame, hot_rows: int) -> DataFrame | None:
    """The log with ``__part``, the range of a row of a hot key (null: the key is not hot); None without hot keys."""
    if log.isStreaming or int(str(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < hot_rows * LEAST_BYTES:
        return None
    hot = log.groupBy(*KEY).count().filter(F.col("count") > hot_rows).select(*KEY)
    n = hot.count()
    if not n:
        return None
    bounds = F.percentile_approx("ts_ms", [i / RANGES for i in range(1, RANGES)])
    bounds = log.join(F.broadcast(hot) if n <= MOST_HOT else hot, KEY, "left_semi").groupBy(*KEY).agg(bounds.alias("__bounds"))
    rows = log.join(F.broadcast(bounds) if n <= MOST_HOT else bounds, KEY, "left")
    part = F.when(F.col("__bounds").isNotNull(), F.size(F.filter("__bounds", lambda b: b < F.col("ts_ms"))))
    return rows.withColumn("__part", part).drop("__bounds")


def _running(rows: DataFrame, events: dict[str, Column]) -> DataFrame:
    """For each event its last value in the key that is not null: before the row (``name``) and with the row (``name_now``)."""
    cut = "__part" in rows.columns
    order = Window.partitionBy(*KEY, *["__part"] * cut).orderBy("ts_ms", "seq")
    earlier, here = (order.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.currentRow))
    before, now = ({n: F.last(e, True).over(w) for n, e in events.items()} for w in (earlier, here))
    if cut:
        at = F.struct("ts_ms", "seq")
        last = [F.max_by(e, F.when(e.isNotNull(), at)).alias(n) for n, e in events.items()]
        ranges = rows.filter("__part IS NOT NULL").groupBy(*KEY, "__part").agg(*last)
        across = Window.partitionBy(*KEY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.select(*KEY, "__part", *(F.last(n, True).over(across).alias(f"__carried_{n}") for n in events))
        rows = rows.join(carried, [*KEY, "__part"], "left")
        before, now = ({n: F.coalesce(c, F.col(f"__carried_{n}")) for n, c in x.items()} for x in (before, now))
    rows = rows.withColumns(before | {f"{n}_now": c for n, c in now.items()})
    return rows.drop(*(f"__carried_{n}" for n in events))


def folded(log: DataFrame, mode: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The log with each row's running state: present, val_before, exp_before (before the row), gone (an expired key is removed by it), present_after, val, exp. Columns of the log with these names are replaced."""
    op, ts = F.col("op"), F.col("ts_ms")
    names = log.columns
    stores = op.isin("SET", "SETEX")
    value = F.when(op.isin("SET", "SETEX", "MOD"), F.coalesce("value", F.lit("")))
    never = F.lit(None).cast("long")
    # a struct, as an expiry that is cleared is not the same as a row that leaves it alone
    expiry = F.when(op.isin("SET", "DEL"), F.struct(never.alias("at"))).when(op.isin("SETEX", "EXPIRE"), F.struct((ts + F.col("ttl_ms")).alias("at")))
    stored = F.when(stores, True).when(op == "DEL", False)
    cut = _cut(log, hot_rows)
    rows = _running(log if cut is None else cut, {"__stored": stored, "__val": value, "__exp": expiry})
    rows = rows.withColumns({"stored": F.coalesce("__stored", F.lit(False)), "val_before": F.col("__val"), "val": F.col("__val_now"), "exp_before": F.col("__exp.at"), "exp": F.col("__exp_now.at")})
    met_expired = F.coalesce(F.col("exp_before") <= ts, F.lit(False))
    rows = rows.withColumn("gone", _one_of(mode, REMOVES if mode is None else {mode: REMOVES[mode]}) & met_expired)
    rows = _running(rows, {"__dead": F.when(stores | (op == "DEL"), False).when(F.col("gone"), True)})
    rows = rows.withColumn("present", F.col("stored") & ~F.coalesce("__dead", F.lit(False)))
    after = F.when(stores, True).when(op == "DEL", False).otherwise(F.col("present") & ~F.col("gone"))
    own = ["stored", "val_before", "val", "exp_before", "exp", "gone", "present", "present_after"]
    return rows.withColumn("present_after", after).select(*(n for n in names if n not in own), *own)


def _needs_live(mode: str | None) -> Column:
    return F.lit(mode in MOD_NEEDS_LIVE) if mode is not None else F.col("engine").isin(*MOD_NEEDS_LIVE)


def _replied(log: DataFrame, mode: str | None) -> DataFrame:
    op = F.col("op")
    alive = F.col("present") & F.coalesce(F.col("exp_before") > F.col("ts_ms"), F.lit(True))
    strict = alive if mode == "logical" else F.col("present")
    may = F.when(_needs_live(mode), alive).otherwise(F.col("present"))
    number = lambda c: c.cast("int").cast("string")
    reply = (
        F.when(op.isin("SET", "SETEX"), "OK")
        .when(op == "GET", F.when(alive, F.col("val_before")))
        .when(op == "EXIST", number(alive))
        .when(op == "TTL", F.when(strict, ttl_seconds(F.col("exp_before"), F.col("ts_ms")).cast("string")).otherwise("-2"))
        .when(op == "MOD", F.when(may, "OK").otherwise("ERR no such key"))
        .when(op.isin("EXPIRE", "DEL"), number(strict))
    )
    return folded(log, mode).withColumn("reply", reply)


def replies(log: DataFrame, mode: str | None = None) -> DataFrame:
    """A reply for each command: (seq, engine, op, key, reply); null is nil."""
    return _replied(log.select(*COLUMNS), mode).select("seq", "engine", "op", "key", "reply")


def state(log: DataFrame, as_of_ms: int | None = None, mode: str | None = None) -> DataFrame:
    """Live keys after the rows up to ``as_of_ms`` (all rows, seen at the last one's time, if None): ``schema.KV``."""
    rows = log.select(*COLUMNS)
    rows = rows if as_of_ms is None else rows.filter(F.col("ts_ms") <= as_of_ms)
    last = folded(rows, mode).groupBy("engine", "key").agg(F.max_by(F.struct("present_after", "val", "exp", "ts_ms"), F.struct("ts_ms", "seq")).alias("s"))
    now = F.lit(as_of_ms).cast("long") if as_of_ms is not None else F.col("s.ts_ms")
    alive = F.col("s.present_after") & F.coalesce(F.col("s.exp") > now, F.lit(True))
    return last.filter(alive).select("engine", "key", F.col("s.val").alias("value"), F.col("s.exp").alias("expire_ms"))


def effective(log: DataFrame, mode: str | None = None) -> DataFrame:
    """The commands that changed data, as they came: what a durable log keeps and a follower needs."""
    writes = F.col("op").isin("SET", "SETEX", "MOD", "DEL", "EXPIRE") & F.col("reply").isin("OK", "1")
    whole = log.select(*COLUMNS, F.struct(*log.columns).alias("__row"))
    return _replied(whole, mode).filter(writes).select("__row.*")


def compacted(log: DataFrame, as_of_ms: int, mode: str | None = None) -> DataFrame:
    """The shortest log with the same live state: a SET, or a SETEX with the milliseconds left, for each live key."""
    rows = state(log, as_of_ms, mode)
    return rows.select(
        "engine",
        F.when(F.col("expire_ms").isNull(), "SET").otherwise("SETEX").alias("op"),
        "key",
        "value",
        (F.col("expire_ms") - as_of_ms).alias("ttl_ms"),
    )
