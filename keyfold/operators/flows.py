"""Byte flows as rows (flow, at, begin, size): what each segment adds, where data is lost, and idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reassemble(segments: DataFrame) -> DataFrame:
    """Segments in order of arrival ``at`` with ``fresh`` (bytes not seen before; 0 for a repeat) and ``reset`` (bytes are missing before it, the flow starts anew there)."""
    earlier = Window.partitionBy("flow").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("size")
    seen = F.max(end).over(earlier)
    rows = segments.withColumn("seen", seen)
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("begin"), F.coalesce("seen", "begin")))
    return rows.select(*segments.columns, fresh.alias("fresh"), F.coalesce(F.col("begin") > F.col("seen"), F.lit(False)).alias("reset"))


def sessions(rows: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """(flow, session, first_ms, last_ms, n): a flow that is idle for longer than ``idle_ms`` is dropped and begins anew."""
    order = Window.partitionBy("flow").orderBy("ts_ms")
    marked = rows.withColumn("anew", F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) > idle_ms, F.lit(False)).cast("long"))
    numbered = marked.withColumn("session", F.sum("anew").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("flow", "session").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
