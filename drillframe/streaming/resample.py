"""Tumbling means over a stream of sensor rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(rows: DataFrame, key: str, ts: str, columns: Sequence[str], size: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Means by key and bucket; a bucket is final once the watermark has passed its end. Nulls are ignored."""
    windowed = rows.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, size).alias("w")).agg(*[F.avg(c).alias(c) for c in columns])
    return windowed.select(key, F.col("w.start").alias(ts), *columns)


def with_open_tail(emitted: DataFrame, rows: DataFrame, key: str, ts: str, columns: Sequence[str], size: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """What a stream over `rows` has emitted, and the buckets that it has left open: those that the watermark hasn't
    passed. They are made from the last rows alone, a bucket and the lateness before the latest."""
    last = rows.agg(F.max(ts).alias("_last"))
    since = F.col("_last") - F.expr(f"INTERVAL {size}") - F.expr(f"INTERVAL {late}")
    recent = rows.join(F.broadcast(last)).where(F.col(ts) >= since)
    bucket = F.window(ts, size)["start"]
    # Of the earliest of these buckets not all rows are recent; it has been emitted, as all have that end before the watermark.
    made = recent.groupBy(F.col(key), bucket.alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])
    seen = emitted.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"))
    tail = made.join(seen, F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts) == F.col("_ts")), "left_anti")
    return emitted.select(key, ts, *columns).unionByName(tail)


def hourly_stream(scored: DataFrame, key: str, ts: str, columns: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return resample_stream(scored, key, ts, columns, "1 hour", late)
