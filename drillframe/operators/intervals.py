"""Interval joins: rows labelled by the half-open interval of their key that holds their value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillframe.operators import windows

#: Bytes up to which a table of intervals is broadcast; Spark's own estimate of the table is asked.
BROADCAST_BYTES = 64 << 20
#: Shares of the rows of one cell that are joined apart.
SALTS = 16


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer puts the table under `most` bytes. A Connect session can't ask it: then no."""
    plan = getattr(df, "_jdf", None)
    return plan is not None and int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df) else df


def interval_label(df: DataFrame, intervals: DataFrame, key: str, value: str, start: str, end: str, labels: dict[str, object]) -> DataFrame:
    """labels: column of intervals -> value where no interval matches. Intervals of one key must not overlap.

    The key makes it a hash join with the range as a residual. Intervals are few per key; the table is broadcast if its
    size is known to be small, else it is joined by the key, where adaptive execution splits skewed keys.
    """
    right = intervals.select(F.col(key).alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to"), *labels)
    on = (df[key] == F.col("_key")) & (df[value] >= F.col("_from")) & (df[value] < F.col("_to"))
    out = df.join(sized(right), on, "left").drop("_key", "_from", "_to")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in labels.items()})


def interval_carry(df: DataFrame, intervals: DataFrame, key: str, value: str, start: str, end: str, labels: dict[str, object], width: float) -> DataFrame:
    """The same rows as interval_label, by merging: starts and values stand in one order by key and value, and the last
    start is carried on to the values behind it, which it labels if it hasn't ended.

    The order is cut into blocks of `width` of the value. No task holds more than a block of a key, and neither side is
    broadcast: for keys with many intervals, or intervals of any number, and keys with any share of the rows.
    """
    spans = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    span = F.struct(F.col(end).cast("double").alias("to"), *[F.col(c).alias(c) for c in labels])
    row = F.struct(*[F.col(c) for c in df.columns])
    starts = spans.select(F.col(key).alias("_key"), F.col(start).cast("double").alias("_at"), F.lit(0).alias("_kind"), span.alias("_span"))
    values = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_at"), F.lit(1).alias("_kind"), row.alias("_row"))
    both = windows.forward_fill(starts.unionByName(values, allowMissingColumns=True), ["_key"], ["_at", "_kind"], ["_span"], _cell("_at", width))
    found = both.where("_kind = 1")
    holds = F.col("_key").isNotNull() & F.col("_at").isNotNull() & (F.col("_at") < F.col("_span.to"))
    return found.select("_row.*", *[F.coalesce(F.when(holds, F.col(f"_span.{c}")), F.lit(v)).alias(c) for c, v in labels.items()])


def range_label(df: DataFrame, intervals: DataFrame, value: str, start: str, end: str, width: float, labels: list[str]) -> DataFrame:
    """The same without a key: intervals are dealt to the cells of `width` that they touch and that hold values, values
    to theirs, and the cell is the join key. Long and open-ended intervals cost a row a cell with values, and a cell
    that lies within an interval gives a row of output at least."""
    right = intervals.where(F.col(start) < F.col(end)).select(F.col(start).alias("_from"), F.col(end).alias("_to"), *labels)
    right = right.withColumns({"_first": _cell("_from", width), "_last": _cell("_to", width)})
    # A cell may hold most rows: they are dealt out further, by a hash of all that can be hashed.
    salt = F.pmod(F.xxhash64(*[c for c, k in df.dtypes if "map<" not in k and "variant" not in k]), F.lit(SALTS))
    left = df.withColumns({"_cell": _cell(value, width), "_salt": salt})
    # Which cells with values lie in which interval: at the level of its length, an interval touches two cells or one.
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
    right = right.withColumn("_level", F.length(F.bin(F.col("_last") - F.col("_first"))))
    levels = right.agg(F.collect_set("_level").alias("_levels"))
    held = left.select("_cell").where("_cell IS NOT NULL").distinct().join(F.broadcast(levels)).select("_cell", F.explode("_levels").alias("_level"))
    touched = right.withColumn("_up", F.explode(F.array_distinct(F.array(up("_first"), up("_last")))))
    dealt = touched.join(held.withColumn("_up", up("_cell")), ["_level", "_up"]).where("_cell BETWEEN _first AND _last")
    dealt = dealt.select(F.col("_cell").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"), "_from", "_to", *[F.col(c).alias(f"_label_{c}") for c in labels])
    on = (F.col("_cell") == F.col("_at")) & (F.col("_salt") == F.col("_part")) & (F.col(value) >= F.col("_from")) & (F.col(value) < F.col("_to"))
    return left.join(dealt, on, "left").select(*df.columns, *[F.col(f"_label_{c}").alias(c) for c in labels])


def _cell(value: str, width: float):
    """The cell of a value; cells beyond 2^61, as of infinite ends, count as that one."""
    cell, most = F.floor(F.col(value).cast("double") / width), F.lit(1 << 61)
    return F.when(cell > most, most).when(cell < -most, -most).otherwise(cell)


def scaled(df: DataFrame, key: str, depth: str, out: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """depth in metres as `out`: a key whose highest depth can't be metres is taken to be in feet. `keep` may store the
    keys' scales: their size is then known, and where it is small no rows are dealt out by key, of which one may hold most."""
    from drillframe.functions import scale_of

    scales = keep(df.groupBy(key).agg(F.max(depth).alias("_highest")).select(F.col(key), scale_of("_highest").alias("_scale")))
    return df.join(sized(scales), key, "left").withColumn(out, F.col(depth) * F.col("_scale")).drop("_scale")
