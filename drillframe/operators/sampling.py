"""Samples of an exact size that depend on the rows alone: not on partitions, retries or order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillframe.operators import windows
from drillframe.operators.durable import stored

#: Bits of a long that one pass settles.
STEP = 16


def kth_smallest(df: DataFrame, column: str, k: int) -> tuple[int, int, int]:
    """The k-th smallest value of a column of longs (k from 1), how many are smaller and how many equal.

    Each pass counts values by their next 16 bits, at most 65,536 counts, and goes on within the one that holds the rank.
    """
    found, below = 0, 0
    for shift in range(64 - STEP, -1, -STEP):
        part = F.call_function("shiftright", F.col(column), F.lit(shift))
        counts = sorted((r["part"], r["n"]) for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if below + n >= k:
                break
            below += n
        found = value
        df = df.where(part == found)
    return found, below, n


def exact_share(df: DataFrame, share: float, keys: Sequence[str], name: str = "is_validation", order: Column | None = None) -> DataFrame:
    """A flag that is true for exactly int(share * rows) rows, those with the smallest `order`, a long (else a hash of the
    keys). Equal ones go by a hash of the whole row, in which maps and variants don't count; of rows that are equal in
    that too, which can't be told apart, as many are taken as are needed. df is stored once."""
    hashed = [c for c, k in df.dtypes if "map<" not in k and "variant" not in k]
    first = F.xxhash64(*keys) if order is None else F.coalesce(order.cast("long"), F.lit(-(1 << 63)))
    rows = stored(df.withColumns({"_first": first, "_second": F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")}))
    left = int(rows.count() * share)
    flag, equal = F.lit(False), F.lit(True)
    for column in ("_first", "_second"):
        if not left:
            break
        value, below, ties = kth_smallest(rows.where(equal).select(column), column, left)
        flag = flag | equal & (F.col(column) < value)
        equal, left = equal & (F.col(column) == value), left - below
        if left == ties:
            flag, left = flag | equal, 0
    if not left:
        return rows.withColumn(name, flag).drop("_first", "_second")
    same = stored(rows.where(equal).withColumn("_part", F.spark_partition_id()))
    taken = windows.numbered(same, [], ["_second"], "_at", F.col("_part")).withColumn(name, F.col("_at") <= left).drop("_part", "_at")
    return rows.where(~equal).withColumn(name, flag).unionByName(taken).drop("_first", "_second")
