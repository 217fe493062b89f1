"""Quantiles of days that add up: sketches by key and day, merged into medians and bounds.

A sketch (KLL, Spark's own) holds a sample of some hundred values, whatever it has seen; merging two gives a sketch of
both. A new day is sketched once, and medians and bounds of all days come out of sketches alone: the rows of earlier days
are not read again. With K = 400 a quantile's rank errs by less than RANK_ERROR of all values in 99 cases of 100; up to
some hundred values of a group it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the share of all values by which ranks err.
K, RANK_ERROR = 400, 0.01


def day_sketches(df: DataFrame, keys: Sequence[str], day: Column, columns: Sequence[str], k: int = K) -> DataFrame:
    """keys, day and a sketch of each column, one row per key and day; nulls and NaN don't count."""
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    return df.groupBy(*keys, day.alias("day")).agg(*[F.kll_sketch_agg_double(v, k).alias(c) for c, v in values.items()])


def merged(sketches: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One sketch per column and group, of all days; without `by` one row of all keys."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def _quantile(sketch: str, share: float) -> Column:
    """Null for a sketch of nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def quantiles(sketches: DataFrame, by: Sequence[str], shares: dict[str, tuple[str, float]]) -> DataFrame:
    """name -> (column, share): one row per group, as stats.medians and stats.bounds give it."""
    whole = merged(sketches, by, sorted({c for c, _ in shares.values()}))
    return whole.select(*by, *[_quantile(c, share).alias(name) for name, (c, share) in shares.items()])


def medians(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return quantiles(sketches, by, {c: (c, 0.5) for c in columns})


def bounds(sketches: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """{c}_lo and {c}_hi."""
    return quantiles(sketches, by, {f"{c}_{end}": (c, share) for c in columns for end, share in (("lo", low), ("hi", high))})
