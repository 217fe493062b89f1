"""Data-quality audits and model metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .durable import stored


def _grouped(df: DataFrame, by: Sequence[str] | None):
    return df.groupBy(*by) if by else df.groupBy()


def null_pct(df: DataFrame, columns: Sequence[str], by: Sequence[str] | None = None, digits: int | None = 1) -> DataFrame:
    share = lambda c: F.lit(100.0) * F.count_if(F.col(c).isNull()) / F.count("*")
    return _grouped(df, by).agg(*[(share(c) if digits is None else F.round(share(c), digits)).alias(f"{c}_null_pct") for c in columns])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def key_ranges(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    made = [a for c in columns for a in (F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_samp(c), digits).alias(f"{c}_std"))]
    return _grouped(df, by).agg(*made)


def label_stats(df: DataFrame, label: str, by: Sequence[str], digits: int = 2) -> DataFrame:
    made = {"mean": F.avg(label), "std": F.stddev_samp(label), "min": F.min(label), "max": F.max(label)}
    return df.groupBy(*by).agg(F.count(label).alias("n_rows"), *[F.round(v, digits).alias(f"{label}_{k}") for k, v in made.items()])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def describe(df: DataFrame, column: str, by: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles, most."""
    rows = stored(df.select(*(by or []), column))
    made = _grouped(rows, by).agg(F.count(column).alias("n_rows"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))
    found = stats.with_quantiles(made, stats.exact_quantiles(rows, by or [], [column], [0.25, 0.5, 0.75], stats.as_it_is), by or [])
    q = F.col(f"{column}_q")
    return found.select(*(by or []), "n_rows", "mean", "std", "least", *[q[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "most")


def vector_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation, least, most."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] | None = None, least: int = 0) -> DataFrame:
    """n_rows, rmse, mae and r2, all in one pass; groups of fewer than `least` rows are left out."""
    d = F.col(actual) - F.col(predicted)
    n = F.count(d)
    spread = F.var_pop(F.when(d.isNotNull(), F.col(actual))) * n
    r2 = F.lit(1.0) - F.sum(d * d) / F.when(spread != 0, spread)
    return _grouped(df, by).agg(n.alias("n_rows"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), r2.alias("r2")).where(F.col("n_rows") >= least)


def residual_stats(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    rows = stored(df.select((F.col(actual) - F.col(predicted)).alias("d")))
    made = rows.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
    found = stats.with_quantiles(made, stats.exact_quantiles(rows, [], ["d"], [0.05, 0.95], stats.as_it_is), [])
    return found.select("mean", "std", F.col("d_q")[0].alias("p5"), F.col("d_q")[1].alias("p95"))


def share_of(condition: Column) -> Column:
    """Share of rows for which the condition holds; null counts as not."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def supported(df: DataFrame, key: str, of: str, least: int) -> DataFrame:
    """Keys that stand with at least `least` different values of `of`."""
    return df.groupBy(key).agg(F.count_distinct(of).alias("n_distinct")).where(F.col("n_distinct") >= least)


def resample(df: DataFrame, key: str, ts: str, columns: Sequence[str], size: str = "30 seconds") -> DataFrame:
    """Means by key and time bucket, nulls ignored; only buckets that have rows."""
    from drillframe.functions import bucket

    return df.groupBy(key, bucket(ts, size).alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])
