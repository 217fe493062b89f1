"""Efficiency of drilling against a model of what was to be expected, over the last part of each key's time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillframe.functions import hour
from drillframe.operators import audits, stats, windows
from drillframe.operators.durable import stored
from drillframe.plans import features

UNDER, FLOOR = 0.70, 0.5


def prepare(both: DataFrame, block: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Features with a `split` by position in time; medians and bounds are those of the training rows, the bounds
    before the fill. The split comes first: rows that warm-up drops count towards it."""
    own = features.BASE + ("rop",)
    filled = windows.forward_fill(features.with_pumps(both), ["well_name"], ["ts"], features.BASE, block)
    split = keep(windows.split_by_position(filled, ["well_name"], ["ts"], block=block))
    train = split.where("split = 'train'")
    whole = stats.fill_with(split, stats.medians(train, features.BASE), features.BASE)
    return features.window_features(stats.clip(whole, stats.bounds(train, own), own), block)


def efficiency(df: DataFrame, actual: str = "rop", predicted: str = "pred_rop") -> DataFrame:
    return df.withColumn("efficiency", F.col(actual) / F.greatest(F.col(predicted), F.lit(FLOOR)))


def hourly(scored: DataFrame, key: str = "well_name") -> DataFrame:
    """Means by key and hour."""
    means = {"actual_rop": "rop", "pred_rop": "pred_rop", "efficiency": "efficiency", "wob_mean": "wob", "rpm_mean": "rpm", "dmea_mean": "dmea"}
    return scored.groupBy(key, hour("ts").alias("ts_hour")).agg(*[F.avg(c).alias(n) for n, c in means.items()], F.count("rop").alias("n_rows"))


def underperforming(hours: DataFrame, n: int = 30, under: float = UNDER) -> DataFrame:
    """The n worst hours below the threshold; a top-k that keeps n rows a task."""
    return hours.where(F.col("efficiency") < under).orderBy("efficiency", *[c for c in hours.columns if c in ("well_name", "ts_hour")]).limit(n)


def key_summary(hours: DataFrame, key: str = "well_name", under: float = UNDER) -> DataFrame:
    """Hours, efficiency and exact medians of each key, the least efficient first."""
    rows = stored(hours.select(key, "ts_hour", "efficiency", "actual_rop", "pred_rop"))
    made = rows.groupBy(key).agg(F.count("ts_hour").alias("hours_analysed"), F.avg("efficiency").alias("mean_efficiency"), audits.share_of(F.col("efficiency") < under).alias("pct_underperf"))
    found = stats.with_quantiles(made, stats.exact_quantiles(rows, [key], ["actual_rop", "pred_rop"], [0.5], stats.as_it_is), [key])
    medians = [F.col(f"{c}_q")[0].alias(f"median_{c}") for c in ("actual_rop", "pred_rop")]
    return found.select(key, "hours_analysed", "mean_efficiency", "pct_underperf", *medians).orderBy("mean_efficiency", key)


def scored_table(df: DataFrame) -> DataFrame:
    return df.select("well_name", "ts", "rop", "pred_rop", "efficiency", "dmea", "wob", "rpm", "spp", "flow_in", "torque", "split")
