"""From cleaned logs to a feature matrix for a model across keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillframe.functions import in_window, is_month_start, sum_as_zero
from drillframe.operators import audits, intervals, stats, windows

#: The channels of a row, those that are imputed and clipped, those that are rolled and lagged, and frames.
CHANNELS = ("rop", "wob", "rpm", "spp", "flow_in", "torque", "hkld", "dmea", "bpos", "spm1", "spm2", "spm3", "mwti")
PUMPS = ("spm1", "spm2", "spm3")
BASE = ("wob", "rpm", "spp", "flow_in", "torque", "hkld", "mwti", "spm_total")
ROLLED, LAGGED = ("wob", "rpm", "spp", "flow_in", "torque"), ("wob", "rpm")
SHORT, LONG, OFFSETS = 10, 60, (1, 5)
META = ("well_name", "ts", "rop", "split")


def clean_raw(raw: DataFrame, first: str = "2007-01-01", before: str = "2010-01-01") -> DataFrame:
    """Rows within the drilling window, without month-start placeholders; NaN as null."""
    numbers = [c for c, t in raw.dtypes if t == "double"]
    return stats.nan_to_null(raw.where(in_window("ts", first, before) & ~is_month_start("ts")), numbers)


def labelled_series(raw: DataFrame, key: str = "well_name", size: str = "30 seconds") -> DataFrame:
    """Means by key and time bucket, of buckets that have the label."""
    return audits.resample(raw, key, "ts", CHANNELS, size).where(F.col("rop").isNotNull())


def split_by_key(df: DataFrame, held_out: Sequence[str], key: str = "well_name") -> tuple[DataFrame, DataFrame]:
    """Rows of keys that aren't held out, and of those that are; a null key falls in neither."""
    return df.where(~F.col(key).isin(*held_out)), df.where(F.col(key).isin(*held_out))


def with_pumps(df: DataFrame) -> DataFrame:
    return df.withColumn("spm_total", sum_as_zero(*PUMPS)).drop(*PUMPS)


def with_formation(df: DataFrame, tops: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """formation_id and formation by depth in metres; 0 and Unknown above all tops. `keep` may store the scales and tops,
    so that their size is known to the joins."""
    deep = intervals.scaled(df, "well_name", "dmea", "dmea_m", keep)
    out = intervals.interval_label(deep, keep(tops), "well_name", "dmea_m", "md_from_m", "md_to_m", {"formation": "Unknown", "formation_id": 0})
    return out.drop("dmea_m")


def window_features(df: DataFrame, block: Column | None = None) -> DataFrame:
    """Rolling means and deviations, lags and warm-up of all channels in one pass over each key."""
    means = {f"{c}_r{n}_mean": (c, n) for c in ROLLED for n in (SHORT, LONG)}
    spreads = {f"{c}_r{LONG}_std": (c, LONG) for c in ROLLED}
    lags = {f"{c}_lag{n}": (c, n) for c in LAGGED for n in OFFSETS}
    out = windows.prior_rows(df, ["well_name"], ["ts"], means, spreads, lags, "_at", block)
    out = out.where(F.col("_at") > LONG).drop("_at")
    return stats.zero_fill(out, [c for c, t in out.dtypes if c not in META and t == "double"])


def feature_matrices(train: DataFrame, test: DataFrame, tops: DataFrame, exclude: Sequence[str] = (), block: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Features of both parts; medians and bounds are those of the training part, taken after the forward fill.

    The filled rows are read thrice for medians, thrice for bounds and for the features. `keep` may store them in
    between (operators.durable.stored), so that the joins and the fill run once.
    """
    made = prepared(train, test, tops, exclude, block, keep)
    return feature_part(made, False, block), feature_part(made, True, block)


def prepared(train: DataFrame, test: DataFrame, tops: DataFrame, exclude: Sequence[str] = (), block: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What feature_part takes: both parts filled and clipped, told apart by _test."""
    return prepared_rows(train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True))), tops, exclude, block, keep)


def prepared_rows(rows: DataFrame, tops: DataFrame, exclude: Sequence[str] = (), block: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The same for parts that come out of one table, told apart by _test: it is read once, not once a part."""
    both = with_formation(with_pumps(rows), tops, keep).drop("formation", *exclude)
    filled = keep(windows.forward_fill(both, ["well_name"], ["ts"], BASE, block, keep))
    own = filled.where(~F.col("_test"))
    medians = keep(stats.medians(own, BASE))
    bounds = keep(stats.bounds(stats.fill_with(own, medians, BASE), BASE))
    return stats.clip(stats.fill_with(filled, medians, BASE), bounds, BASE)


def feature_part(made: DataFrame, test: bool, block: Column | None = None) -> DataFrame:
    """Features of one part; who asks for one doesn't pay for the windows of both."""
    return window_features(made.where(F.col("_test") == test).drop("_test"), block)
