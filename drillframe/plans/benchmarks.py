"""Parameter benchmarks: quartiles of progress by formation, keys against the field, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillframe.functions import on_bottom_any_speed
from drillframe.operators import stats, windows
from drillframe.plans import features
from drillframe.plans.tops import FORMATIONS

PARAMETERS = ("wob", "rpm", "spp", "flow_in", "torque", "spm_total", "mwti")
LEAST_ROWS, GRID_ROWS, GRID_FORMATIONS = 50, 200, (7, 8, 12)


def on_bottom_rows(both: DataFrame, tops: DataFrame) -> DataFrame:
    return features.with_formation(features.with_pumps(both), tops).where(on_bottom_any_speed())


def quartile_benchmarks(rows: DataFrame, group: list[str], order: list[str], parameters: tuple[str, ...] = PARAMETERS, value: str = "rop", block: Column | None = None) -> DataFrame:
    """Rows, median and quartiles of value and medians of the parameters, by group and quartile of value."""
    placed = windows.tiles(rows, group[:1], order, 4, f"{value}_quartile", block)
    made = [F.round(stats.percentile(value, q), 2).alias(f"{value}_{n}") for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))]
    return placed.groupBy(*group, f"{value}_quartile").agg(F.count("*").alias("n_rows"), *made, *[F.round(stats.percentile(c, 0.5), 3).alias(c) for c in parameters])


def quartile_deltas(benchmarks: DataFrame, key: str, columns: list[str], tile: str = "rop_quartile", unknown: object = 0) -> DataFrame:
    """Fourth minus first quartile of each column, for keys that have both."""
    of = lambda n: benchmarks.where((F.col(tile) == n) & (F.col(key) != F.lit(unknown))).select(key, *[F.col(c).alias(f"{c}_q{n}") for c in columns])
    return of(1).join(of(4), key).withColumns({f"{c}_delta": F.col(f"{c}_q4") - F.col(f"{c}_q1") for c in columns})


def key_against_field(rows: DataFrame, key: str, group: list[str], value: str = "rop", least: int = LEAST_ROWS) -> DataFrame:
    """Median of value of each key and group, of the whole group, and their ratio; keys with `least` rows or more."""
    field = rows.groupBy(group[0]).agg(stats.percentile(value, 0.5).alias(f"field_median_{value}"), F.count("*").alias("field_rows"))
    own = rows.groupBy(key, *group).agg(stats.percentile(value, 0.5).alias(f"well_median_{value}"), F.count("*").alias("well_rows")).where(F.col("well_rows") >= least)
    ratio = F.round(F.col(f"well_median_{value}") / F.when(F.col(f"field_median_{value}") != 0, F.col(f"field_median_{value}")), 3)
    return own.join(field, group[0], "left").withColumn(f"{value}_ratio", ratio)


def formation_grid(rows: DataFrame, formations: tuple[int, ...] = GRID_FORMATIONS, least: int = GRID_ROWS) -> DataFrame:
    """Median progress over five bins of weight by five of rotation, for formations with rows enough."""
    return stats.quantile_grid(rows.where(F.col("formation_id").isin(*formations)), "formation_id", "wob", "rpm", "rop", 5, least)


def formation_name(formation_id: str = "formation_id") -> Column:
    return F.coalesce(F.get(F.array(F.lit("Unknown"), *map(F.lit, FORMATIONS)), F.col(formation_id).cast("int")), F.lit("Unknown"))
