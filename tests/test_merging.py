"""Interval joins by merging, and sketches of days that add up."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from drillframe import catalogue
from drillframe.operators import intervals, sketches

LABELS = {"name": "none", "number": 0}


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, low double, high double, name string, number int")


def test_merging_equals_the_join(spark):
    rng = random.Random(6)
    rows = []
    for k in "abc":
        edge = 0.0
        for i in range(200):
            low = edge + rng.choice([0.0, 0.5, 3.0])
            edge = low + rng.choice([0.0, 1.0, 2.5])
            rows.append((k, low, edge, f"{k}{i}", i))
    rows += [(None, 0.0, 1e9, "null", 1), ("d", -5.0, 1e308, "open", 2), ("e", None, 4.0, "x", 3)]
    values = [(i, rng.choice(["a", "a", "a", "b", "c", "d", "e", "z", None]), rng.choice([None, round(rng.uniform(-10, 500), 1), float(rng.randint(0, 300))])) for i in range(3000)]
    df = spark.createDataFrame(values + values[:50], "id long, k string, at double")
    table = spans(spark, rows)
    by_join = intervals.interval_label(df, table, "k", "at", "low", "high", LABELS)
    by_merge = intervals.interval_carry(df, table, "k", "at", "low", "high", LABELS, 7.0)
    assert by_merge.columns == by_join.columns
    assert sorted(map(tuple, by_merge.collect()), key=repr) == sorted(map(tuple, by_join.collect()), key=repr)
    assert by_merge.where("name <> 'none'").count() > 500


def test_a_hot_key_with_many_intervals_is_dealt_to_many_tasks(spark):
    n = 200_000
    table = spark.range(n).selectExpr("'hot' AS k", "id * 1D AS low", "id + 0.5D AS high", "CAST(id AS STRING) AS name", "CAST(id AS INT) AS number")
    df = spark.range(n).selectExpr("IF(id % 3 = 0, CONCAT('k', id % 50), 'hot') AS k", "id * 0.77D AS at")
    out = intervals.interval_carry(df, table, "k", "at", "low", "high", LABELS, 1000.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("name <> 'none' AND (k <> 'hot' OR number <> floor(at) OR at - floor(at) >= 0.5)").count() == 0
    assert out.where("name = 'none' AND k = 'hot' AND at - floor(at) < 0.5").count() == 0 and out.count() == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in held) < n / 3


@pytest.fixture(scope="module")
def series(spark):
    return catalogue.series(spark, "/root/testdata/sf0.1").select("well_name", "ts", "wob", "hkld", "rop").cache()


def day():
    return F.to_date("ts")


def ranks(df, column, value):
    """The share of values below, and of those up to the value."""
    r = df.where(F.col(column).isNotNull()).agg(F.avg((F.col(column) < value).cast("int")).alias("low"), F.avg((F.col(column) <= value).cast("int")).alias("high")).first()
    return r.low, r.high


def test_bounds_and_medians_within_the_error(spark, series):
    columns = ["wob", "hkld", "rop"]
    days = sketches.day_sketches(series, ["well_name"], day(), columns)
    assert days.count() == series.select("well_name", day()).distinct().count()
    found = sketches.bounds(days, columns).first().asDict() | {f"{c}_mid": v for c, v in sketches.medians(days, columns).first().asDict().items()}
    for c in columns:
        for end, share in (("lo", 0.01), ("hi", 0.99), ("mid", 0.5)):
            low, high = ranks(series, c, found[f"{c}_{end}"])
            assert low - sketches.RANK_ERROR <= share <= high + sketches.RANK_ERROR


def test_added_days_equal_a_full_build(spark, series):
    first, last = series.agg(F.min(day()), F.max(day())).first()
    cut = first + (last - first) / 2
    old = sketches.day_sketches(series.where(day() <= F.lit(cut)), ["well_name"], day(), ["wob"])
    new = sketches.day_sketches(series.where(day() > F.lit(cut)), ["well_name"], day(), ["wob"])
    both, full = old.unionByName(new), sketches.day_sketches(series, ["well_name"], day(), ["wob"])
    n = lambda d: {(r.well_name, r.day): r.n for r in d.select("well_name", "day", F.kll_sketch_get_n_double("wob").alias("n")).collect()}
    assert n(both) == n(full) and both.count() == full.count()
    for way in (both, full):
        for r in sketches.medians(way, ["wob"], ["well_name"]).collect():
            low, high = ranks(series.where(F.col("well_name") == r.well_name), "wob", r.wob)
            assert low - sketches.RANK_ERROR <= 0.5 <= high + sketches.RANK_ERROR


def test_small_groups_are_exact_and_empty_ones_null(spark):
    rows = [("a", dt.date(2020, 1, 1 + i % 3), float(i)) for i in range(101)] + [("b", dt.date(2020, 1, 1), None), ("b", dt.date(2020, 1, 2), float("nan"))]
    days = sketches.day_sketches(spark.createDataFrame(rows, "k string, d date, v double"), ["k"], F.col("d"), ["v"])
    assert {r.k: r.v for r in sketches.medians(days, ["v"], ["k"]).collect()} == {"a": 50.0, "b": None}
    assert sketches.bounds(days, ["v"]).first() == (1.0, 99.0)
