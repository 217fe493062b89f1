"""Queries over the test tables, one or more for each operator, with the same in SQL.

`events` stands for the sensor series: a key (event_type), a unique time and channels made from value and props, with
nulls put in by event_id. `part` stands for tops: intervals of price by type. Computed doubles are rounded on both
sides, as sums depend on their order in the last digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillframe.functions import band, bridge_name, cell, decode_entities, first_match, hour, in_window, is_month_start, keyword_hit, lookup, on_bottom, parse_time, sum_as_zero, thousands
from drillframe.operators import audits, intervals, stats, windows
from drillframe.operators.durable import own_folder, stored
from drillframe.plans import benchmarks, features, model, retrospective
from drillframe.plans.tops import FORMATION_RULES, ORDINAL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Event types that stand for held-out keys.
HELD_OUT = ("error", "signup")
TYPE_WELL = {"ECONOMY": "view", "LARGE": "click", "SMALL": "signup", "MEDIUM": "error", "STANDARD": "purchase"}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {SERIES}, {TOPS} {sql}" if not sql.lstrip().startswith("WITH ") else f"WITH {SERIES}, {TOPS}, {sql.lstrip()[5:]}"
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six decimal places, other than the columns named."""
    return df.select(*[F.round(c, 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes])


#: Values are cut to eighths: sums and means of them are exact in whatever order they are taken.
SERIES = """eighths AS (SELECT *, floor(value * 8) / 8 AS v FROM events), s AS (
  SELECT event_id, ts, user_id, event_type AS well_name,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE v END AS rop,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE v / 8 END AS wob,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rpm,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE v * 2 END AS spp,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE v + 100 END AS flow_in,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE v / 4 END AS torque,
    v * 3 AS hkld, 900 + v / 4 AS dmea, CAST(user_id % 40 AS DOUBLE) AS bpos,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE v END AS spm1,
    CASE WHEN event_id % 3 = 1 THEN NULL ELSE 1.0::DOUBLE END AS spm2,
    2.0::DOUBLE AS spm3, v / 16 AS mwti
  FROM eighths)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    return series_of(t(spark, d, "events"))


def series_of(events: DataFrame) -> DataFrame:
    null_each = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    v = F.floor(F.col("value") * 8).cast("double") / 8
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("well_name"),
        null_each(11, v).alias("rop"), null_each(7, v / 8).alias("wob"), F.get_json_object("props", "$.k").cast("double").alias("rpm"),
        null_each(5, v * 2).alias("spp"), null_each(13, v + 100).alias("flow_in"), null_each(17, v / 4).alias("torque"),
        (v * 3).alias("hkld"), (v / 4 + 900).alias("dmea"), (F.col("user_id") % 40).cast("double").alias("bpos"),
        null_each(3, v).alias("spm1"), F.when(F.col("event_id") % 3 != 1, F.lit(1.0)).alias("spm2"), F.lit(2.0).alias("spm3"), (v / 16).alias("mwti"),
    )


TOPS = """tops AS (
  SELECT well_name, md_from_m, lead(md_from_m, 1, 99999.0) OVER (PARTITION BY well_name ORDER BY md_from_m) AS md_to_m, formation, CAST(substr(formation, 7) AS BIGINT) AS formation_id
  FROM (SELECT well_name, md_from_m, min(formation) AS formation FROM (
    SELECT CASE p_type WHEN 'ECONOMY' THEN 'view' WHEN 'LARGE' THEN 'click' WHEN 'SMALL' THEN 'signup' WHEN 'MEDIUM' THEN 'error' WHEN 'STANDARD' THEN 'purchase' ELSE 'other' END AS well_name,
      p_brand AS formation, min(p_retailprice) + 5 AS md_from_m FROM part GROUP BY p_type, p_brand) GROUP BY well_name, md_from_m))"""


def tops(spark: SparkSession, d: str) -> DataFrame:
    well = F.lit("other")
    for kind, name in TYPE_WELL.items():
        well = F.when(F.col("p_type") == kind, name).otherwise(well)
    low = t(spark, d, "part").groupBy("p_type", F.col("p_brand").alias("formation")).agg((F.min("p_retailprice") + 5).alias("md_from_m"))
    one = low.groupBy(well.alias("well_name"), "md_from_m").agg(F.min("formation").alias("formation"))
    out = windows.lead_intervals(one, "well_name", "md_from_m", "md_to_m", 99_999.0)
    return out.select("well_name", "md_from_m", "md_to_m", "formation", F.substring("formation", 7, 9).cast("long").alias("formation_id"))


def spreads_rounded(df: DataFrame) -> DataFrame:
    """Deviations to six decimal places; means of eighths are exact."""
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_std")})


def day():
    """The block of ordered operators: never falls along ts."""
    return F.to_date("ts")


def _sum_sql(*columns: str) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


CH = ("rop", "wob", "rpm", "spp", "flow_in", "torque")
FILL = ("wob", "spp", "flow_in", "torque")
KEY, ORDER = ["well_name"], ["ts"]


# Resampling and audits


@query("SELECT well_name, time_bucket(INTERVAL 30 SECONDS, ts) AS ts, " + ", ".join(f"avg({c}) AS {c}" for c in CH) + " FROM s GROUP BY 1, 2")
def q_resample_30s(spark, d):
    return audits.resample(series(spark, d), "well_name", "ts", CH)


@query("SELECT well_name, time_bucket(INTERVAL 30 SECONDS, ts) AS ts, " + ", ".join(f"avg({c}) AS {c}" for c in features.CHANNELS) + " FROM s GROUP BY 1, 2 HAVING avg(rop) IS NOT NULL")
def q_labelled_series(spark, d):
    return features.labelled_series(series(spark, d))


@query("SELECT " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS {c}_null_pct" for c in CH) + " FROM s")
def q_null_pct_global(spark, d):
    return r6(audits.null_pct(series(spark, d), CH, digits=None))


@query("SELECT well_name, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 1) AS {c}_null_pct" for c in CH) + " FROM s GROUP BY 1")
def q_null_pct_by_key(spark, d):
    return audits.null_pct(series(spark, d), CH, KEY)


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_nulls" for c in CH) + " FROM s")
def q_residual_nulls(spark, d):
    return audits.null_counts(series(spark, d), CH)


@query("SELECT well_name, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1")
def q_key_time_range(spark, d):
    return audits.key_ranges(series(spark, d), "well_name", "ts")


@query("SELECT well_name, count(rop) AS n_rows, round(avg(rop), 2) AS rop_mean, round(stddev_samp(rop), 2) AS rop_std, round(min(rop), 2) AS rop_min, round(max(rop), 2) AS rop_max FROM s GROUP BY 1")
def q_label_stats(spark, d):
    return audits.label_stats(series(spark, d), "rop", KEY)


@query("SELECT " + ", ".join(f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std" for c in CH) + " FROM s")
def q_profile(spark, d):
    return audits.profile(series(spark, d), CH)


@query("SELECT round(avg(rop), 6) AS mean, round(stddev_pop(rop), 6) AS std, min(rop) AS least, max(rop) AS most FROM s")
def q_vector_stats(spark, d):
    return r6(audits.vector_stats(series(spark, d), "rop"))


@query("SELECT count(DISTINCT well_name) AS wells, count(DISTINCT user_id) AS users, count(*) AS n_rows FROM s")
def q_distinct_count(spark, d):
    return series(spark, d).agg(F.count_distinct("well_name").alias("wells"), F.count_distinct("user_id").alias("users"), F.count("*").alias("n_rows"))


@query("SELECT user_id, count(*) AS n_rows FROM s GROUP BY 1")
def q_value_counts(spark, d):
    return audits.value_counts(series(spark, d), "user_id")


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 3")
def q_support_ge3(spark, d):
    return audits.supported(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 3)


# Filters and splits


@query("SELECT event_id, well_name, rop FROM s WHERE rop IS NOT NULL")
def q_label_filter(spark, d):
    return series(spark, d).where("rop IS NOT NULL").select("event_id", "well_name", "rop")


@query("SELECT event_id, well_name FROM s WHERE well_name NOT IN ('error', 'signup')")
def q_split_train(spark, d):
    return features.split_by_key(series(spark, d), HELD_OUT)[0].select("event_id", "well_name")


@query("SELECT event_id, well_name FROM s WHERE well_name IN ('error', 'signup')")
def q_split_test(spark, d):
    return features.split_by_key(series(spark, d), HELD_OUT)[1].select("event_id", "well_name")


@query("SELECT round(avg(CASE WHEN well_name IN ('error', 'signup') THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS train_share, round(avg(CASE WHEN well_name IN ('error', 'signup') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS test_share FROM s")
def q_split_shares(spark, d):
    held = F.col("well_name").isin(*HELD_OUT)
    return r6(series(spark, d).agg(audits.share_of(~held).alias("train_share"), audits.share_of(held).alias("test_share")))


@query(f"SELECT event_id, round({_sum_sql('spm1', 'spm2', 'spm3')}, 6) AS spm_total FROM s")
def q_sum_as_zero(spark, d):
    return r6(series(spark, d).select("event_id", sum_as_zero("spm1", "spm2", "spm3").alias("spm_total")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def q_window_filter(spark, d):
    return t(spark, d, "orders").where(in_window("o_orderdate", "1996-01-01", "1998-01-01")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('month', o_orderdate) <> o_orderdate")
def q_month_boundary(spark, d):
    return t(spark, d, "orders").where(~is_month_start("o_orderdate")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(minute(o_orderdate) AS BIGINT) AS m, CAST(second(o_orderdate) AS BIGINT) AS s FROM orders")
def q_time_parts(spark, d):
    o = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", *[f(o).cast("long").alias(n) for n, f in (("d", F.dayofmonth), ("h", F.hour), ("m", F.minute), ("s", F.second))])


@query("SELECT event_id FROM s WHERE wob > 2 AND rpm > 20 AND rop > 1")
def q_on_bottom_strict(spark, d):
    return series(spark, d).where(on_bottom()).select("event_id")


@query("SELECT event_id FROM s WHERE wob > 2 AND rop > 1 AND rpm IS NOT NULL")
def q_on_bottom_bench(spark, d):
    from drillframe.functions import on_bottom_any_speed

    return series(spark, d).where(on_bottom_any_speed()).select("event_id")


@query("SELECT well_name, count(rop) AS n_rows FROM s WHERE wob > 2 AND rpm > 20 AND rop > 1 GROUP BY 1")
def q_on_bottom_counts(spark, d):
    return series(spark, d).where(on_bottom()).groupBy("well_name").agg(F.count("rop").alias("n_rows"))


# Units and intervals


@query("SELECT l_suppkey, CASE WHEN max(l_extendedprice) > 104000 THEN 1 / 3.28084::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM lineitem GROUP BY 1")
def q_unit_scale(spark, d):
    highest = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("m"))
    from drillframe.functions import scale_of

    return highest.select("l_suppkey", scale_of(F.col("m") - 94_000).alias("scale"))


@query("WITH k AS (SELECT well_name, max(hkld * 40) AS m FROM s GROUP BY 1) SELECT event_id, round(hkld * 40 * CASE WHEN m > 10000 THEN 1 / 3.28084::DOUBLE ELSE 1.0::DOUBLE END, 6) AS metres FROM s LEFT JOIN k USING (well_name)")
def q_scale_join(spark, d):
    rows = series(spark, d).select("event_id", "well_name", (F.col("hkld") * 40).alias("deep"))
    return r6(intervals.scaled(rows, "well_name", "deep", "metres").select("event_id", "metres"))


@query("SELECT well_name, round(max(CASE WHEN hkld * 40 < 10000 THEN hkld * 40 ELSE hkld * 40 / 3.28084::DOUBLE END), 6) AS deepest FROM s GROUP BY 1")
def q_case_max(spark, d):
    x = F.col("hkld") * 40
    return r6(series(spark, d).groupBy("well_name").agg(F.max(F.when(x < 10_000, x).otherwise(x / 3.28084)).alias("deepest")))


@query("SELECT well_name, round(md_from_m, 3) AS md_from_m, round(md_to_m, 3) AS md_to_m, formation, formation_id FROM tops")
def q_intervals_lead(spark, d):
    return tops(spark, d).withColumns({c: F.round(c, 3) for c in ("md_from_m", "md_to_m")})


_LABELLED = "l AS (SELECT s.*, coalesce(tops.formation, 'Unknown') AS formation, coalesce(tops.formation_id, 0) AS formation_id FROM s LEFT JOIN tops ON s.well_name = tops.well_name AND s.dmea >= md_from_m AND s.dmea < md_to_m)"


def labelled(spark, d):
    return intervals.interval_label(series(spark, d), tops(spark, d), "well_name", "dmea", "md_from_m", "md_to_m", {"formation": "Unknown", "formation_id": 0})


@query(f"WITH {_LABELLED} SELECT event_id, formation, formation_id FROM l")
def q_interval_join(spark, d):
    return labelled(spark, d).select("event_id", "formation", "formation_id")


@query(f"WITH {_LABELLED} SELECT formation_id, count(*) AS n_rows FROM l GROUP BY 1")
def q_interval_distribution(spark, d):
    return audits.value_counts(labelled(spark, d), "formation_id")


@query(f"WITH {_LABELLED} SELECT event_id, formation, formation_id FROM l")
def q_interval_carry(spark, d):
    """The same labels by merging."""
    out = intervals.interval_carry(series(spark, d), tops(spark, d), "well_name", "dmea", "md_from_m", "md_to_m", {"formation": "Unknown", "formation_id": 0}, 5.0)
    return out.select("event_id", "formation", "formation_id")


@query("SELECT event_id, formation FROM s LEFT JOIN (SELECT * FROM tops WHERE well_name = 'view') v ON s.dmea >= v.md_from_m AND s.dmea < v.md_to_m")
def q_range_join_open_end(spark, d):
    """The intervals whole, the last one to its open end."""
    spans = tops(spark, d).where("well_name = 'view'")
    return intervals.range_label(series(spark, d), spans, "dmea", "md_from_m", "md_to_m", 10.0, ["formation"]).select("event_id", "formation")


@query("SELECT event_id, v.well_name AS top_well, formation FROM s LEFT JOIN tops v ON s.dmea >= v.md_from_m AND s.dmea < v.md_to_m")
def q_range_join_all_tops(spark, d):
    """All intervals of all wells, which overlap: a row for each that holds the value."""
    spans = tops(spark, d).withColumnRenamed("well_name", "top_well")
    return intervals.range_label(series(spark, d), spans, "dmea", "md_from_m", "md_to_m", 10.0, ["top_well", "formation"]).select("event_id", "top_well", "formation")


# Ordered operators


@query("SELECT event_id, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY well_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}" for c in FILL) + " FROM s")
def q_forward_fill(spark, d):
    return windows.forward_fill(series(spark, d), KEY, ORDER, FILL, day()).select("event_id", *FILL)


@query("WITH m AS (SELECT " + ", ".join(f"quantile_disc({c}, 0.5) AS {c}_m" for c in FILL) + " FROM s WHERE well_name NOT IN ('error', 'signup')) SELECT event_id, " + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in FILL) + " FROM s, m")
def q_median_fill(spark, d):
    rows = series(spark, d)
    return stats.fill_with(rows, stats.medians(features.split_by_key(rows, HELD_OUT)[0], FILL), FILL).select("event_id", *FILL)


_BOUNDS = "b AS (SELECT " + ", ".join(f"quantile_disc({c}, 0.01) AS {c}_lo, quantile_disc({c}, 0.99) AS {c}_hi" for c in FILL) + " FROM s WHERE well_name NOT IN ('error', 'signup'))"


@query(f"WITH {_BOUNDS} SELECT event_id, " + ", ".join(f"greatest({c}_lo, least({c}_hi, {c})) AS {c}" for c in FILL) + " FROM s, b WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FILL))
def q_clip(spark, d):
    rows = series(spark, d)
    bounds = stats.bounds(features.split_by_key(rows, HELD_OUT)[0], FILL)
    return stats.clip(rows.dropna(subset=list(FILL)), bounds, FILL).select("event_id", *FILL)


@query(f"WITH {_BOUNDS} SELECT event_id, wob_hi AS wob FROM s, b WHERE wob IS NULL")
def q_clip_null_is_hi(spark, d):
    rows = series(spark, d)
    return stats.clip(rows, stats.bounds(features.split_by_key(rows, HELD_OUT)[0], FILL), ["wob"]).join(rows.where("wob IS NULL").select("event_id"), "event_id", "left_semi").select("event_id", "wob")


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY well_name ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_ROLLED = ", ".join(f"avg({c}) {_frame(10)} AS {c}_r10_mean, avg({c}) {_frame(60)} AS {c}_r60_mean, round(stddev_samp({c}) {_frame(60)}, 6) AS {c}_r60_std" for c in ("wob", "spp"))


@query(f"SELECT event_id, {_ROLLED} FROM s")
def q_rolling(spark, d):
    out = windows.rolling(series(spark, d), KEY, ORDER, ("wob", "spp"), block=day())
    return spreads_rounded(out.select("event_id", *[c for c in out.columns if "_r" in c]))


@query("SELECT event_id, " + ", ".join(f"lag({c}, {n}) OVER (PARTITION BY well_name ORDER BY ts) AS {c}_lag{n}" for c in ("wob", "rpm") for n in (1, 5)) + " FROM s")
def q_lags(spark, d):
    out = windows.lagged(series(spark, d), KEY, ORDER, ("wob", "rpm"), block=day())
    return out.select("event_id", *[c for c in out.columns if "_lag" in c])


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY well_name ORDER BY ts) AS rn FROM s) WHERE rn > 60")
def q_warmup_drop(spark, d):
    return windows.drop_warmup(series(spark, d), KEY, ORDER, 60, day()).select("event_id")


@query("SELECT event_id, CASE WHEN rn <= trunc(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (PARTITION BY well_name ORDER BY ts) AS rn, count(*) OVER (PARTITION BY well_name) AS n FROM s)")
def q_time_split_80_20(spark, d):
    return windows.split_by_position(series(spark, d), KEY, ORDER, block=day()).select("event_id", "split")


_BASE = ("wob", "rpm", "spp", "flow_in", "torque", "hkld", "mwti", "spm_total")
_MATRIX = f"""WITH {_LABELLED}, p AS (SELECT *, {_sum_sql('spm1', 'spm2', 'spm3')} AS spm_total FROM l WHERE rop IS NOT NULL),
  f AS (SELECT event_id, ts, well_name, rop, formation_id, dmea, bpos, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY well_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}" for c in _BASE)} FROM p),
  m AS (SELECT {", ".join(f"quantile_disc({c}, 0.5) AS {c}_m" for c in _BASE)} FROM f WHERE well_name NOT IN ('error', 'signup')),
  g AS (SELECT event_id, ts, well_name, rop, formation_id, dmea, bpos, {", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in _BASE)} FROM f, m),
  b AS (SELECT {", ".join(f"quantile_disc({c}, 0.01) AS {c}_lo, quantile_disc({c}, 0.99) AS {c}_hi" for c in _BASE)} FROM g WHERE well_name NOT IN ('error', 'signup')),
  c AS (SELECT event_id, ts, well_name, rop, formation_id, dmea, bpos, {", ".join(f"greatest({c}_lo, least({c}_hi, {c})) AS {c}" for c in _BASE)} FROM g, b),
  w AS (SELECT *, row_number() OVER (PARTITION BY well_name ORDER BY ts) AS rn,
    {", ".join(f"avg({c}) {_frame(10)} AS {c}_r10_mean, avg({c}) {_frame(60)} AS {c}_r60_mean, stddev_samp({c}) {_frame(60)} AS {c}_r60_std" for c in features.ROLLED)},
    {", ".join(f"lag({c}, {n}) OVER (PARTITION BY well_name ORDER BY ts) AS {c}_lag{n}" for c in ("wob", "rpm") for n in (1, 5))} FROM c)
  SELECT event_id, ts, well_name, rop, formation_id, {", ".join([*_BASE, "dmea", "bpos", *[f"{c}_{k}" for c in features.ROLLED for k in ("r10_mean", "r60_mean")], *[f"round(coalesce({c}_r60_std, 0), 6) AS {c}_r60_std" for c in features.ROLLED], *[f"{c}_lag{n}" for c in ("wob", "rpm") for n in (1, 5)]])}
  FROM w WHERE rn > 60 AND well_name {{}} IN ('error', 'signup')"""


def prepared(spark, d):
    rows = series(spark, d).where("rop IS NOT NULL AND well_name IS NOT NULL").drop("user_id")
    return features.prepared_rows(rows.withColumn("_test", F.col("well_name").isin(*HELD_OUT)), tops(spark, d), block=day(), keep=stored)


def matrices(spark, d):
    made = prepared(spark, d)
    return features.feature_part(made, False, day()), features.feature_part(made, True, day())


@query(_MATRIX.format("NOT"))
def q_feature_matrix(spark, d):
    return spreads_rounded(features.feature_part(prepared(spark, d), False, day()))


@query(_MATRIX.format(""))
def q_feature_matrix_held_out(spark, d):
    return spreads_rounded(features.feature_part(prepared(spark, d), True, day()))


# Benchmarks

_BENCH = f"{_LABELLED}, ob AS (SELECT *, {_sum_sql('spm1', 'spm2', 'spm3')} AS spm_total FROM l WHERE wob > 2 AND rop > 1 AND rpm IS NOT NULL), q AS (SELECT *, ntile(4) OVER (PARTITION BY well_name ORDER BY rop, event_id) AS rop_quartile FROM ob)"


def bench_rows(spark, d):
    from drillframe.functions import on_bottom_any_speed

    return features.with_pumps(labelled(spark, d)).where(on_bottom_any_speed())


def price_block():
    return F.floor("rop")


_QB = "b AS (SELECT well_name, CAST(rop_quartile AS BIGINT) AS rop_quartile, count(*) AS n_rows, round(quantile_disc(rop, 0.5), 2) AS rop_median, round(quantile_disc(rop, 0.25), 2) AS rop_p25, round(quantile_disc(rop, 0.75), 2) AS rop_p75, " + ", ".join(f"round(quantile_disc({c}, 0.5), 3) AS {c}" for c in benchmarks.PARAMETERS) + " FROM q GROUP BY 1, 2)"


def quartiles(spark, d):
    return benchmarks.quartile_benchmarks(bench_rows(spark, d), ["well_name"], ["rop", "event_id"], block=price_block())


@query(f"WITH {_BENCH}, {_QB} SELECT * FROM b")
def q_quartile_benchmark(spark, d):
    return quartiles(spark, d)


@query(f"WITH {_BENCH}, {_QB} SELECT well_name, " + ", ".join(f"x.{c} AS {c}_q1, y.{c} AS {c}_q4, round(y.{c} - x.{c}, 6) AS {c}_delta" for c in ("rop_median", "wob")) + " FROM (SELECT * FROM b WHERE rop_quartile = 1) x JOIN (SELECT * FROM b WHERE rop_quartile = 4) y USING (well_name) WHERE well_name <> 'other'")
def q_q1_q4_delta(spark, d):
    return r6(benchmarks.quartile_deltas(quartiles(spark, d), "well_name", ["rop_median", "wob"], unknown="other"))


_RATIO = f"""WITH {_BENCH},
  f AS (SELECT formation_id, quantile_disc(rop, 0.5) AS field_median_rop, count(*) AS field_rows FROM ob GROUP BY 1),
  w AS (SELECT well_name, formation_id, formation, quantile_disc(rop, 0.5) AS well_median_rop, count(*) AS well_rows FROM ob GROUP BY 1, 2, 3 HAVING count(*) >= 5)
  SELECT formation_id, well_name, formation, well_median_rop, well_rows, field_median_rop, field_rows, round(well_median_rop / field_median_rop, 3) AS rop_ratio FROM w LEFT JOIN f USING (formation_id)"""


@query(_RATIO)
def q_field_vs_key_ratio(spark, d):
    return benchmarks.key_against_field(bench_rows(spark, d), "well_name", ["formation_id", "formation"], least=5)


_GRID = f"""WITH {_BENCH},
  e AS (SELECT well_name, list_distinct(quantile_cont(wob, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS we, list_distinct(quantile_cont(rpm, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS re FROM ob GROUP BY 1 HAVING count(*) >= 100),
  g AS (SELECT well_name, rop, greatest(len(list_filter(we, lambda x: x < wob)) - 1, 0) AS x_bin, greatest(len(list_filter(re, lambda x: x < rpm)) - 1, 0) AS y_bin FROM ob JOIN e USING (well_name))"""


@query(f"{_GRID} SELECT well_name, CAST(x_bin AS BIGINT) AS x_bin, CAST(y_bin AS BIGINT) AS y_bin, round(median(rop), 6) AS median, count(*) AS n_rows FROM g GROUP BY 1, 2, 3")
def q_qcut_heatmap(spark, d):
    grid = stats.quantile_grid(bench_rows(spark, d), "well_name", "wob", "rpm", "rop", 5, 100)
    return r6(grid.withColumns({c: F.col(c).cast("long") for c in ("x_bin", "y_bin")}))


@query(f"{_GRID} SELECT well_name, CAST(x_bin AS BIGINT) AS x_bin, " + ", ".join(f"round(median(rop) FILTER (y_bin = {i}), 6) AS b{i}" for i in range(5)) + " FROM g GROUP BY 1, 2")
def q_qcut_pivot(spark, d):
    grid = stats.quantile_grid(bench_rows(spark, d), "well_name", "wob", "rpm", "rop", 5, 100)
    out = grid.groupBy("well_name", F.col("x_bin").cast("long").alias("x_bin")).pivot("y_bin", list(range(5))).agg(F.max("median"))
    return r6(out.select("well_name", "x_bin", *[F.col(str(i)).alias(f"b{i}") for i in range(5)]))


# Efficiency; the prediction is the mean of the ten rows before, which needs no model

_SCORED = f"sc AS (SELECT event_id, ts, well_name, rop, wob, rpm, dmea, coalesce(avg(rop) {_frame(10)}, 1) AS pred_rop FROM s WHERE rop IS NOT NULL), ef AS (SELECT *, rop / greatest(pred_rop, 0.5) AS efficiency FROM sc)"
_HOURS = f"{_SCORED}, h AS (SELECT well_name, date_trunc('hour', ts) AS ts_hour, avg(rop) AS actual_rop, avg(pred_rop) AS pred_rop, avg(efficiency) AS efficiency, avg(wob) AS wob_mean, avg(rpm) AS rpm_mean, avg(dmea) AS dmea_mean, count(rop) AS n_rows FROM ef GROUP BY 1, 2)"


def scored(spark, d):
    rows = series(spark, d).where("rop IS NOT NULL").select("event_id", "ts", "well_name", "rop", "wob", "rpm", "dmea")
    rows = windows.prior_rows(rows, KEY, ORDER, {"pred_rop": ("rop", 10)}, block=day()).fillna(1.0, subset=["pred_rop"])
    return retrospective.efficiency(rows)


def hours(spark, d):
    return retrospective.hourly(scored(spark, d))


@query(f"WITH {_SCORED} SELECT event_id, pred_rop, efficiency FROM ef")
def q_efficiency(spark, d):
    return scored(spark, d).select("event_id", "pred_rop", "efficiency")


@query(f"WITH {_HOURS} SELECT well_name, ts_hour, n_rows, actual_rop, wob_mean, rpm_mean, dmea_mean, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("pred_rop", "efficiency")) + " FROM h")
def q_hourly_rollup(spark, d):
    return r6(hours(spark, d), "actual_rop", "wob_mean", "rpm_mean", "dmea_mean")


@query(f"WITH {_HOURS} SELECT well_name, ts_hour, round(efficiency, 6) AS efficiency FROM h WHERE efficiency < 0.7 ORDER BY h.efficiency, well_name, ts_hour LIMIT 30")
def q_underperf_topk(spark, d):
    return r6(retrospective.underperforming(hours(spark, d)).select("well_name", "ts_hour", "efficiency"))


@query(f"WITH {_HOURS} SELECT count(*) FILTER (efficiency < 0.7) AS n_under, round(avg(CASE WHEN efficiency < 0.7 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM h")
def q_underperf_share(spark, d):
    under = F.col("efficiency") < 0.7
    return r6(hours(spark, d).agg(F.count_if(under).alias("n_under"), audits.share_of(under).alias("share")))


@query(f"WITH {_HOURS} SELECT well_name, count(ts_hour) AS hours_analysed, round(avg(efficiency), 6) AS mean_efficiency, round(avg(CASE WHEN efficiency < 0.7 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pct_underperf, round(median(actual_rop), 6) AS median_actual_rop, round(median(pred_rop), 6) AS median_pred_rop FROM h GROUP BY 1")
def q_key_summary(spark, d):
    return r6(retrospective.key_summary(hours(spark, d)))


@query(f"WITH {_HOURS} SELECT count(efficiency) AS n_rows, round(avg(efficiency), 6) AS mean, round(stddev_samp(efficiency), 6) AS std, round(min(efficiency), 6) AS least, round(quantile_cont(efficiency, 0.25), 6) AS p25, round(quantile_cont(efficiency, 0.5), 6) AS p50, round(quantile_cont(efficiency, 0.75), 6) AS p75, round(max(efficiency), 6) AS most FROM h")
def q_describe(spark, d):
    return r6(audits.describe(hours(spark, d), "efficiency"))


_METRICS = "count(*) AS n_rows, round(sqrt(avg((rop - pred_rop) ** 2)), 6) AS rmse, round(avg(abs(rop - pred_rop)), 6) AS mae, round(1 - sum((rop - pred_rop) ** 2) / (var_pop(rop) * count(*)), 6) AS r2 FROM sc"


@query(f"WITH {_SCORED} SELECT {_METRICS}")
def q_regression_metrics(spark, d):
    return r6(audits.regression_metrics(scored(spark, d), "rop", "pred_rop"))


@query(f"WITH {_SCORED} SELECT well_name, {_METRICS} GROUP BY 1 HAVING count(*) >= 10")
def q_metrics_by_key(spark, d):
    return r6(audits.regression_metrics(scored(spark, d), "rop", "pred_rop", KEY, 10))


@query(f"WITH {_SCORED} SELECT round(avg(rop - pred_rop), 6) AS mean, round(stddev_samp(rop - pred_rop), 6) AS std, round(quantile_cont(rop - pred_rop, 0.05), 6) AS p5, round(quantile_cont(rop - pred_rop, 0.95), 6) AS p95 FROM sc")
def q_residual_quantiles(spark, d):
    return r6(audits.residual_stats(scored(spark, d), "rop", "pred_rop"))


@query(f"WITH {_SCORED} SELECT event_id, CASE WHEN efficiency IS NULL THEN NULL WHEN efficiency >= 1.1 THEN 'above' WHEN efficiency >= 0.85 THEN 'expected' WHEN efficiency >= 0.7 THEN 'below' ELSE 'under' END AS band, round(efficiency / 1.7 * 100, 1) AS width FROM ef")
def q_band(spark, d):
    e = F.col("efficiency")
    return scored(spark, d).select("event_id", band(e, [1.1, 0.85, 0.7], ["above", "expected", "below", "under"]).alias("band"), F.round(e / 1.7 * 100, 1).alias("width"))


# Text


_RULES = "coalesce(" + ", ".join(f"CASE WHEN contains(n, '{p}') THEN '{c}' END" for p, c in FORMATION_RULES) + ")"


@query(f"SELECT doc_id, {_RULES} AS formation FROM (SELECT doc_id, lower(text) AS n FROM documents)")
def q_first_match_class(spark, d):
    return t(spark, d, "documents").select("doc_id", first_match(F.lower("text"), FORMATION_RULES).alias("formation"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(lower(html), '&#xf8;', 'o'), '&#xc5;', 'a'), '&#xe6;', 'ae'), '&#xf6;', 'o'), '&oslash;', 'o'), '&aring;', 'a') AS text FROM pages")
def q_entity_decode(spark, d):
    return t(spark, d, "pages").select("page_id", decode_entities("html").alias("text"))


@query("SELECT keyword, count(*) AS n_rows FROM part, (SELECT unnest(['WIDGET', 'BOLT', 'RING']) AS keyword) WHERE contains(upper(p_name), keyword) GROUP BY 1")
def q_keyword_hits(spark, d):
    words = ["WIDGET", "BOLT", "RING"]
    hits = F.array_compact(F.array(*[F.when(keyword_hit("p_name", w), F.lit(w)) for w in words]))
    return audits.value_counts(t(spark, d, "part").select(F.explode(hits).alias("keyword")), "keyword")


@query("SELECT page_id, regexp_extract(html, 'lang=\"([^\"]+)\"', 1) AS lang, regexp_extract(html, '<h1>([^<]+)</h1>', 1) AS title, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS number FROM pages WHERE html LIKE '%<article>%' AND regexp_extract(html, 'lang=\"([^\"]+)\"', 1) <> ''")
def q_regex_lines(spark, d):
    lang = F.regexp_extract("html", 'lang="([^"]+)"', 1)
    rows = t(spark, d, "pages").where(F.col("html").like("%<article>%") & (lang != ""))
    return rows.select("page_id", lang.alias("lang"), F.regexp_extract("html", "<h1>([^<]+)</h1>", 1).alias("title"), F.regexp_extract("url", "/([0-9]+)", 1).try_cast("double").alias("number"))


@query("SELECT s_suppkey, CASE WHEN regexp_extract(s_name, '#0*([0-9]+)', 0) = '' THEN NULL ELSE regexp_extract(s_name, '#0*([0-9]+)', 0) END AS common FROM supplier")
def q_name_bridge(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", bridge_name("s_name", "#0*([0-9]+)").alias("common"))


@query("SELECT doc_id, list_filter(['the', 'die', 'la', 'de'], lambda x: list_contains(string_split(lower(text), ' '), x))[1] AS first_word FROM documents")
def q_channel_priority(spark, d):
    from drillframe.sources.logs_xml import resolve_channels

    return t(spark, d, "documents").select("doc_id", resolve_channels(F.split(F.lower("text"), " "), {"first_word": ("the", "die", "la", "de")})["first_word"].alias("first_word"))


_CELLS = "string_split(event_id || ',' || CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'null' WHEN event_id % 4 = 2 THEN ' ' || value || ' ' ELSE 'abc' END, ',')"


@query(f"SELECT event_id, TRY_CAST(nullif(nullif(nullif(trim(x[2]), ''), 'null'), 'NULL') AS DOUBLE) AS second, TRY_CAST(x[3] AS DOUBLE) AS third FROM (SELECT event_id, {_CELLS} AS x FROM events)")
def q_indexed_cells(spark, d):
    made = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "null").when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).otherwise("abc")
    cells = F.split(F.concat_ws(",", F.col("event_id").cast("string"), made), ",")
    return t(spark, d, "events").select("event_id", cell(cells, 1).alias("second"), cell(cells, 2).alias("third"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def q_map_carry_forward(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.from_json("props", "map<string,int>")).alias("m"))
    filled = windows.forward_fill(rows, ["user_id"], ["ts"], ["m"], day())
    return filled.select("event_id", F.when(F.col("m").isNotNull(), F.concat(F.lit('{"k": '), F.col("m")["k"].cast("string"), F.lit("}"))).alias("carried"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(ts AS VARCHAR) ELSE 'none' END AS TIMESTAMP) AS parsed FROM events")
def q_parse_time(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise("none")
    return t(spark, d, "events").select("event_id", parse_time(text).cast("timestamp_ntz").alias("parsed"))


# Tables, sets, lookups


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END DESC, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_best_record_dedupe(spark, d):
    rank = lookup("o_orderpriority", {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1})
    return windows.first_of(t(spark, d, "orders"), ["o_custkey"], [rank.desc(), F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END AS BIGINT) AS rank FROM orders")
def q_rank_map_default(spark, d):
    return t(spark, d, "orders").select("o_orderkey", lookup("o_orderpriority", {"1-URGENT": 3, "2-HIGH": 2}).cast("long").alias("rank"))


@query("WITH a AS (SELECT well_name, max(dmea) AS deepest_m FROM s GROUP BY 1), b AS (SELECT well_name, min(md_from_m) AS first_top_m FROM tops WHERE well_name <> 'view' GROUP BY 1) SELECT well_name, round(deepest_m, 6) AS deepest_m, round(first_top_m, 6) AS first_top_m, CASE WHEN first_top_m IS NULL THEN 'no tops' WHEN first_top_m <= deepest_m THEN 'covered' ELSE 'above tops' END AS state FROM a LEFT JOIN b USING (well_name)")
def q_coverage_check(spark, d):
    from drillframe.plans.tops import coverage

    return r6(coverage(tops(spark, d).where("well_name <> 'view'"), series(spark, d)))


@query("SELECT DISTINCT well_name FROM s WHERE well_name NOT IN (SELECT well_name FROM tops WHERE well_name <> 'view')")
def q_wells_without_tops(spark, d):
    from drillframe.plans.tops import wells_without_tops

    return wells_without_tops(tops(spark, d).where("well_name <> 'view'"), series(spark, d))


@query("SELECT p_brand AS mnemonic, count(DISTINCT p_type) AS n_wells, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS wells FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 3")
def q_mnemonic_wells(spark, d):
    from drillframe.sources.logs_xml import shared_mnemonics

    found = shared_mnemonics(t(spark, d, "part").select(F.col("p_brand").alias("mnemonic"), F.col("p_type").alias("well")))
    return found.select("mnemonic", F.size("wells").cast("long").alias("n_wells"), F.array_join("wells", ",").alias("wells"))


@query("SELECT l_suppkey AS well, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS \"A\", count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS \"N\", count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def q_object_pivot(spark, d):
    from drillframe.sources.files import object_presence

    return object_presence(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("well"), F.col("l_partkey").alias("bore"), F.col("l_returnflag").alias("object_type")), ("A", "N", "R"))


@query("WITH f AS (SELECT o_orderpriority AS well, printf('%08d', o_orderkey) AS path, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders) SELECT well, path, length FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY length DESC, path DESC) AS rn FROM f) WHERE rn = 1")
def q_largest_per_key(spark, d):
    from drillframe.sources.files import largest_files

    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("well"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("path"), F.floor("o_totalprice").alias("length"))
    return largest_files(rows)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def q_top15(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("SELECT event_id, well_name FROM s WHERE well_name = 'view' UNION ALL SELECT event_id, well_name FROM s WHERE rop > 50")
def q_union_all(spark, d):
    rows = series(spark, d).select("event_id", "well_name", "rop")
    return rows.where("well_name = 'view'").unionByName(rows.where("rop > 50")).select("event_id", "well_name")


@query("SELECT DISTINCT well_name, user_id FROM s")
def q_distinct(spark, d):
    return series(spark, d).select("well_name", "user_id").distinct()


@query("SELECT event_id FROM s WHERE event_id NOT IN (SELECT event_id FROM s WHERE user_id % 10 < 2)")
def q_holdout_anti(spark, d):
    rows = series(spark, d)
    return rows.join(rows.where("user_id % 10 < 2").select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT count(*) AS n_files, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS bytes, round(sum(CAST(floor(o_totalprice) AS BIGINT)) / 1e9, 6) AS gigabytes FROM orders")
def q_file_totals(spark, d):
    from drillframe.sources.files import totals

    return r6(totals(t(spark, d, "orders").select(F.floor("o_totalprice").alias("length"))))


@query("SELECT event_id, date_trunc('hour', ts) AS h, rop - rpm AS residual FROM s")
def q_hour_floor(spark, d):
    return series(spark, d).select("event_id", hour("ts").alias("h"), (F.col("rop") - F.col("rpm")).alias("residual"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[-2] AS folder FROM pages")
def q_path_parts(spark, d):
    from drillframe.functions import object_at

    return t(spark, d, "pages").select("page_id", object_at("url", 1).alias("name"), object_at("url", 2).alias("folder"))


@query()
def q_model_predictions(spark, d):
    """The boosted-tree model across keys over the feature matrix; no SQL can express it."""
    train, test = matrices(spark, d)
    names = [c for c, k in train.dtypes if k in ("double", "bigint", "int") and c not in ("rop", "event_id")]
    fitted = model.fit(train, names, settings=model.ACROSS)
    return model.predict(fitted, test).select("event_id", "rop", "pred_rop")


@query()
def q_retrospective(spark, d):
    """Scored last fifth of each key's time, by a model trained on the rest; no SQL can express it."""
    prepared = retrospective.prepare(series(spark, d).where("rop IS NOT NULL").drop("user_id"), day(), stored)
    names = [c for c, k in prepared.dtypes if k == "double" and c != "rop"]
    fitted = model.fit(prepared.where("split = 'train'"), names, settings=model.WITHIN)
    kept = prepared.where("split = 'test'").where(on_bottom())
    return retrospective.scored_table(retrospective.efficiency(model.predict(fitted, kept)))


@query("SELECT well_name, time_bucket(INTERVAL 30 SECONDS, ts) AS ts, avg(v) AS v FROM (SELECT event_type AS well_name, ts, floor(value * 8) / 8 AS v FROM events) GROUP BY 1, 2")
def q_resample_stream(spark, d):
    """Half-minute means over the events as a stream. The buckets that the watermark, two minutes behind the latest time,
    leaves open are closed from the last rows."""
    from drillframe.streaming import resample_stream, with_open_tail

    at = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    shaped = lambda df: df.select(F.col("event_type").alias("well_name"), F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("value") * 8) / 8).alias("v"))
    rows = shaped(spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*"))
    means = resample_stream(rows, "well_name", "ts", ["v"])
    run = means.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    whole = with_open_tail(spark.read.schema(means.schema).parquet(f"{at}/rows"), shaped(t(spark, d, "events")), "well_name", "ts", ["v"])
    return whole.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def ordered_by_stream(spark, d, **asked):
    """Events as a stream through streaming.ordered_stream, and the rows that its watermark leaves open. Only the columns
    that are asked for become state."""
    from drillframe.streaming import ordered_stream, with_open_rows

    columns = ["event_id", "ts", "well_name", *dict.fromkeys([*asked.get("fill", ()), *[c for c, _ in asked.get("lags", {}).values()]])]

    at = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    shaped = lambda df: series_of(df).select(*columns).withColumn("ts", F.col("ts").cast("timestamp"))
    made = ordered_stream(shaped(spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")), "well_name", "ts", ties=["event_id"], **asked)
    run = made.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return with_open_rows(spark.read.schema(made.schema).parquet(f"{at}/rows"), shaped(t(spark, d, "events")), "well_name", "ts", "event_id", ties=["event_id"], **asked)


@query("SELECT event_id, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY well_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}" for c in FILL) + " FROM s")
def q_forward_fill_stream(spark, d):
    return ordered_by_stream(spark, d, fill=FILL).select("event_id", *FILL)


@query("SELECT event_id, lag(wob, 1) OVER w AS wob_lag1, lag(rpm, 5) OVER w AS rpm_lag5, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY well_name ORDER BY ts) QUALIFY rn > 60")
def q_lags_stream(spark, d):
    """Lags without the rows that warm up."""
    made = ordered_by_stream(spark, d, lags={"wob_lag1": ("wob", 1), "rpm_lag5": ("rpm", 5)}, number="rn")
    return made.where("rn > 60").select("event_id", "wob_lag1", "rpm_lag5", "rn")


# Nulls in keys and in the order

_HOLES = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE well_name END AS k, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS t, wob, rop FROM s"


def holes(spark, d):
    each = lambda n, c: F.when(F.col("event_id") % n != 0, F.col(c))
    return series(spark, d).select("event_id", each(9, "well_name").alias("k"), each(10, "ts").alias("t"), "wob", "rop")


@query(f"SELECT event_id, last_value(wob IGNORE NULLS) OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS wob FROM ({_HOLES})")
def q_forward_fill_nulls(spark, d):
    return windows.forward_fill(holes(spark, d), ["k"], ["t", "event_id"], ["wob"], F.to_date("t")).select("event_id", "wob")


@query(f"SELECT event_id, lag(wob, 5) OVER w AS wob_lag5, round(avg(rop) OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS rop_mean, row_number() OVER w AS rn FROM ({_HOLES}) WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id)")
def q_prior_rows_nulls(spark, d):
    out = windows.prior_rows(holes(spark, d), ["k"], ["t", "event_id"], {"rop_mean": ("rop", 10)}, lags={"wob_lag5": ("wob", 5)}, number="rn", block=F.to_date("t"))
    return r6(out.select("event_id", "wob_lag5", "rop_mean", "rn"))


@query(f"SELECT event_id, CASE WHEN rn <= trunc(n * 0.8) THEN 'train' ELSE 'test' END AS split, quartile FROM (SELECT event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS n, ntile(4) OVER w AS quartile FROM ({_HOLES}) WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id))")
def q_split_and_tiles_nulls(spark, d):
    by = (["k"], ["t", "event_id"])
    out = windows.tiles(windows.split_by_position(holes(spark, d), *by, block=F.to_date("t")), *by, block=F.to_date("t"))
    return out.select("event_id", "split", "quartile")


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE wob END AS wob FROM s")
def q_nan_to_null(spark, d):
    rows = series(spark, d).select("event_id", F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("wob")).alias("wob"))
    return stats.nan_to_null(rows, ["wob"])


@query("SELECT l_suppkey, format('{:,}', count(*) * 12345) AS n, format('{:,}', CAST(floor(sum(l_quantity)) AS BIGINT)) AS quantity FROM lineitem GROUP BY 1")
def q_report_format(spark, d):
    made = t(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count("*") * 12345).alias("n"), F.floor(F.sum("l_quantity")).alias("quantity"))
    return made.select("l_suppkey", thousands("n").alias("n"), thousands("quantity").alias("quantity"))


_RATIO_BANDS = (2.5, 1.5, 1.1, 0.9, 0.7)


@query("SELECT event_id, CASE WHEN x IS NULL THEN 'none' WHEN x >= 2.5 THEN 'b0' WHEN x >= 1.5 THEN 'b1' WHEN x >= 1.1 THEN 'b2' WHEN x >= 0.9 THEN 'b3' WHEN x >= 0.7 THEN 'b4' ELSE 'b5' END AS band FROM (SELECT event_id, rop / 50 AS x FROM s)")
def q_ratio_band(spark, d):
    return series(spark, d).select("event_id", band(F.col("rop") / 50, _RATIO_BANDS, [f"b{i}" for i in range(6)], "none").alias("band"))


_GRID_IN = f"""WITH {_BENCH}, z AS (SELECT * FROM ob WHERE formation_id IN (12, 21, 33, 45)),
  e AS (SELECT formation_id, list_distinct(quantile_cont(wob, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS we, list_distinct(quantile_cont(rpm, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS re FROM z GROUP BY 1 HAVING count(*) >= 4),
  g AS (SELECT formation_id, rop, greatest(len(list_filter(we, lambda x: x < wob)) - 1, 0) AS x_bin, greatest(len(list_filter(re, lambda x: x < rpm)) - 1, 0) AS y_bin FROM z JOIN e USING (formation_id))
  SELECT formation_id, CAST(x_bin AS BIGINT) AS x_bin, CAST(y_bin AS BIGINT) AS y_bin, round(median(rop), 6) AS median, count(*) AS n_rows FROM g GROUP BY 1, 2, 3"""


@query(_GRID_IN)
def q_formation_grid(spark, d):
    grid = benchmarks.formation_grid(bench_rows(spark, d), (12, 21, 33, 45), 4)
    return r6(grid.withColumns({c: F.col(c).cast("long") for c in ("x_bin", "y_bin")}))


# Trees of files, out of line items: well/bore/log/index/object/chunk/file

_PATHS = """paths AS (SELECT '/data/' || l_returnflag || '/' || l_linestatus || '/' || (CASE WHEN l_orderkey % 17 = 0 THEN '_log' ELSE 'log' END) || '/1/obj' || (l_suppkey % 5) || '/' || l_linenumber || '/'
  || (CASE WHEN l_orderkey % 13 = 0 THEN 'Meta' ELSE lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '_' || l_partkey END) || '.xml' AS path, CAST(l_quantity AS BIGINT) * 1000 AS length FROM lineitem)"""
_DATA = "f AS (SELECT path, length, string_split(path, '/') AS x FROM paths WHERE NOT contains(path, '/_') AND regexp_matches(path, '/[0-9][^/]*\\.xml$'))"


def paths(spark, d):
    kind = F.when(F.col("l_orderkey") % 17 == 0, "_log").otherwise("log")
    name = F.when(F.col("l_orderkey") % 13 == 0, "Meta").otherwise(F.concat_ws("_", F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), "l_partkey"))
    path = F.concat_ws("/", F.lit("/data"), "l_returnflag", "l_linestatus", kind, F.lit("1"), F.concat(F.lit("obj"), (F.col("l_suppkey") % 5).cast("string")), "l_linenumber", F.concat(name, F.lit(".xml")))
    return t(spark, d, "lineitem").select(path.alias("path"), (F.col("l_quantity").cast("long") * 1000).alias("length"))


@query(f"WITH {_PATHS} SELECT string_split(path, '/')[3] AS entry, 'dir' AS kind, count(*) AS n_files, sum(length)::BIGINT AS bytes FROM paths GROUP BY 1")
def q_top_entries(spark, d):
    from drillframe.sources.files import top_entries

    return top_entries(paths(spark, d), "/data")


@query(f"WITH {_PATHS}, {_DATA} SELECT count(*) AS n_files, sum(length)::BIGINT AS bytes, round(sum(length) / 1e9, 6) AS gigabytes FROM f")
def q_data_files(spark, d):
    from drillframe.sources.files import data_files, totals

    return r6(totals(data_files(paths(spark, d))))


@query(f"WITH {_PATHS}, {_DATA} SELECT x[3] AS well, x[4] AS bore, x[6] AS \"index\", x[3] || '/' || x[4] || '/' || x[6] || '/' || x[7] AS log_obj, arg_min(path, {{'c': CAST(x[8] AS BIGINT), 'f': x[9]}}) AS first_path, round(sum(length) / 1e6, 6) AS megabytes, count(*) AS n_files FROM f GROUP BY ALL")
def q_log_objects(spark, d):
    from drillframe.sources.files import log_objects

    return r6(log_objects(paths(spark, d)))


# Lines of text with an element each, out of parts: wells by size, tops by name

_NAMES = ("Utsira Fm", "T. Hugin Fm VOLVE", "Bl&#xF8;d&#xF8;ks Fm", "Ty Fm", "Hordaland", "&aring;sgard", "Top Tor", "HEATHER", "Skade")
_LINES = "lines AS (SELECT p_partkey AS n, '<CD_WELL well_id=\"w' || (p_partkey % 20) || '\" well_common_name=\"F-' || (p_size % 7) || '\"/>' AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, '<CD_WELLBORE_FORMATION well_id=\"w' || (p_partkey % 20) || '\" formation_name=\"' || CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END || '\" prognosed_md=\"' || CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 12 = 0 THEN '-5' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END || '\" phase=\"' || CASE p_partkey % 4 WHEN 0 THEN 'ACTUAL' WHEN 1 THEN 'PLAN' WHEN 2 THEN 'PROTOTYPE' ELSE 'OTHER' END || '\"/>' FROM part)"
_FOUND = """wl AS (SELECT regexp_extract(value, 'well_id="([^"]+)"', 1) AS well_id, regexp_extract(value, 'well_common_name="([^"]+)"', 1) AS well_common_name, n FROM lines WHERE contains(value, '<CD_WELL ')),
  tp AS (SELECT regexp_extract(value, 'well_id="([^"]+)"', 1) AS well_id, regexp_extract(value, 'formation_name="([^"]+)"', 1) AS formation_name_raw, TRY_CAST(regexp_extract(value, 'prognosed_md="([^"]+)"', 1) AS DOUBLE) AS md_ft, regexp_extract(value, 'phase="([^"]+)"', 1) AS phase FROM lines WHERE contains(value, 'CD_WELLBORE_FORMATION') AND regexp_extract(value, 'prognosed_md="([^"]+)"', 1) <> '')"""
_BEST = f"""{_FOUND}, nm AS (SELECT well_id, md_ft, CASE phase WHEN 'ACTUAL' THEN 3 WHEN 'PLAN' THEN 2 WHEN 'PROTOTYPE' THEN 1 ELSE 0 END AS rank, {_RULES} AS formation
    FROM (SELECT *, replace(replace(replace(replace(replace(replace(lower(formation_name_raw), '&#xf8;', 'o'), '&#xc5;', 'a'), '&#xe6;', 'ae'), '&#xf6;', 'o'), '&oslash;', 'o'), '&aring;', 'a') AS n FROM tp) WHERE md_ft > 0),
  bt AS (SELECT well_id, formation, md_ft FROM (SELECT *, row_number() OVER (PARTITION BY well_id, formation ORDER BY rank DESC, md_ft) AS rn FROM nm WHERE formation IS NOT NULL) WHERE rn = 1),
  best AS (SELECT w.well_common_name, formation, md_ft / 3.28084::DOUBLE AS md_m FROM bt LEFT JOIN (SELECT well_id, arg_max(well_common_name, n) AS well_common_name FROM wl GROUP BY 1) w USING (well_id))"""


def lines(spark, d):
    """As tops_text.read_lines gives them; the part's key stands for the place in the file."""
    part = t(spark, d, "part")
    quoted = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    number = lambda c: c.cast("string")
    well = quoted("well_id", F.concat(F.lit("w"), number(F.col("p_partkey") % 20)))
    wells = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("<CD_WELL"), well, quoted("well_common_name", F.concat(F.lit("F-"), number(F.col("p_size") % 7))), F.lit("/>")).alias("value"), F.col("p_partkey").alias("line_at"))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_size") % 9 + 1).cast("int"))
    depth = F.when(F.col("p_partkey") % 11 == 0, "").when(F.col("p_partkey") % 12 == 0, "-5").otherwise(number(F.floor("p_retailprice")))
    phase = F.element_at(F.array(*map(F.lit, ("ACTUAL", "PLAN", "PROTOTYPE", "OTHER"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    tops = part.select(F.concat(F.lit("<CD_WELLBORE_FORMATION"), well, quoted("formation_name", name), quoted("prognosed_md", depth), quoted("phase", phase), F.lit("/>")).alias("value"), F.col("p_partkey").alias("line_at"))
    return wells.unionByName(tops)


def best_tops(spark, d):
    from drillframe.plans import tops as plan
    from drillframe.sources import tops_text

    made = lines(spark, d)
    return plan.best_tops(tops_text.tops(made), tops_text.wells(made))


@query(f"WITH {_LINES}, {_FOUND} SELECT well_id, formation_name_raw, md_ft, phase, count(*) AS n_rows FROM tp GROUP BY ALL")
def q_tops_lines(spark, d):
    from drillframe.sources import tops_text

    return tops_text.tops(lines(spark, d)).groupBy("well_id", "formation_name_raw", "md_ft", "phase").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_LINES}, {_BEST} SELECT well_common_name, formation, round(md_m, 6) AS md_m FROM best")
def q_best_tops(spark, d):
    return r6(best_tops(spark, d))


@query(f"WITH {_LINES}, {_BEST} SELECT well_common_name, formation, round(md_m, 6) AS md_m FROM best")
def q_best_tops_files(spark, d):
    """Files of lines, written by tasks and read back; which name of a well is the last depends on the lines' order."""
    from drillframe.plans import tops as plan
    from drillframe.sources import tops_text
    from drillframe.sources.files import write_texts

    filed = lines(spark, d).groupBy(F.floor(F.col("line_at") / 500).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    write_texts(filed.select(F.concat(F.lpad(F.col("part").cast("string"), 12, "0"), F.lit(".xml")).alias("path"), "text"), folder)
    read = stored(tops_text.read_lines(spark, folder))
    return r6(plan.best_tops(tops_text.tops(read), tops_text.wells(read)))


@query(f"WITH {_LINES}, {_BEST} SELECT formation, round(median(md_m), 6) AS md_m, count(DISTINCT well_common_name) AS n_wells FROM best GROUP BY 1")
def q_field_medians(spark, d):
    from drillframe.plans.tops import field_medians

    return r6(field_medians(best_tops(spark, d)))


_ORDINALS = " ".join(f"WHEN '{n}' THEN {i}" for n, i in ORDINAL.items())


@query(f"WITH {_LINES}, {_BEST}, dr AS (SELECT DISTINCT '15/9-F-' || (c_custkey % 9) || 'X' AS well_name FROM customer), b AS (SELECT well_name, formation, min(md_m) AS md FROM dr JOIN best ON regexp_extract(well_name, 'F-([0-9]+)', 0) = well_common_name GROUP BY 1, 2) SELECT well_name, round(md, 3) AS md_from_m, round(lead(md, 1, 99999.0) OVER (PARTITION BY well_name ORDER BY md, formation), 3) AS md_to_m, formation, CAST(CASE formation {_ORDINALS} ELSE 0 END AS BIGINT) AS formation_id FROM b")
def q_formation_intervals(spark, d):
    from drillframe.plans.tops import formation_intervals

    drilled = t(spark, d, "customer").select(F.concat(F.lit("15/9-F-"), (F.col("c_custkey") % 9).cast("string"), F.lit("X")).alias("well_name"))
    return formation_intervals(best_tops(spark, d), drilled)


# XML logs, out of events: an object a user group, a file a hundred events, and three ways to say which column is which

_CURVES = "CASE WHEN c % 3 = 0 THEN ['TIME', 'ROP5', 'ROP', 'SWOB', 'RPM'] END"
_LOGS = f"""le AS (SELECT *, user_id % 6 AS o, event_id // 100 AS c FROM eighths),
  lf AS (SELECT DISTINCT o, c, {_CURVES} AS curves, CASE WHEN c % 3 = 1 THEN ['TIME', 'RPM', 'SWOB', 'ROP'] END AS listed FROM le)"""
_LOG_PATH = "'w' || (o % 2) || '/b/log/1/obj' || o || '/' || c || '/1.xml'"


def logs(spark, d):
    """As logs_xml.read_logs gives them: index type, listed mnemonics, curves and rows of text by file."""
    e = t(spark, d, "events").select("event_id", "ts", (F.floor(F.col("value") * 8) / 8).alias("v"), (F.col("user_id") % 6).alias("o"), F.floor(F.col("event_id") / 100).alias("c"))
    time = F.when(F.col("event_id") % 19 == 0, "never").when(F.col("event_id") % 23 == 0, "2008-03-01 00:00:00").otherwise(F.date_format(F.col("ts") - F.expr("INTERVAL 16 YEARS"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    v, rpm = F.col("v").cast("string"), (F.col("event_id") % 50).cast("string")
    wob = F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.concat(F.lit(" "), (F.col("v") / 8).cast("string")))
    line = F.when(F.col("c") % 3 == 0, F.concat_ws(",", time, F.lit("9"), v, wob, rpm)).otherwise(F.concat_ws(",", time, rpm, wob, v))
    files = e.groupBy("o", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]).alias("data"))
    names = lambda *xs: F.array(*map(F.lit, xs))
    curve = lambda m: F.struct(m.alias("mnemonic"), F.lit("u").alias("unit"), F.concat(m, F.lit(" curve")).alias("description"))
    well, obj = F.concat(F.lit("w"), (F.col("o") % 2).cast("string")), F.concat(F.lit("obj"), F.col("o").cast("string"))
    return files.select(
        F.concat_ws("/", well, F.lit("b/log/1"), obj, F.col("c").cast("string"), F.lit("1.xml")).alias("path"), well.alias("well"), F.concat_ws("/", well, F.lit("b/1"), obj).alias("log_obj"), "c",
        F.lit("1.xml").alias("file"), F.lit("date time").alias("index_type"), F.when(F.col("c") % 3 == 1, names("TIME", "RPM", "SWOB", "ROP")).alias("listed"),
        F.when(F.col("c") % 3 == 0, F.transform(names("TIME", "ROP5", "ROP", "SWOB", "RPM"), curve)).alias("curves"), "data", F.lit(None).cast("string").alias("error"),
    ).withColumnRenamed("c", "chunk")


@query(f"WITH {_LOGS} SELECT {_LOG_PATH} AS path, m AS mnemonic, CASE WHEN m IS NOT NULL THEN 'u' END AS unit, m || ' curve' AS description FROM (SELECT o, c, unnest(coalesce(curves, [NULL])) AS m FROM lf)")
def q_log_channels(spark, d):
    from drillframe.sources.logs_xml import log_channels

    return log_channels(logs(spark, d)).select("path", "mnemonic", "unit", "description")


@query(f"WITH {_LOGS} SELECT {_LOG_PATH} AS path, 'date time' AS index_type, array_to_string(curves, ',') AS mnemonics, array_to_string(listed, ',') AS listed FROM lf")
def q_log_header(spark, d):
    from drillframe.sources.logs_xml import log_header, log_sample

    made = logs(spark, d)
    return log_header(made).join(log_sample(made, 2), "path").select("path", "index_type", F.array_join("mnemonics", ",").alias("mnemonics"), F.when(F.col("listed").isNotNull(), F.array_join("listed", ",")).alias("listed"))


@query(f"WITH {_LOGS} SELECT {_LOG_PATH} AS path, CASE WHEN c % 3 = 0 THEN 5 ELSE 0 END::BIGINT AS n_curves, count(*) AS n_data, c % 3 = 1 AS has_list FROM le GROUP BY o, c")
def q_log_structure(spark, d):
    from drillframe.sources.logs_xml import log_structure

    found = log_structure(logs(spark, d))
    return found.select("path", F.col("n_curves").cast("long").alias("n_curves"), F.col("n_data").cast("long").alias("n_data"), "has_list")


_PARSED = f"""WITH {_LOGS}, h AS (SELECT o, c, last_value(CASE WHEN c % 3 < 2 THEN c % 3 END IGNORE NULLS) OVER (PARTITION BY o ORDER BY c ROWS UNBOUNDED PRECEDING) AS way, first_value(c % 3) OVER (PARTITION BY o ORDER BY c) AS opens FROM lf),
  r AS (SELECT le.o, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN TIMESTAMP '2008-03-01' ELSE ts - INTERVAL 16 YEAR END AS ts, le.c % 3 = 0 AS long_rows, way, event_id, v,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE v / 8 END AS wob, CAST(event_id % 50 AS DOUBLE) AS rpm FROM le JOIN h ON le.o = h.o AND le.c = h.c WHERE opens = 0),
  p AS (SELECT o, ts, CASE WHEN long_rows THEN v WHEN way = 0 THEN wob ELSE v END AS rop, CASE WHEN long_rows THEN wob WHEN way = 0 THEN v ELSE wob END AS wob, CASE WHEN long_rows THEN rpm WHEN way = 1 THEN rpm END AS rpm
    FROM r WHERE ts >= TIMESTAMP '2007-01-01' AND ts < TIMESTAMP '2010-01-01' AND NOT (day(ts) = 1 AND date_trunc('day', ts) = ts))
  SELECT 'w' || (o % 2) AS well_name, ts, rop, wob, rpm, CAST(NULL AS DOUBLE) AS spp, true AS in_order FROM p WHERE o IN (SELECT o FROM p GROUP BY 1 HAVING count(*) >= 20)"""


def in_order(df: DataFrame) -> DataFrame:
    """parse_logs's rows with whether each stands where its task's order by object and time wants it: behind an earlier
    time, or at the beginning of another object, of which each begins once."""
    placed = df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("_part").orderBy("_row"))
    placed = placed.withColumn("_begins", F.coalesce(back, F.lit(False)).cast("int"))
    return placed.withColumn("in_order", F.sum("_begins").over(Window.partitionBy("_part")) < 6).drop("_part", "_row", "_begins")


def log_files(spark, d):
    """The same logs as files of XML, written by tasks; their folder."""
    from drillframe.sources.files import write_texts

    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    curve = lambda c: tag("logCurveInfo", F.concat(tag("mnemonic", F.concat(F.lit(" "), c["mnemonic"])), tag("unit", c["unit"]), tag("curveDescription", c["description"])))
    made = logs(spark, d)
    curves = F.coalesce(F.array_join(F.transform("curves", curve), "\n"), F.lit(""))
    listed = F.coalesce(tag("mnemonicList", F.array_join("listed", " , ")), F.lit(""))
    body = F.concat(tag("indexType", F.lit("date time")), curves, tag("logData", F.concat(listed, F.lit("\n"), F.array_join(F.transform("data", lambda x: tag("data", x)), "\n"))))
    text = F.concat(F.lit('<?xml version="1.0"?>\n<logs xmlns="urn:logs"><log uid="1">'), body, F.lit("</log></logs>\n"))
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    write_texts(made.select("path", text.alias("text")), folder)
    return folder


@query(_PARSED)
def q_parse_logs(spark, d):
    from drillframe.sources.logs_xml import parse_logs

    made = in_order(parse_logs(logs(spark, d), least_rows=20))
    return made.select("well_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "rop", "wob", "rpm", "spp", "in_order")


@query(_PARSED)
def q_parse_log_files(spark, d):
    """Files of XML, written and read back in pieces."""
    from drillframe.sources import log_lines

    made = in_order(log_lines.parse_scan(log_lines.scan_logs(spark, log_files(spark, d)), least_rows=20))
    return made.select("well_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "rop", "wob", "rpm", "spp", "in_order")


@query(f"""WITH {_LOGS}, lt AS (SELECT o, c, event_id, row_number() OVER (PARTITION BY o, c ORDER BY event_id) AS n, CASE WHEN event_id % 19 = 0 THEN 'never' WHEN event_id % 23 = 0 THEN '2008-03-01 00:00:00' ELSE strftime(ts - INTERVAL 16 YEAR, '%Y-%m-%d %H:%M:%S.%f') END AS time FROM le)
  SELECT {_LOG_PATH} AS path, 'date time' AS index_type, CASE WHEN c % 3 = 0 THEN 5 ELSE 0 END::BIGINT AS n_curves, array_to_string(listed, ',') AS listed, count(*) AS n_data, string_agg(time, ';' ORDER BY n) FILTER (n <= 3) AS first_times
  FROM lf JOIN lt USING (o, c) GROUP BY ALL""")
def q_log_file_heads(spark, d):
    """Heads, numbers of lines and the first lines of files of XML, read back in pieces."""
    from drillframe.sources import log_lines, logs_xml

    heads = log_lines.scan_heads(stored(log_lines.scan_logs(spark, log_files(spark, d))), 3)
    path = F.array_join(F.slice(F.split("path", "/"), -7, 7), "/").alias("path")
    shaped = logs_xml.log_structure(heads, "index_type", "listed", "data")
    return shaped.select(path, "index_type", F.col("n_curves").cast("long").alias("n_curves"), F.array_join("listed", ",").alias("listed"), "n_data", F.array_join(F.transform("data", lambda x: F.split(x, ",")[0]), ";").alias("first_times"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 = 0")
def q_table_round_trip(spark, d):
    """Appended twice, replaced by rows of itself, read, dropped."""
    from drillframe.sources import tables

    rows, name = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), f"q_table_{uuid.uuid4().hex[:12]}"
    tables.append_table(rows.where("o_orderkey % 2 = 0"), name, ["o_orderpriority"])
    tables.append_table(rows.where("o_orderkey % 5 = 0"), name, ["o_orderpriority"])
    tables.replace_table(tables.read_table(spark, name).where("o_custkey % 3 <> 0"), name)
    found = stored(tables.read_table(spark, name))
    tables.drop_table(spark, name)
    return found


@query("SELECT event_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT)) <= trunc(count(*) OVER () * 0.15) AS is_validation FROM s")
def q_exact_holdout(spark, d):
    """Exactly 15 % of all rows, the smallest by a hash."""
    from drillframe.operators.sampling import exact_share

    place = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return exact_share(series(spark, d).select("event_id"), 0.15, ["event_id"], order=place)


@query("SELECT o_orderkey, o_totalprice, true AS in_order FROM orders")
def q_sorted_table(spark, d):
    """A table written in global order: each row stands behind the one before it in its file, and files don't overlap."""
    from drillframe.sources import tables

    name = f"q_table_{uuid.uuid4().hex[:12]}"
    tables.write_sorted(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), name, ["o_totalprice", "o_orderkey"])
    rows = tables.read_table(spark, name).select("o_orderkey", "o_totalprice", F.struct("o_totalprice", "o_orderkey").alias("at"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    apart = files.withColumn("apart", F.coalesce(F.col("low") > F.lag("high").over(Window.orderBy("low")), F.lit(True))).select("file", "apart")
    behind = F.coalesce(F.col("at") > F.lag("at").over(Window.partitionBy("file").orderBy("row")), F.lit(True))
    found = stored(rows.withColumn("behind", behind).join(apart, "file").select("o_orderkey", "o_totalprice", (F.col("behind") & F.col("apart")).alias("in_order")))
    tables.drop_table(spark, name)
    return found


@query()
def q_importances(spark, d):
    """The features that tell most, of the model across keys; no SQL can express it."""
    train = features.feature_part(prepared(spark, d), False, day())
    names = [c for c, k in train.dtypes if k in ("double", "bigint", "int") and c not in ("rop", "event_id")]
    return model.importances(model.fit(train, names, settings=model.ACROSS))
