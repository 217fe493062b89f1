"""From raw formation tops to a table of half-open depth intervals by well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillframe.functions import bridge_name, decode_entities, first_match, lookup
from drillframe.functions.scalars import FEET_PER_METRE
from drillframe.operators import stats, windows

#: What a lower-cased name contains, and the formation that it then is. The first match counts.
FORMATION_RULES = [
    ("hugin", "Hugin"),
    ("sleipner", "Skagerrak"),
    ("skagerrak", "Skagerrak"),
    ("heather", "Heather"),
    ("draupne", "Draupne"),
    ("aasgard", "Aasgard"),
    ("asgard", "Aasgard"),
    ("roedby", "Chalk"),
    ("rodby", "Chalk"),
    ("hidra", "Chalk"),
    ("blod", "Chalk"),
    ("ekofisk", "Chalk"),
    ("hod", "Chalk"),
    ("tor ", "Chalk"),
    ("tor_", "Chalk"),
    ("tor fm", "Chalk"),
    ("top tor", "Chalk"),
    ("topp tor", "Chalk"),
    (" tor", "Chalk"),
    ("ty fm", "Ty"),
    ("ty_", "Ty"),
    ("top ty", "Ty"),
    ("topp ty", "Ty"),
    (" ty", "Ty"),
    ("ty ", "Ty"),
    ("lista", "Lista"),
    ("sele", "Sele"),
    ("balder", "Balder"),
    ("grid", "Grid"),
    ("skade", "Skade"),
    ("utsira", "Utsira"),
]
#: Formations from shallow to deep, numbered from 1; 0 is unknown.
FORMATIONS = ("Utsira", "Skade", "Grid", "Balder", "Sele", "Lista", "Ty", "Chalk", "Aasgard", "Draupne", "Heather", "Hugin", "Skagerrak")
ORDINAL = {name: i + 1 for i, name in enumerate(FORMATIONS)}
#: How much a phase is trusted.
PHASE_RANK = {"ACTUAL": 3, "PLAN": 2, "PROTOTYPE": 1}
OPEN_END = 99_999.0


def canonical_formation(name):
    """The formation that a raw name stands for, or null."""
    # Within a lambda the decoded name is made once, not once a rule.
    return F.transform(F.array(decode_entities(name)), lambda n: first_match(n, FORMATION_RULES))[0]


def best_tops(tops: DataFrame, wells: DataFrame) -> DataFrame:
    """well_common_name, formation and md_m: of each well id and formation the best phase, then the shallowest. Of lines
    for one well id the last names it."""
    named = tops.where("md_ft > 0").select("well_id", canonical_formation("formation_name_raw").alias("formation"), "md_ft", lookup("phase", PHASE_RANK).alias("rank")).where("formation IS NOT NULL")
    best = windows.first_of(named, ["well_id", "formation"], [F.desc("rank"), F.asc("md_ft")])
    names = wells.groupBy("well_id").agg(F.max_by("well_common_name", "line_at").alias("well_common_name"))
    return best.join(names, "well_id", "left").select("well_common_name", "formation", (F.col("md_ft") / FEET_PER_METRE).alias("md_m"))


def formation_intervals(best: DataFrame, drilled: DataFrame) -> DataFrame:
    """well_name, md_from_m, md_to_m, formation, formation_id. drilled: well_name of the logs; one common name may stand
    for several wells, and wells without tops get no rows."""
    shallowest = best.groupBy("well_common_name", "formation").agg(F.min("md_m").alias("md_m"))
    bridged = drilled.select("well_name").distinct().withColumn("well_common_name", bridge_name("well_name"))
    named = bridged.join(shallowest, "well_common_name")
    spans = windows.lead_intervals(named, "well_name", "md_m", "md_to", OPEN_END, ["formation"])
    return spans.select("well_name", F.round("md_m", 3).alias("md_from_m"), F.round("md_to", 3).alias("md_to_m"), "formation", lookup("formation", ORDINAL).cast("long").alias("formation_id"))


def wells_without_tops(intervals: DataFrame, drilled: DataFrame) -> DataFrame:
    return drilled.select("well_name").distinct().join(intervals.select("well_name"), "well_name", "left_anti")


def coverage(intervals: DataFrame, drilled: DataFrame) -> DataFrame:
    """Shallowest top and deepest drilled metre of each well; depths that can't be metres are taken for feet, by row."""
    metres = F.when(F.col("dmea") < 10_000, F.col("dmea")).otherwise(F.col("dmea") / FEET_PER_METRE)
    deep = drilled.groupBy("well_name").agg(F.max(metres).alias("deepest_m"))
    top = intervals.groupBy("well_name").agg(F.min("md_from_m").alias("first_top_m"))
    state = F.when(F.col("first_top_m").isNull(), "no tops").when(F.col("first_top_m") <= F.col("deepest_m"), "covered").otherwise("above tops")
    return deep.join(top, "well_name", "left").withColumn("state", state)


def field_medians(best: DataFrame) -> DataFrame:
    """Exact median depth of each formation and the number of wells that have it."""
    made = best.groupBy("formation").agg(F.count_distinct("well_common_name").alias("n_wells"))
    found = stats.with_quantiles(made, stats.exact_quantiles(best, ["formation"], ["md_m"], [0.5]), ["formation"])
    return found.select("formation", F.col("md_m_q")[0].alias("md_m"), "n_wells")
