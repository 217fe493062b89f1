"""Geology tops from a text with one XML element per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _attribute(name: str):
    return F.regexp_extract("value", rf'{name}="([^"]+)"', 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and line_at, by which lines stand in their order: of files by name, in a file by place."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    return spark.read.text(path).select("value", at.alias("line_at"))


def wells(lines: DataFrame) -> DataFrame:
    """well_id, well_common_name and line_at."""
    return lines.where(F.col("value").like("%<CD_WELL %")).select(_attribute("well_id").alias("well_id"), _attribute("well_common_name").alias("well_common_name"), "line_at")


def tops(lines: DataFrame) -> DataFrame:
    """well_id, formation_name_raw, md_ft and phase of lines that give a depth."""
    found = lines.where(F.col("value").like("%CD_WELLBORE_FORMATION%") & (_attribute("prognosed_md") != ""))
    return found.select(_attribute("well_id").alias("well_id"), _attribute("formation_name").alias("formation_name_raw"), _attribute("prognosed_md").try_cast("double").alias("md_ft"), _attribute("phase").alias("phase"))
