"""Sensor logs in XML: headers, samples and whole logs as one lazy plan over all files.

A log lists its curves (logCurveInfo), may list their order (mnemonicList) and has rows of comma-separated cells
(logData/data), the first of which is the time. Which cell is which channel is settled for each file: by its own
mnemonicList, else by its logCurveInfo, else by the last file before it in the same log object that had one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillframe.functions import cell, in_window, is_month_start, object_at
from drillframe.operators.durable import stored

#: Canonical channel and the source mnemonics that stand for it, in order of preference.
CHANNELS = {
    "rop": ("ROP", "ROP5", "ROP30s", "ROP2M", "GS_ROP", "QROP"),
    "wob": ("SWOB", "CWOB", "GS_SWOB", "DWOB_RT", "DWOB_RAW_RT"),
    "rpm": ("RPM", "DRPM", "TRPM_RT", "CRPM_RT", "DRPM30s", "Bit_RPM"),
    "spp": ("SPPA", "SPP", "GS_SPPA", "SIG_SPP5s"),
    "flow_in": ("TFLO", "FLOWIN", "FLOW-TRPM"),
    "torque": ("TQA", "ACTC", "TORQUE_AVG", "TRQ"),
    "ecd": ("ECD_CT_FPWD", "ACTECDM", "ECD_ARC_RT", "ECD_ECO_RT"),
    "hkld": ("HKLD",),
    "dmea": ("DMEA", "DBTM", "DEPTH", "DEPT"),
    "bpos": ("BPOS",),
    "spm1": ("SPM1",),
    "spm2": ("SPM2",),
    "spm3": ("SPM3",),
    "mwti": ("MWTI",),
}
#: Log objects with fewer channels or rows are left out; rows outside the window are.
LEAST_CHANNELS, LEAST_ROWS, FIRST_DAY, END_DAY = 3, 100, "2007-01-01", "2010-01-01"

SCHEMA = """indexType string, mnemonicList string,
  logCurveInfo array<struct<mnemonic:string, unit:string, curveDescription:string>>,
  logHeader struct<indexType:string, mnemonicList:string>,
  logData struct<mnemonicList:string, data:array<string>>, _corrupt string"""


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log element, with its file. A default namespace needs no prefix. An element that can't be read gives a
    row with an error; with_unreadable() adds rows for files without any whole element."""
    options = {"rowTag": "log", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": True, "recursiveFileLookup": True, "pathGlobFilter": "*.xml"}
    raw = spark.read.format("xml").options(**options).schema(SCHEMA).load(path)
    return placed(raw.select(F.col("_metadata.file_path").alias("path"), *described(), F.col("logData.data").alias("data"), F.when(F.col("_corrupt").isNotNull(), F.lit("malformed log element")).alias("error")))


def described(at: str = "") -> list[Column]:
    """index_type, listed and curves, out of the fields of SCHEMA below `at`."""
    curves = F.transform(f"{at}logCurveInfo", lambda c: F.struct(F.trim(c["mnemonic"]).alias("mnemonic"), F.trim(c["unit"]).alias("unit"), F.trim(c["curveDescription"]).alias("description")))
    kind = F.lower(F.trim(F.coalesce(f"{at}indexType", f"{at}logHeader.indexType", F.lit("unknown"))))
    return [kind.alias("index_type"), _names(F.coalesce(f"{at}mnemonicList", f"{at}logHeader.mnemonicList", f"{at}logData.mnemonicList")).alias("listed"), curves.alias("curves")]


def placed(out: DataFrame, *more: str) -> DataFrame:
    """With what the path says: well, log object, chunk and file."""
    names = {"well": 7, "bore": 6, "index": 4, "log": 3, "chunk": 2, "file": 1}
    out = out.select("*", *[object_at("path", n).alias(c) for c, n in names.items()])
    return out.select("path", "well", F.concat_ws("/", "well", "bore", "index", "log").alias("log_obj"), F.col("chunk").try_cast("long").alias("chunk"), "file", "index_type", "listed", "curves", "data", "error", *more)


def with_unreadable(logs: DataFrame, files: DataFrame) -> DataFrame:
    """logs and a row with an error for each of the files (column path) that gave none: empty, cut short or something
    else. Files are matched by their path without scheme and host."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    found = logs.select(bare("path").alias("_bare")).distinct()
    missing = files.select("path", bare("path").alias("_bare")).join(found, "_bare", "left_anti")
    kinds = {f.name: f.dataType for f in logs.schema}
    given = {"index_type": F.lit("unknown"), "error": F.lit("no whole log element")}
    rows = missing.select("path", *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in ("index_type", "listed", "curves", "data", "error")])
    return logs.unionByName(placed(rows), allowMissingColumns=True)


def _names(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda x: F.trim(x))


def log_channels(logs: DataFrame) -> DataFrame:
    """path, mnemonic, unit, description and error of each curve; a file without curves, or that can't be read, gives one
    row with nulls."""
    return logs.select("path", "well", "error", F.explode_outer("curves").alias("c")).select("path", "well", "c.*", "error")


def log_header(logs: DataFrame) -> DataFrame:
    """Index type and mnemonics of each file; the index type of one that can't be read is its error."""
    kind = F.coalesce(F.concat(F.lit("error: "), "error"), "index_type").alias("index_type")
    return logs.select("path", "log_obj", kind, F.transform("curves", lambda c: c["mnemonic"]).alias("mnemonics"))


def log_sample(logs: DataFrame, n: int = 5) -> DataFrame:
    """The listed mnemonics (null if there is no list) and the first n data rows."""
    return logs.select("path", "listed", F.slice("data", 1, n).alias("rows"))


def log_structure(logs: DataFrame, *more: str) -> DataFrame:
    """What each file has, and `more` of its columns."""
    n_data = F.col("n_data") if "n_data" in logs.columns else F.coalesce(F.size("data"), F.lit(0))
    return logs.select("path", F.coalesce(F.size("curves"), F.lit(0)).alias("n_curves"), n_data.alias("n_data"), F.col("listed").isNotNull().alias("has_list"), F.substring(F.get("data", F.lit(0)), 1, 120).alias("first_row"), *more)


def resolve_channels(mnemonics: Column, channels: dict[str, tuple[str, ...]] = CHANNELS) -> dict[str, Column]:
    """channel -> the first of its mnemonics that is among those of the log, or null."""
    return {c: F.get(F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains(mnemonics, x)), F.lit(0)) for c, names in channels.items()}


def keyword_wells(channels: DataFrame, keywords: list[str], most: int = 5) -> DataFrame:
    """Mnemonics that contain a keyword, at most `most`, by keyword."""
    hits = channels.select("mnemonic", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).where(F.upper("mnemonic").contains(F.col("keyword")))
    return hits.groupBy("keyword").agg(F.slice(F.array_sort(F.collect_set("mnemonic")), 1, most).alias("mnemonics"))


def shared_mnemonics(channels: DataFrame, least: int = 3) -> DataFrame:
    """Mnemonics that stand in `least` wells or more, with their wells."""
    return channels.groupBy("mnemonic").agg(F.array_sort(F.collect_set("well")).alias("wells")).where(F.size("wells") >= least)


def parse_logs(logs: DataFrame, channels: dict[str, tuple[str, ...]] = CHANNELS, least_channels: int = LEAST_CHANNELS, least_rows: int = LEAST_ROWS, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """ts, the channels and well_name: every row of every log object with channels and rows enough, each task's rows by
    object and time. A log element is one row here; log_lines.parse_scan takes elements of any length.

    `keep` stores what is read several times: the logs, so that XML is read once and headers alone are read again, and
    the parsed rows, which are counted before they are given out.
    """
    logs = keep(logs.where("error IS NULL"))
    rows = logs.select("path", "well", F.explode("data").alias("line")).join(resolved_columns(logs, channels, least_channels), "path")
    return rows_in_window(rows, channels, least_rows, keep)


def resolved_columns(heads: DataFrame, channels: dict[str, tuple[str, ...]], least_channels: int, start: list[str] | None = None) -> DataFrame:
    """path (and start), log_obj, _columns (the mnemonic of each cell) and _chosen (channel to mnemonic) of the elements of
    log objects with channels enough.

    The first element of an object settles which mnemonic stands for a channel. Only headers go through the window.
    """
    start = start or []
    order, names = F.struct("chunk", "file", *start), F.transform("curves", lambda c: c["mnemonic"])
    first = heads.groupBy("log_obj").agg(F.min_by(names, order).alias("_first"))
    chosen = first.select("log_obj", F.map_from_arrays(F.array(*map(F.lit, channels)), F.array(*resolve_channels(F.col("_first"), channels).values())).alias("_chosen"))
    chosen = chosen.where(F.size(F.filter(F.map_values("_chosen"), lambda v: v.isNotNull())) >= least_channels)
    own = F.coalesce("listed", F.when(F.size("curves") > 0, names))
    files = heads.select("path", *start, "log_obj", "chunk", "file", own.alias("_own"))
    before = Window.partitionBy("log_obj").orderBy("chunk", "file", *start).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("_columns", F.last("_own", ignorenulls=True).over(before)).join(chosen, "log_obj").select("path", *start, "log_obj", "_columns", "_chosen")


def rows_in_window(rows: DataFrame, channels: dict[str, tuple[str, ...]], least_rows: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ts, the channels and well_name of lines, of objects with rows enough within the drilling window. rows: log_obj, well,
    line, _columns, _chosen. Rows stay in the tasks that read them, by object and time: no range of times is dealt out
    anew (tables.write_sorted does that for who wants one order over all)."""
    rows = rows.withColumn("cells", F.split("line", ","))
    place = lambda c: F.array_position("_columns", F.col("_chosen")[c]).cast("int") - 1
    parsed = rows.select("log_obj", F.trim(F.get("cells", F.lit(0))).try_cast("timestamp").alias("ts"), *[cell(F.col("cells"), place(c)).alias(c) for c in channels], F.col("well").alias("well_name"))
    kept = keep(parsed.where(F.col("ts").isNotNull() & in_window("ts", FIRST_DAY, END_DAY) & ~is_month_start("ts")))
    enough = kept.groupBy("log_obj").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
    return kept.join(enough, "log_obj", "left_semi").sortWithinPartitions("log_obj", "ts").drop("log_obj")
