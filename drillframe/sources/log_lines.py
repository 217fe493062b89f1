"""Logs in XML read in pieces: a record is a line of data, not a log element, so that an element of any length is dealt to
many tasks, and none holds it.

The text is cut behind each </data>. A record then is a line of data, with what stands before it: nothing, or the head of
a log element, up to which the element before it has ended. Heads alone are parsed as XML. A line belongs to the last head
before it in its file; heads are few, and lines meet them by file.

Names of elements stand without a prefix, as under a default namespace. An element that has no end, whose head can't be
read, or whose data hold something else than lines, is an error, and none of its lines is given out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillframe.functions import object_at
from drillframe.operators.durable import stored
from drillframe.operators.intervals import small_enough
from drillframe.sources import logs_xml
from drillframe.sources.files import contents, few_tasks, listed, local_root

#: What a head says; its data are cut off.
SCHEMA = """indexType string, mnemonicList string,
  logCurveInfo array<struct<mnemonic:string, unit:string, curveDescription:string>>,
  logHeader struct<indexType:string, mnemonicList:string>, logData struct<mnemonicList:string>, _corrupt string"""
_LINE, _OPEN, _END = r"<data(?:\s[^<>]*)?>([^<]*)\z", r"<log(?=[\s>])", "</log>"


#: Files of up to so many bytes (and no more than Spark reads in a task) are read whole, by few tasks; the others are split
#: as text is.
SMALL = 1 << 20


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records in any order: path, at (their place in the file), line (null without one) and before (null for nothing but
    blanks). Files above SMALL are split as text is. Tasks list folders (files.listed) where all machines share them as files;
    elsewhere Spark's source does, on the driver. Store the records before they are read twice."""
    tasks = few_tasks(spark)
    limit = min(SMALL, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    root = local_root(spark, path)
    if root is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
        whole = files.where(F.col("length") <= limit).select(F.col("_metadata.file_path").alias("path"), "content").coalesce(tasks)
    else:
        files = listed(spark, root)
        whole = contents(files.where(F.col("length") <= limit).repartition(tasks, "path"))
    parts = F.split(F.regexp_replace(F.col("content").cast("string"), "\\A\ufeff", ""), "</data>")
    placed = whole.select("path", F.posexplode(parts).alias("_row", "value"), F.size(parts).alias("_n")).where("_row < _n - 1 OR value <> ''")
    placed = placed.select("path", F.struct(F.lit(0).cast("long").alias("block"), F.col("_row").cast("long").alias("row")).alias("at"), "value")
    large = [r["path"] for r in files.where(F.col("length") > limit).select("path").coalesce(tasks).collect()]
    if large:
        text = spark.read.option("lineSep", "</data>").text(large)
        split = text.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")
        placed = placed.unionByName(split)
    found = placed.withColumn("_data", F.regexp_extract("value", _LINE, 0))
    before = F.expr("left(value, length(value) - length(_data))")
    line = F.when(F.col("_data") != "", _unescaped(F.trim(F.regexp_extract("_data", _LINE, 1))))
    return found.select("path", "at", line.alias("line"), F.when(before.rlike(r"\S"), before).alias("before"))


def _unescaped(text: Column) -> Column:
    """Text with XML's own entities resolved; few lines have any."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(text.contains("&"), out).otherwise(text)


def scan_heads(records: DataFrame, sample: int = 5) -> DataFrame:
    """One row per log element, as logs_xml.read_logs gives them, with its start; `data` are its first lines, n_data is
    their number."""
    marks = records.where(F.col("before").rlike(f"{_OPEN}|{_END}"))
    fragments = F.regexp_extract_all("before", F.lit(rf"(?s){_OPEN}.*?(?:{_END}|\z)"), F.lit(0))
    # The element that a record leaves open must be closed by the next record that opens or closes one.
    closes = F.regexp_extract("before", rf"(?s)\A(?:(?!{_OPEN}).)*", 0).contains(_END)
    following = Window.partitionBy("path").orderBy("at")
    marks = marks.select("path", "at", fragments.alias("fragments"), F.lead(closes, 1, False).over(following).alias("closed"))
    rows = marks.select("path", "at", "closed", F.posexplode("fragments").alias("nth", "head"))
    whole = F.col("head").endswith(_END)
    ends = F.when(whole, "").when(F.col("head").rlike(r"<logData[\s>]"), f"</logData>{_END}").otherwise(_END)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    rows = rows.select("path", F.struct("at", "nth").alias("start"), "closed", whole.alias("whole"), F.concat("head", ends).alias("head"))
    # Files of one object have the same head: each is parsed once. A parse costs as much as reading a file.
    heads = rows.select("head").distinct().select(F.col("head").alias("_head"), F.from_xml("head", F.lit(SCHEMA), options).alias("x"))
    rows = rows.join(heads, F.col("head") == F.col("_head"), "left").drop("head", "_head")

    owned = with_start(records, rows.select("path", "start")).where("start IS NOT NULL")
    # Data that hold another element, such as one cut short, make it malformed.
    odd = F.max(F.coalesce(F.col("before").contains("<data") | F.regexp_extract("before", r"(?s)\A[^<]*</?(\w+)", 1).isin("dat", "data"), F.lit(False)))
    counts = owned.groupBy(F.col("path").alias("_path"), F.col("start").alias("_start")).agg(F.count("line").alias("n_data"), odd.alias("odd"))
    first = owned.where("line IS NOT NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("path", "start").orderBy("at"))).where(F.col("_nth") <= sample)
    first = first.groupBy(F.col("path").alias("_path"), F.col("start").alias("_start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "line"))), lambda x: x["line"]).alias("data"))
    same = (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))
    rows = rows.join(counts, same, "left").drop("_path", "_start").join(first, same, "left").drop("_path", "_start")

    broken = (~F.col("whole") & ~F.col("closed")) | F.col("x").isNull() | F.col("x._corrupt").isNotNull() | F.coalesce("odd", F.lit(False))
    return logs_xml.placed(rows.select("path", "start", F.coalesce("n_data", F.lit(0).cast("long")).alias("n_data"), *logs_xml.described("x."), "data", F.when(broken, F.lit("malformed log element")).alias("error")), "start", "n_data")


def with_start(records: DataFrame, heads: DataFrame) -> DataFrame:
    """records with the start of the element that each lies in, null before the first of its file. heads: path and start.

    Lines meet their file's starts in a join; those are sent to all tasks while they are known to be small.
    """
    starts = heads.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list("start")).alias("_starts"))
    met = records.join(F.broadcast(starts) if small_enough(heads) else starts, F.col("path") == F.col("_path"), "left")
    # What a record opens last holds its line: the last start that isn't behind it.
    own = F.try_element_at(F.filter("_starts", lambda s: s["at"] <= F.col("at")), F.lit(-1))
    return met.withColumn("start", own).drop("_path", "_starts")


def parse_scan(records: DataFrame, channels: dict[str, tuple[str, ...]] = logs_xml.CHANNELS, least_channels: int = logs_xml.LEAST_CHANNELS, least_rows: int = logs_xml.LEAST_ROWS, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """As logs_xml.parse_logs, out of records. `keep` stores the records, the heads and the parsed rows."""
    records = keep(records)
    heads = keep(scan_heads(records, 0).drop("data"))
    chosen = logs_xml.resolved_columns(heads.where("error IS NULL"), channels, least_channels, ["start"])
    # Also the starts of elements that are left out: their lines belong to no other.
    lines = with_start(records.where("line IS NOT NULL").select("path", "at", "line"), heads.select("path", "start"))
    on = [F.col("path") == F.col("_path"), F.col("start") == F.col("_start")]
    chosen = chosen.withColumnsRenamed({"path": "_path", "start": "_start"})
    rows = lines.join(F.broadcast(chosen) if small_enough(heads) else chosen, on).drop("_path", "_start")
    return logs_xml.rows_in_window(rows.withColumn("well", object_at("path", 7)), channels, least_rows, keep)
