"""Tables: reading, appending, replacing, dropping.

A table's name is a view of its current version, a table of its own. Replacing writes the next version whole, claims its
number and moves the view, one statement: who reads gets the old rows or the new ones, never neither. The number can be
claimed once: of two writers that have read the same version, the second is refused. A few versions back are kept for
who is still reading them.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Versions kept behind the current one.
KEPT = 2


class Conflict(Exception):
    """The version that the rows were made from is no longer the current one."""


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The version that is current now; a later replacement doesn't change what this DataFrame reads."""
    return spark.read.table(_current(spark, name)[1] or name)


def version_of(spark: SparkSession, name: str) -> int:
    """The number of the current version; 0 if there is no such table."""
    return _current(spark, name)[0]


def append_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Adds rows to the current version; the first ones make it."""
    number, table = _current(df.sparkSession, name)
    if not number:
        replace_table(df, name, partition_by, 0)
    else:
        _writer(df, partition_by).mode("append").saveAsTable(table)


def replace_table(df: DataFrame, name: str, partition_by: list[str] | None = None, read: int | None = None, buckets: tuple[int, list[str], list[str]] | None = None) -> int:
    """Replaces the table, even by rows that are read from it, and returns the new version's number. read: the version
    that df was made from, else the current one; Conflict if another has taken its place since. buckets: their number,
    the columns that deal rows to them, and those that sort them."""
    spark = df.sparkSession
    number = (version_of(spark, name) if read is None else read) + 1
    fresh = f"{name}__v{number}_{uuid.uuid4().hex[:12]}"
    writer = _writer(df, partition_by)
    (writer.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[2]) if buckets else writer).saveAsTable(fresh)
    if version_of(spark, name) != number - 1 or not _claim(spark, name, number, fresh):
        spark.sql(f"DROP TABLE {fresh}")
        raise Conflict(f"{name} is no longer at version {number - 1}")
    _move(spark, name, number, fresh)
    for old, table in _versions(spark, name):
        if old < number - KEPT:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    return number


def finish_replacement(spark: SparkSession, name: str) -> int:
    """Moves the view to a version that a writer claimed before it stopped; its rows were whole by then. To be called when
    that writer is known to be gone. Returns the current version's number."""
    number = version_of(spark, name) + 1
    path = _claims(spark, name, number)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path):
        _move(spark, name, number, spark.read.text(path.toString()).first()[0])
    return version_of(spark, name)


def write_sorted(df: DataFrame, name: str, order: list[str], partition_by: list[str] | None = None) -> None:
    """A table whose files hold the rows in global order: ranges of it are dealt to tasks, none of which sorts all."""
    replace_table(df.orderBy(*order), name, partition_by)


def write_for_windows(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """A table whose rows lie together by key and in order: windows by these keys, or by more columns, need no exchange.
    A key's rows share a bucket: a hot one is better served by (key, day) as keys."""
    replace_table(df, name, buckets=(buckets, keys, [*keys, *order]))


def drop_table(spark: SparkSession, name: str) -> None:
    """Drops the view, all versions and their claims."""
    tables = [table for _, table in _versions(spark, name)]
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = _claims(spark, name, 0).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _writer(df: DataFrame, partition_by: list[str] | None):
    writer = df.write.format("parquet")
    return writer.partitionBy(*partition_by) if partition_by else writer


def _current(spark: SparkSession, name: str) -> tuple[int, str]:
    if not spark.catalog.tableExists(name):
        return 0, ""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if "drillframe.version" not in found:
        raise ValueError(f"{name} is a table of another making")
    return int(found["drillframe.version"]), found["drillframe.table"]


def _move(spark: SparkSession, name: str, number: int, table: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('drillframe.version' = '{number}', 'drillframe.table' = '{table}') AS SELECT * FROM {table}")


def _versions(spark: SparkSession, name: str) -> list[tuple[int, str]]:
    """Numbers and tables of all versions that are there."""
    base, _, short = name.rpartition(".")
    found = spark.sql(f"SHOW TABLES {f'IN {base} ' if base else ''}LIKE '{short}__v*'").collect()
    named = [(r["tableName"].rpartition("__v")[2].partition("_")[0], r["tableName"]) for r in found if r["tableName"].rpartition("__v")[0] == short.lower()]
    return [(int(n), f"{base}.{t}" if base else t) for n, t in named if n.isdigit()]


def _claims(spark: SparkSession, name: str, number: int):
    """The file that stands for a version's number, in the warehouse that all share."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_claims/{name}"
    return spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")


def _claim(spark: SparkSession, name: str, number: int, table: str) -> bool:
    """Whether the number was free; making a file that must not exist is one step for all."""
    path = _claims(spark, name, number)
    try:
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(table.encode()))
    out.close()
    return True
