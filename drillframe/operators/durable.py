"""Cutting lineage where several steps read the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of stored tables, by application, in the order of writing.
_written: dict[str, list[str]] = {}
#: Temporary folder of each local session without a shared one, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a session that runs on this machine alone, as in tests, gets a temporary folder, which goes when
    Python ends. On a cluster such a folder would lie on each machine's own disk: ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="drillframe-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application alone writes to."""
    return f"{shared_folder(spark).rstrip('/')}/drillframe/{spark.conf.get('spark.app.id', 'app')}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, and safe from lost executors."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(own_folder(df.sparkSession), []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _reads(df: DataFrame, path: str) -> bool:
    return any(f"/{path.rpartition('/')[2]}/" in f for f in df.inputFiles())


def discard(df: DataFrame) -> None:
    """Deletes the stored tables that df reads, once nothing else does."""
    mine = _written.get(own_folder(df.sparkSession), [])
    for path in [p for p in mine if _reads(df, p)]:
        _delete(df.sparkSession, path)
        mine.remove(path)


def mark(spark: SparkSession) -> int:
    """Where the list of stored tables ends, for discard_since()."""
    return len(_written.get(own_folder(spark), []))


def discard_since(spark: SparkSession, start: int, keep: DataFrame) -> None:
    """Deletes what was stored since mark(), but for what `keep` reads: the steps of a stage whose result is stored."""
    mine = _written.get(own_folder(spark), [])
    for path in [p for p in mine[start:] if not _reads(keep, p)]:
        _delete(spark, path)
        mine.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored; what reads it can't be used any more."""
    _delete(spark, own_folder(spark))
    _written.pop(own_folder(spark), None)
