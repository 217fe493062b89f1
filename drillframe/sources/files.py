"""Trees of files: archives, listings and inventories, from file metadata that Spark's binaryFile source lists."""

from __future__ import annotations

import os
import re
import zipfile
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillframe.functions import object_at
from drillframe.operators.durable import stored

#: Kinds of objects that a well bore folder may hold.
OBJECT_TYPES = ("log", "trajectory", "mudLog", "message", "bhaRun")


def extract_archive(spark: SparkSession, path: str, target: str) -> dict[str, float]:
    """Unpacks a zip archive, that all executors can open, to a folder that all can write to. The driver reads the list
    of entries only; tasks unpack them."""
    with zipfile.ZipFile(path) as archive:
        entries = [(e.filename, e.file_size) for e in archive.infolist() if not e.is_dir()]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(path) as archive:
            for rows in batches:
                for name in rows["entry"]:
                    archive.extract(name, target)
                yield rows

    made = spark.createDataFrame(entries, "entry string, bytes long").repartition("entry").mapInPandas(unpack, "entry string, bytes long")
    total = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return {"entries": total["n"], "megabytes": total["bytes"] / 1e6}


def few_tasks(spark: SparkSession) -> int:
    """Tasks for work on many small files: enough for all cores, few enough that starting them costs nothing."""
    return 4 * spark.sparkContext.defaultParallelism


#: Folders that a task goes through below one that it is given; the others are dealt out anew.
HELD = 1_000
#: Rows that a task gives out at a time: entries of folders, and small files with their contents.
ENTRIES, READ = 10_000, 64
#: What Spark's URIs of files write as escapes.
_ESCAPED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]')


def local_root(spark: SparkSession, path: str) -> str | None:
    """The folder's path where it lies in the file system that all machines share under the same name; else None, as for
    other file systems, single files and patterns, which Spark's own sources list."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return where.getPath() if where.getScheme() == "file" and os.path.isdir(where.getPath()) else None


def listed(spark: SparkSession, root: str, suffix: str = ".xml") -> DataFrame:
    """path and length of all files below root (as local_root gives it), but for those that Spark's sources hide too, and
    what lies in hidden folders.

    Tasks list; the driver holds no path. A task goes through HELD folders below one that it is given, upper ones first;
    what it finds beyond is dealt out anew over all tasks, until no folder is left.
    """
    most, at_once = HELD, ENTRIES

    def hidden(name: str) -> bool:
        return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for folder in batch["path"]:
                left, gone = deque([folder]), 0
                while left:
                    gone += 1
                    with os.scandir(left.popleft()) as entries:
                        for e in entries:
                            if hidden(e.name):
                                continue
                            if not e.is_dir():
                                if e.name.endswith(suffix):
                                    rows.append((e.path, e.stat().st_size))
                            elif gone + len(left) < most:
                                left.append(e.path)
                            else:
                                rows.append((e.path, -1))
                            if len(rows) >= at_once:
                                yield pd.DataFrame(rows, columns=["path", "length"])
                                rows = []
        yield pd.DataFrame(rows, columns=["path", "length"]).astype({"path": "object", "length": "int64"})

    found, todo = [], spark.createDataFrame([(root,)], "path string")
    while True:
        # Stored, so that no folder is listed twice.
        found.append(stored(todo.mapInPandas(below, "path string, length long")))
        folders = found[-1].where("length < 0").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found).where("length >= 0")
        todo = folders.repartition(few_tasks(spark), "path")


def contents(paths: DataFrame) -> DataFrame:
    """path, as _metadata.file_path gives it, and content of small files of the file system that all machines share."""
    at_once, odd = READ, _ESCAPED

    def escaped(path: str) -> str:
        return "file:" + odd.sub(lambda found: "".join(f"%{b:02X}" for b in found[0].encode()), path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), at_once):
                some, held = batch["path"].iloc[start : start + at_once], []
                for path in some:
                    with open(path, "rb") as f:
                        held.append(f.read())
                yield pd.DataFrame({"path": [escaped(path) for path in some], "content": held})

    return paths.select("path").mapInPandas(read, "path string, content binary")


def write_texts(rows: DataFrame, folder: str) -> int:
    """Writes each row's text (columns path, below the folder, and text) as a file of its own, by tasks; the folder is one
    that all executors can write to. A task that is run again writes the same files again. Returns their number."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                target = f"{root.rstrip('/')}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
            yield batch[["path"]]

    dealt = rows.select("path", "text").repartition(few_tasks(rows.sparkSession), "path")
    return dealt.mapInPandas(write, "path string").count()


def choose_root(spark: SparkSession, path: str) -> str:
    """The folder itself, or the only folder in it; any path that Spark can list."""
    inside = top_entries(file_index(spark, path, "*"), path).limit(2).collect()
    return f"{path.rstrip('/')}/{inside[0]['entry']}" if len(inside) == 1 and inside[0]["kind"] == "dir" else path


def file_index(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    """path, length and modificationTime of all files below root; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", "modificationTime")


#: Scheme and host of a path.
_PLACE = r"^[A-Za-z0-9+.-]+:(//[^/]*)?"


def top_entries(files: DataFrame, root: str) -> DataFrame:
    """The entries at the top of root, with kind dir or file, number of files and bytes."""
    below = len(re.sub(_PLACE, "", root).rstrip("/")) + 2
    rest = F.split(F.substring(F.regexp_replace("path", _PLACE, ""), below, 1 << 30), "/")
    kind = F.when(F.size(rest) > 1, "dir").otherwise("file")
    return files.groupBy(rest[0].alias("entry"), kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def data_files(files: DataFrame) -> DataFrame:
    """Files whose names begin with a digit, outside folders that begin with an underscore."""
    return files.where(F.col("path").rlike(r"/[0-9][^/]*\.xml$") & ~F.col("path").rlike(r"/_[^/]*/"))


def log_files(files: DataFrame) -> DataFrame:
    """well, bore, index, log_obj, chunk and file out of paths well/bore/log/index/log_obj/chunk/file."""
    names = {"well": 7, "bore": 6, "index": 4, "log": 3, "chunk": 2, "file": 1}
    out = data_files(files).select("path", "length", *[object_at("path", n).alias(c) for c, n in names.items()])
    key = F.concat_ws("/", "well", "bore", "index", "log")
    return out.select("path", "length", "well", "bore", "index", key.alias("log_obj"), F.col("chunk").try_cast("long").alias("chunk"), "file")


def log_objects(files: DataFrame) -> DataFrame:
    """First file and megabytes of each log object."""
    return log_files(files).groupBy("well", "bore", "index", "log_obj").agg(F.min_by("path", F.struct("chunk", "file")).alias("first_path"), (F.sum("length") / 1e6).alias("megabytes"), F.count("*").alias("n_files"))


def object_presence(paths: DataFrame, types: tuple[str, ...] = OBJECT_TYPES) -> DataFrame:
    """Well bores that have each type of object, by well. paths: well, bore, object_type."""
    return paths.groupBy("well").pivot("object_type", list(types)).agg(F.count_distinct("bore")).fillna(0)


def largest_files(files: DataFrame, key: str = "well", n: int = 15) -> DataFrame:
    """The largest file of each key, and of those the n largest; ties go to the smaller path."""
    top = files.groupBy(key).agg(F.max_by(F.struct("path", "length"), F.struct("length", "path")).alias("f"))
    return top.select(key, "f.path", "f.length").orderBy(F.desc("length"), "path").limit(n)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), (F.sum("length") / 1e9).alias("gigabytes"))
