"""Helpers shared by the text operators: reading tables, durable cuts of lineage, folds of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillframe.operators.durable import stored

__all__ = ["SPACES", "SPACE_RUN", "held_out", "labelled_sample", "meet", "plain_text", "stored", "table"]

#: The contract's white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Most rows that meet() broadcasts (under 64 MB). Beyond, bitmaps of MAP_BITS bits (4 KB) each, as many as give every row
#: SPARSE bits, from 16 MB to 256 MB in all.
BROADCAST_ROWS, LEAST_MAPS, MOST_MAPS, MAP_BITS, SPARSE = 1_000_000, 4096, 65_536, 32_768, 8


def n_maps(rows: int) -> int:
    """Bitmaps for so many rows, a power of two: at most one bit in SPARSE is set, up to 268 million rows. With more, up to
    all rows are shuffled that needn't be, and nothing else changes."""
    return min(max(1 << (rows * SPARSE // MAP_BITS).bit_length(), LEAST_MAPS), MOST_MAPS)


def meet(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined with found, of which there is one row a key; the first column of `on` is a hash, a long.

    The rows, which hold texts, stay where they are: few found rows are broadcast; of many, a bitmap is that grows with
    their number, and only rows whose bit is set are shuffled to meet them.
    """
    found = stored(found)
    size = found.count()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), on, "left")
    maps_of = n_maps(size)
    more = [f for f in found.schema if f.name not in on]
    place = lambda df: df.withColumns({"map_no": F.pmod(on[0], F.lit(maps_of)).cast("int"), "map_bit": F.pmod(F.call_function("shiftright", on[0], F.lit(20)), F.lit(MAP_BITS))})
    maps = place(found).groupBy("map_no").agg(F.bitmap_construct_agg("map_bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (F.col("map_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("map_bit") % 8).cast("int")) == 1, F.lit(False))
    marked = place(rows).join(F.broadcast(maps), "map_no", "left").withColumn("maybe", is_set).drop("map", "map_no", "map_bit")
    apart = marked.where("NOT maybe").withColumns({f.name: F.lit(None).cast(f.dataType) for f in more})
    return marked.where("maybe").join(found, on, "left").unionByName(apart).drop("maybe")


def held_out() -> Column:
    """True in the fifth of rows whose labels no fit may see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bytes of text that a fit takes in at most, besides its number of rows.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most: int | None = None) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out fold, for fitting: at most `rows`, and at most `most` bytes (SAMPLE_BYTES). Which
    ones depends on a hash of doc_id and on sizes alone: in the order of the hash, a text that no longer fits is left out.

    Both bound what reaches the driver. Labels are cut to the sample first, so that the join moves no text.
    """
    most = SAMPLE_BYTES if most is None else most
    fold = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    chosen = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # A doc_id that stands in several rows counts once, or repeated rows would pass the bound.
    got = docs.select("doc_id", plain_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    got = stored(got.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    sizes = got.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.xxhash64("doc_id").alias("hash")).collect()
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"])):
        if total + r["size"] <= most:
            taken.append((r["doc_id"],))
            total += r["size"]
    if len(taken) < len(sizes):
        ids = docs.sparkSession.createDataFrame(taken, got.select("doc_id").schema)
        got = got.join(F.broadcast(ids), "doc_id", "left_semi")
    return [(r["text"], int(r["label"])) for r in sorted(got.collect(), key=lambda r: r["doc_id"])]
