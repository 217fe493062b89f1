"""Near-duplicates by 64-bit SimHash: tiled exact comparison of fingerprints.

Fingerprints are counted once each, however many rows share them. Two fingerprints within the radius r agree wholly on
at least k - r of any k blocks of bits, so each fingerprint is dealt to one bucket per choice of k - r blocks, and only
buckets are compared: no pair within the radius is lost and none beyond it is kept. A bucket is a tile; one with more
than TILE fingerprints is cut into tiles by population count, and its tile pairs are rows that Spark deals out. A tile
pair is compared with numpy exclusive-or and bit counts, and skipped if the population counts differ beyond the radius.
Each comparison returns a spanning forest of its links rather than all pairs; components are joined up by alternating
star contractions, each round written to the shared folder.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows share their
component; rows with null doc_id are fingerprinted and linked, and a component of such rows alone has a null id; an
empty table gives an empty result; further columns of the input are ignored (kept by dedup()), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, plain_text, stored

SEED, WIDTH, RADIUS = 42, 3, 3
#: Fingerprints in a tile.
TILE = 4096
#: Fingerprints in a bucket that the number of blocks is chosen for.
BUCKET = 128
#: Shingles counted at once, to bound memory on very long texts.
BATCH = 65536


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Majority of the bits of the XXH64 of all word shingles; bytes.lower() and split() know A-Z and ASCII blanks only."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for part in batched(shingles, BATCH):
        hashes = np.array([digest(s, SEED) for s in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def marks() -> dict[str, Column]:
    """Two hashes that tell rows apart by id and text."""
    return {"mark": F.xxhash64("doc_id", "text"), "mark_too": F.xxhash64(F.lit(1), "text", "doc_id")}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the row's marks and fp (the fingerprint as a signed long) of each row."""
    rows = docs.select("doc_id", *[c.alias(n) for n, c in marks().items()], plain_text().cast("binary").alias("data"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b["data"]), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["mark"], b["mark_too"], pa.array(fp)], ["doc_id", "mark", "mark_too", "fp"])

    return rows.mapInArrow(mapped, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, mark_too long, fp long")


def _blocks(count: int, radius: int) -> int:
    """How many blocks the 64 bits are cut into, so that about BUCKET fingerprints agree on all but `radius` of them."""
    k = radius + 1
    while count / 2 ** (64 * (k - radius) / k) > BUCKET and k < radius + 4:
        k += 1
    return k


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, blocks - radius)]


def link_forest(fps: np.ndarray, radius: int, other_from: int | None = None) -> list[tuple[int, int]]:
    """(member, representative) links that span the components of `fps` under the radius. Rows are taken in order of
    population count, so that each tile of rows meets only columns whose counts are within the radius. With
    `other_from`, only pairs across that position count."""
    side = np.zeros(len(fps), bool) if other_from is None else np.arange(len(fps)) >= other_from
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts, side = fps[order], counts[order].astype(np.int64), side[order]
    label = np.arange(len(fps))
    for at in range(0, len(fps), 256):
        to = min(at + 256, len(fps))
        end = int(np.searchsorted(counts, counts[to - 1] + radius, "right"))
        near = np.bitwise_count(fps[at:to, None] ^ fps[None, at:end]) <= radius
        if other_from is not None:
            near &= side[at:to, None] != side[None, at:end]
        near[np.arange(to - at), np.arange(to - at)] = False
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.unique(np.append(label[at:end][near[i]], label[at + i]))
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    values = fps.view(np.int64)
    return list(zip(values[moved].tolist(), values[label[moved]].tolist()))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that span all components under the radius."""
    masks = _masks(_blocks(distinct.count(), radius), radius)
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "bits"))
    large = dealt.groupBy("part", "bits").count().where(F.col("count") > tile)
    pieces = F.ceil(F.col("count") / tile).cast("int")
    cell = F.bit_count("fp") * 65536 + F.pmod(F.xxhash64("fp"), pieces).cast("int")
    tiles = (
        dealt.join(large, ["part", "bits"], "left")
        .withColumn("tile", F.when(F.col("count").isNull(), F.lit(-1)).otherwise(cell))
        .groupBy("part", "bits", "tile").agg(F.collect_list("fp").alias("a"))
    )
    whole = tiles.where((F.col("tile") < 0) & (F.size("a") > 1)).select("a", F.lit(None).cast("array<long>").alias("b"))
    cut = tiles.where(F.col("tile") >= 0)
    left, right = cut.alias("l"), cut.alias("r")
    near = F.abs(F.floor(F.col("l.tile") / 65536) - F.floor(F.col("r.tile") / 65536)) <= radius
    pairs = left.join(right, (F.col("l.part") == F.col("r.part")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.tile") <= F.col("r.tile")) & near)
    pairs = pairs.select(F.col("l.a").alias("a"), F.when(F.col("l.tile") < F.col("r.tile"), F.col("r.a")).alias("b"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b in zip(batch["a"], batch["b"]):
                fps = np.asarray(a.values, np.int64)
                cut_at = None
                if b.is_valid:
                    cut_at, fps = len(fps), np.concatenate([fps, np.asarray(b.values, np.int64)])
                found += link_forest(fps.view(np.uint64), radius, cut_at)
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return whole.unionByName(pairs.repartition(F.xxhash64("a"), F.xxhash64("b"))).mapInArrow(mapped, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of at least two nodes, by alternating large and small stars."""

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = stored(canonical(edges))
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = canonical(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = stored(canonical(small))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, marks, fp, component_id (smallest doc_id) and keeper (smallest doc_id and marks) of each row."""
    rows = stored(fingerprints(docs))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "mark", "mark_too")).alias("first_row")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "first_row", F.coalesce("root", "fp").alias("root"))
    own = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("keeper"))
    return rows.join(rooted.select("fp", "root").join(own, "root").drop("root"), "fp")


def simhash_classes(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row left of each component: the one with the smallest doc_id.

    Rows are chosen by their marks alone. Only marks of rows that go, and of those that stand several times, meet the
    texts; of the latter, equal rows are made one.
    """
    here = F.struct("mark", "mark_too")
    rows = classes(docs).groupBy("mark", "mark_too").agg(F.count("*").alias("n"), F.first("keeper").alias("keeper"))
    chosen = F.struct("keeper.mark", "keeper.mark_too") == here
    special = rows.where(~chosen | (F.col("n") > 1)).select("mark", "mark_too", chosen.alias("stays"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in marks().items()])
    met = meet(packed, special, ["mark", "mark_too"])
    once = met.where("stays IS NULL").select("row")
    several = met.where("stays").dropDuplicates(["mark", "mark_too"]).select("row")
    return once.unionByName(several).select("row.*")
