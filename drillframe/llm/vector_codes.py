"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become whole numbers, floor(SCALE * x), cut into PARTS equal consecutive parts; each position has a codebook of
up to ENTRIES entries, refined in ROUNDS rounds of assignment and mean. An entry at distance d from a part has a norm
within d of the part's own. Entries are therefore sorted by norm; the one nearest in norm gives a first distance, which
bounds an interval of norms, found by binary search; only entries within it, ends included, are compared, exactly and
from the start outwards, and each better one narrows the interval. Equal distances go to the lower index.

A round is one pass over the stored vectors: each task gives the sums of its parts by entry, which Spark adds up; the
driver holds the codebooks alone, PARTS * ENTRIES entries. Sums are exact for all finite numbers: they are added in limbs
of 32 bits.

Edge cases: rows whose vector is null, or holds a null or a component that isn't finite, go; a length that PARTS doesn't
divide is filled up with zeros, which changes no distance; the length is that of the first vector by vec_id, and rows of
another length, which have no distance to it, go too. Codebooks start from the smallest distinct vec_ids, a null one last,
and of rows with equal ids from the smallest vector; with fewer ids codebooks are smaller. Repeated rows count each. Null
labels are equal to each other. An error beyond a long is given as the largest long. An empty table gives an empty
result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB = 32
LARGEST = (1 << 63) - 1
#: Distinct labels whose sums are broadcast (under 64 MB); beyond, they meet the rows in a shuffle.
BROADCAST_ROWS = 1_000_000


def kept_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and vector of the rows whose vector is whole."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & finite).select("vec_id", "label", F.col(vector).alias("vector"))


def to_parts(flat: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers of vectors (rows, components) as (rows, PARTS, width): int64, or Python's where a number is huge."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat.astype(np.float64) * SCALE)
    if flat.size and (not np.isfinite(scaled).all() or np.abs(scaled).max() >= 2.0**62):
        whole = np.array([[math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in row] for row in flat.tolist()], object).reshape(flat.shape)
    else:
        whole = scaled.astype(np.int64)
    out = np.zeros((len(flat), PARTS * width), whole.dtype)
    out[:, : flat.shape[1]] = whole
    return out.reshape(len(flat), PARTS, width)


class Annulus:
    """One codebook, its entries sorted by norm. `compared` counts the distances that were computed."""

    def __init__(self, entries: list[list[int]]):
        self.entries, self.compared = entries, 0
        exact = [math.isqrt(sum(x * x for x in e)) for e in entries]
        self.order = sorted(range(len(entries)), key=lambda i: (exact[i], i))
        self.whole_norms = [exact[i] for i in self.order]
        width = len(entries[0]) if entries else 0
        #: Numbers below it give distances that 64 bits hold.
        self.limit = 1 << ((61 - max(width - 1, 0).bit_length()) // 2)
        self.small = all(abs(x) < self.limit for e in entries for x in e)
        if self.small:
            self.table = np.array([entries[i] for i in self.order], np.int64).reshape(len(entries), width)
            self.index = np.array(self.order, np.int64)
            self.norms = np.sqrt((self.table.astype(np.float64) ** 2).sum(1))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
        """Index and squared distance of the nearest entry of each part (rows, width)."""
        if self.small and parts.dtype != object and (not parts.size or np.abs(parts).max() < self.limit):
            return self._nearest(parts)
        found = [self._nearest_huge(row) for row in parts.tolist()]
        return np.array([i for i, _ in found], np.int64), [d for _, d in found]

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        start = np.searchsorted(self.norms, norm)
        start = np.minimum(start, len(self.norms) - 1)
        below = np.maximum(start - 1, 0)
        start = np.where(norm - self.norms[below] < np.abs(self.norms[start] - norm), below, start)
        best = ((parts - self.table[start]) ** 2).sum(1)
        chosen, first, last = self.index[start], np.zeros_like(start), np.zeros_like(start)

        def narrow(rows: np.ndarray) -> None:
            # Floating point errs by far less than this slack, so that no entry at the very edge is missed.
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-9) + 1e-6 + norm[rows] * 1e-9
            first[rows] = np.searchsorted(self.norms, norm[rows] - reach, "left")
            last[rows] = np.searchsorted(self.norms, norm[rows] + reach, "right")

        narrow(np.arange(len(parts)))
        self.compared += len(parts)
        for step in range(1, len(self.norms)):
            for at in (start - step, start + step):
                rows = np.flatnonzero((at >= first) & (at < last))
                if not len(rows):
                    continue
                self.compared += len(rows)
                distance, entry = ((parts[rows] - self.table[at[rows]]) ** 2).sum(1), self.index[at[rows]]
                better = (distance < best[rows]) | ((distance == best[rows]) & (entry < chosen[rows]))
                rows = rows[better]
                best[rows], chosen[rows] = distance[better], entry[better]
                narrow(rows)
        return chosen, best

    def _nearest_huge(self, part: list[int]) -> tuple[int, int]:
        """The same in whole numbers of any size. Roots are rounded down: one is added on either side."""
        norm, norms = math.isqrt(sum(x * x for x in part)), self.whole_norms
        start = min(bisect_left(norms, norm), len(norms) - 1)
        measured = lambda at: (sum((x - y) ** 2 for x, y in zip(part, self.entries[self.order[at]])), self.order[at])
        best = measured(start)
        self.compared += 1
        for step in range(1, len(norms)):
            for at in (start - step, start + step):
                reach = math.isqrt(best[0]) + 2
                if bisect_left(norms, norm - reach) <= at < bisect_right(norms, norm + reach):
                    self.compared += 1
                    best = min(best, measured(at))
        return best[1], best[0]


Books = list[list[list[int]]]


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """(rows, components) of a batch of vectors of one length."""
    return batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), length)


def first_books(kept: DataFrame) -> tuple[Books, int]:
    """The codebooks to start from, and the vectors' length. kept: vec_id and vector."""
    ids = kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES)
    found = kept.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id")))
    rows = found.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("vec_id")).collect()
    length = len(rows[0]["vector"]) if rows else 0
    rows = [r["vector"] for r in rows if len(r["vector"]) == length]
    width = -(-length // PARTS)
    kind = np.float32 if dict(kept.dtypes)["vector"] == "array<float>" else np.float64
    start = to_parts(np.array(rows, kind).reshape(len(rows), length), width)
    return [[[int(x) for x in entry] for entry in start[:, p]] for p in range(PARTS)], length


def entry_sums(kept: DataFrame, books: Books, length: int) -> DataFrame:
    """part, entry, place, limb and value: sums of the parts assigned to an entry; at place -1 their number."""
    width = len(books[0][0])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annulus(b) for b in books]
        sums = np.zeros((PARTS, ENTRIES, width + 1), object)
        for b in batches:
            parts = to_parts(_vectors(b, length), width)
            for p, ring in enumerate(rings):
                chosen, _ = ring.nearest(parts[:, p])
                for e in np.unique(chosen).tolist():
                    own = parts[:, p][chosen == e]
                    small = own.dtype != object and (not own.size or np.abs(own).max() < 1 << 40)
                    sums[p, e, :width] += (own if small else own.astype(object)).sum(0).astype(object)
                    sums[p, e, width] += len(own)
        out = []
        for p, e, place in zip(*map(np.ndarray.tolist, np.nonzero(sums))):
            total, limb = int(sums[p, e, place]), 0
            sign, rest = (1, total) if total > 0 else (-1, -total)
            while rest:
                out.append((p, e, -1 if place == width else place, limb, sign * (rest & (1 << LIMB) - 1)))
                rest, limb = rest >> LIMB, limb + 1
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 4 + [pa.int64()])], ["part", "entry", "place", "limb", "value"])

    made = kept.select("vector").mapInArrow(mapped, "part int, entry int, place int, limb int, value long")
    return made.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def refined(kept: DataFrame, books: Books, length: int) -> Books:
    """The codebooks after one round: each entry the mean of its parts, rounded down; an unused entry stays."""
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for part, entry, place, limb, value in entry_sums(kept, books, length).collect():
        own = sums.setdefault((part, entry), {})
        own[place] = own.get(place, 0) + (value << LIMB * limb)
    mean = lambda own, width: [own.get(i, 0) // own[-1] for i in range(width)]
    return [[mean(sums[p, e], len(entry)) if (p, e) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encoded(kept: DataFrame, books: Books, length: int) -> DataFrame:
    """vec_id, label, code and error of each vector; code: the index of each part's entry, two hex digits each."""
    width = len(books[0][0])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annulus(b) for b in books]
        for b in batches:
            parts = to_parts(_vectors(b, length), width)
            found = [ring.nearest(parts[:, p]) for p, ring in enumerate(rings)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            small = all(isinstance(d, np.ndarray) and (not d.size or d.max() < 1 << 59) for _, d in found)
            errors = sum(d for _, d in found) if small else [min(sum(map(int, row)), LARGEST) for row in zip(*[d for _, d in found])]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(mapped, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, code and error of each row kept, and the codebooks."""
    kept = stored(kept_rows(rows, vector))
    books, length = first_books(kept)
    if not books[0]:
        kinds = dict(kept.dtypes)
        return kept.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books
    kept = kept.where(F.size("vector") == length)
    for _ in range(rounds):
        books = refined(kept, books, length)
    return encoded(kept, books, length), books


def vector_codes(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The contract's columns, one row per vector kept."""
    made, books = compress(rows, vector)
    made = stored(made)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = made.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    few = sums.count() <= BROADCAST_ROWS
    out = made.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in DuckDB's SQL, comparing every part with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
          list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (rid) WHERE e < {ENTRIES})""",
    ]

    def assign(n: int) -> str:
        distance = "list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""near{n} AS MATERIALIZED (SELECT rid, p, min({distance}::HUGEINT * {ENTRIES} + e) AS m FROM parts JOIN book{n} b USING (p) GROUP BY rid, p)"""

    for n in range(ROUNDS):
        steps.append(assign(n))
        steps.append(f"""book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(made.v, b.v) AS v FROM book{n} b LEFT JOIN (
          SELECT p, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY k) AS v FROM (
            SELECT p, e, k, sum(x) AS s, count(*) AS c FROM (
              SELECT p, m % {ENTRIES} AS e, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM parts JOIN near{n} USING (rid, p)) GROUP BY p, e, k)
          GROUP BY p, e) made USING (p, e))""")
    steps.append(assign(ROUNDS))
    steps.append(f"""coded AS (SELECT rid, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM book{ROUNDS})) AS codebooks_sha256
    FROM kept JOIN coded USING (rid)"""
