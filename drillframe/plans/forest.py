"""Regression trees out of histograms, for rows whose features are cut into bins once.

Spark's own forest learner decodes, samples and bins all rows again at each call, which boosting makes a hundred times.
Here rows are a stored table of pieces: bins (a byte a feature), labels, and hashes that draw samples. A level of all
trees of a call is one pass: tasks add up their rows by node, feature and bin, histograms meet by node, and each node's
best split comes back as one row. A task holds a few pieces and the histograms of one level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative rank error of the cuts is one in this many.
ACCURACY = 10_000
#: Most rows of a piece.
PIECE = 1 << 14
ROWS = "bins binary, draws binary, labels binary, n long, _left double, is_validation boolean"
#: A label's sum and its number are added up in one double, the number above so many bits; labels are rounded to a
#: multiple of a power of two, 1 in 2 ** 22 of the piece's largest, so that both are exact.
_BITS = 37
_SPLIT = "slot int, gain double, feature int, cut int, n double, total double, n_low double, low double"


def cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Up to bins - 1 values of each feature, at even shares of the rows: a value is in the bin of the cuts below it."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY) for c in features]).first()
    return [sorted(set(values or ())) for values in found]


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """Pieces of up to PIECE rows, either all for validation or none: bins (a byte a row, feature by feature), draws and
    labels as bytes, n (rows) and _left, the root of the mean square of labels. df: the features, _draw (a hash of the row),
    _left (the label), is_validation. A feature that is null or NaN is an error."""

    def piece(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], held: bool) -> pa.RecordBatch:
        x, draw, left = (np.concatenate(p, axis=-1) for p in zip(*parts))
        return _pieces([(x.tobytes(), draw.tobytes(), left, held)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts, counts = {True: [], False: []}, {True: 0, False: 0}
        for batch in batches:
            x = np.empty((len(edges), batch.num_rows), np.uint8)
            for i, at in enumerate(edges):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                if np.isnan(values).any():
                    raise ValueError(f"feature {features[i]} is null or NaN")
                x[i] = np.searchsorted(at, values)
            draw, left, flags = (batch.column(len(edges) + i).to_numpy(zero_copy_only=False) for i in range(3))
            for held in (True, False):
                mine = np.flatnonzero(flags == held)
                for start in range(0, len(mine), PIECE // 2):
                    some = mine[start : start + PIECE // 2]
                    if counts[held] + len(some) > PIECE:
                        yield piece(open_parts[held], held)
                        open_parts[held], counts[held] = [], 0
                    open_parts[held].append((x[:, some], draw[some], left[some]))
                    counts[held] += len(some)
        for held, parts in open_parts.items():
            if parts:
                yield piece(parts, held)

    named = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    return df.select(*named, "_draw", "_left", "is_validation").mapInArrow(cut, ROWS)


def _pieces(made: Sequence[tuple[bytes, bytes, np.ndarray, bool]]) -> pa.RecordBatch:
    x, draw, left, held = zip(*made)
    columns = [pa.array(x, pa.binary()), pa.array(draw, pa.binary()), pa.array([v.tobytes() for v in left], pa.binary())]
    columns += [pa.array([len(v) for v in left], pa.int64()), pa.array([float(np.sqrt(np.mean(v**2))) for v in left]), pa.array(held, pa.bool_())]
    return pa.record_batch(columns, ["bins", "draws", "labels", "n", "_left", "is_validation"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Bins (a row a feature), draws, labels and whether they are for validation, piece by piece."""
    for batch in batches:
        for x, draw, left, held in zip(*(batch.column(c) for c in ("bins", "draws", "labels", "is_validation"))):
            left = np.frombuffer(left.as_buffer())
            yield np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, len(left)), np.frombuffer(draw.as_buffer(), np.int64), left, held.as_py()


def _drawn(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree samples, by their hashes mixed with its seed."""
    x = draw.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (1 << 64)) if share < 1 else (1 << 64) - 1)


@dataclass
class Tree:
    """Nodes in an array, those below node i at 2 i + 1 and 2 i + 2. feature is -1 in leaves; rows whose bin is above the
    cut go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n), np.zeros(n))

    def node_of(self, x: np.ndarray, steps: int) -> np.ndarray:
        """The node that each row is in after so many steps, those below a leaf to the left of it."""
        at, row, width = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1]), x.shape[1]
        place, cut, flat = np.maximum(self.feature, 0).astype(np.int64) * width, np.where(self.feature < 0, 255, self.cut), x.reshape(-1)
        for _ in range(steps):
            at = 2 * at + 1 + (flat.take(place.take(at) + row) > cut.take(at))
        return at

    def ended(self) -> Tree:
        """With each leaf's value in the nodes below it, to the left."""
        for i in range(len(self.feature) // 2):
            if self.feature[i] < 0:
                self.value[2 * i + 1] = self.value[i]
        return self


@dataclass
class RandomForestRegressor:
    """Trees on samples of rows without replacement, each node's split chosen among a share of the features."""

    width: int
    maxBins: int
    maxDepth: int
    minInstancesPerNode: int
    numTrees: int
    seed: int
    subsamplingRate: float = 0.8
    featureShare: float = 0.8

    def getSeed(self) -> int:
        return self.seed

    def getNumTrees(self) -> int:
        return self.numTrees

    def fit(self, rows: DataFrame) -> list[Tree]:
        """rows: pieces as binned() gives them."""
        trees = [Tree.of_depth(self.maxDepth) for _ in range(self.numTrees)]
        rows, slots = rows.select("bins", "draws", "labels", "is_validation"), [(t, 0) for t in range(self.numTrees)]
        for level in range(self.maxDepth):
            found = self._sums(rows, trees, level, slots).groupBy("slot").applyInArrow(self._best(slots), _SPLIT).collect()
            below = []
            for r in sorted(found):
                t, node = slots[r.slot]
                tree = trees[t]
                if level == 0:
                    tree.value[0], tree.rows[0] = r.total / r.n, r.n
                if r.feature < 0:
                    continue
                tree.feature[node], tree.cut[node], tree.gain[node] = r.feature, r.cut, r.gain
                for side, n, total in ((1, r.n_low, r.low), (2, r.n - r.n_low, r.total - r.low)):
                    tree.value[2 * node + side], tree.rows[2 * node + side] = total / n, n
                    if n >= 2 * self.minInstancesPerNode:
                        below.append((t, 2 * node + side))
            if not below:
                break
            slots = below
        return [tree.ended() for tree in trees]

    def _sums(self, rows: DataFrame, trees: list[Tree], level: int, slots: list[tuple[int, int]]) -> DataFrame:
        """Numbers and sums of labels by node (its slot), feature and bin, one row a node and task."""
        width, bins, seed, share, n_slots = self.width, self.maxBins, self.seed, self.subsamplingRate, len(slots)
        own = [np.full(len(tree.feature), -1) for tree in trees]
        for slot, (t, node) in enumerate(slots):
            own[t][node] = slot
        # A tree's slots are consecutive; rows in none of them are counted in one more.
        first = [min((s for s, (u, _) in enumerate(slots) if u == t), default=0) for t in range(len(trees))]
        many = [sum(u == t for u, _ in slots) for t in range(len(trees))]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, met, one = np.zeros((n_slots, 2, width, bins)), False, 2.0**_BITS
            for x, draw, left, _ in _read(batches):
                met, unit = True, 2.0 ** (np.ceil(np.log2(max(np.abs(left).max(), 1e-200))) - 22)
                packed = np.rint(left / unit) + one
                for t, tree in enumerate(trees):
                    if not many[t]:
                        continue
                    slot = own[t][tree.node_of(x, level)]
                    base = np.where((slot >= 0) & _drawn(draw, seed + t, share), slot - first[t], many[t]) * bins
                    into, size = sums[first[t] : first[t] + many[t]], (many[t] + 1) * bins
                    for i in range(width):
                        both = np.bincount(base + x[i], packed, size)[:-bins].reshape(-1, bins)
                        n = np.rint(both / one)
                        into[:, 0, i] += n
                        into[:, 1, i] += (both - n * one) * unit
            if met:
                yield pa.record_batch([pa.array(range(n_slots), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["slot", "sums"])

        return rows.mapInArrow(add, "slot int, sums binary")

    def _best(self, slots: list[tuple[int, int]]):
        """The split of a node that lowers the variance most, of those that leave rows enough on both sides."""
        width, bins, seed, least, share = self.width, self.maxBins, self.seed, self.minInstancesPerNode, self.featureShare

        def best(table: pa.Table) -> pa.Table:
            slot = table.column("slot")[0].as_py()
            n, total = sum(np.frombuffer(s.as_buffer()).reshape(2, width, bins) for s in table.column("sums"))
            t, node = slots[slot]
            asked = np.random.default_rng([seed + t, node]).permutation(width)[: ceil(share * width)]
            n_low, low = np.cumsum(n, axis=1), np.cumsum(total, axis=1)
            rows, whole = n_low[0, -1], low[0, -1]
            n_high, high = rows - n_low, whole - low
            may = np.zeros(n.shape, bool)
            may[asked] = (n_low[asked] >= least) & (n_high[asked] >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(may, (low**2 / n_low + high**2 / n_high - whole**2 / rows) / rows, 0.0)
            i, j = np.unravel_index(np.argmax(gain), gain.shape)
            found = [slot, gain[i, j], i if gain[i, j] > 0 else -1, j, rows, whole, n_low[i, j], low[i, j]]
            names = [c.split()[0] for c in _SPLIT.split(", ")]
            kinds = [pa.int32() if c.endswith(" int") else pa.float64() for c in _SPLIT.split(", ")]
            return pa.table([pa.array([v], k) for v, k in zip(found, kinds)], names)

        return best


def less(rows: DataFrame, trees: Sequence[Tree], rate: float) -> DataFrame:
    """rows with labels less `rate` of what each tree says."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, draw, left, held in _read(batches):
            said = sum(tree.value[tree.node_of(x, len(tree.feature).bit_length() - 1)] for tree in trees)
            yield _pieces([(x.tobytes(), draw.tobytes(), left - rate * said, held)])

    return rows.mapInArrow(take, ROWS)


def mean_square(rows: DataFrame) -> float | None:
    return rows.agg(F.sum(F.col("_left") ** 2 * F.col("n")) / F.sum("n")).first()[0]
