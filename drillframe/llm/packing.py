"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Every document is tokenised once where it lies and cut into pieces of at most the capacity. What packing needs of the
corpus is the number of pieces of each length, a table with no more rows than the capacity, whatever the input. From
it the driver makes a recipe: a list of (lengths in one sequence, times). A sequence is opened with the longest length
left; indexes of single, pair and triple length sums, checked against the counts that remain, fill its gap exactly;
where no combination does, the longest length that fits goes in (best fit) and the rest of the gap is tried again.
Each entry is used as often as the counts allow, which exhausts a length, so a recipe has a few entries per length.
Pieces then take the recipe's places by their rank among equal lengths. Ranks come from counts of hashed cells and
row numbers within a cell, so that a length, or a row, that any part of the corpus repeats is spread over many tasks.

Edge cases: a null text counts as empty; an empty text is the end id alone; repeated rows are packed once each; ids
may be null or repeated; an empty table gives an empty result; further columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import plain_text, stored

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of words and ids that a worker remembers, of the objects about each as well; beyond, it starts anew. Longer words
#: than WORD characters are not remembered.
REMEMBERED_BYTES, OBJECTS, WORD = 160 << 20, 170, 100
#: Pieces in a cell of the ranking.
CELL = 65_536


class WordIds(dict):
    """Lower-cased word without white space -> its ids as little-endian bytes, encoded when first met.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words. Words of Latin
    letters go straight to the tokenizer's model; others, and texts that lower-casing, normal form or special tokens
    make depend on context, through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        spec = json.load(open(path))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shifted = iter(range(256, 512))
        self.byte_char = {b: chr(b) if b in printable else chr(next(shifted)) for b in range(256)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word[-1] in ".," and word[-2:-1].isalpha():
            found = self[word[:-1]] + self[word[-1]]
        elif word.isascii() or max(word) < "ɐ":
            parts = [word] if word.isalpha() else self.split.findall(word)
            # Printable ASCII stands for itself; control characters have others in their place, as all bytes beyond have.
            ids = [t.id for p in parts for t in self.model.tokenize(p if p.isascii() and p.isprintable() else "".join(map(self.byte_char.__getitem__, p.encode())))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = self.whole(word)
        if len(word) <= WORD:
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self[word] = found
            self.held += OBJECTS + len(word) + len(found)
        return found

    def encode(self, text: str) -> bytes:
        odd = "Σ" in text or "İ" in text or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not unicodedata.is_normalized("NFC", text)
        return self.whole(text) if odd else b"".join(map(self.__getitem__, text.lower().split()))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash, piece, start, length, ids_crc32 and nth of each piece of each document; nth counts the rows of
    a task, so that equal rows differ in it."""
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), plain_text().alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = word_ids(path), 0
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b["text"]):
                ids = known.encode(text.as_py()) + end
                for k in range(0, len(ids), capacity * 4):
                    part = ids[k : k + capacity * 4]
                    at.append(i)
                    piece.append(k // (capacity * 4))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            nth = np.arange(seen, seen + len(at), dtype=np.int64)
            seen += len(at)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(at), b["text_hash"].take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(nth)],
                ["doc_id", "text_hash", "piece", "start", "length", "ids_crc32", "nth"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(mapped, f"doc_id {kind}, text_hash long, piece int, start long, length long, ids_crc32 long, nth long")


class Complements:
    """Indexes of single, pair and triple length sums, under counts that only fall. counts is shared with the caller.

    Pairs of lengths lie sorted by their sum, and of each sum the first that may still be used is kept: a pair of which
    a length has run out never comes back. A triple is a length and a pair of the rest; of each sum the first such
    length that may still do is kept likewise. What a sequence has taken already (`used`) is passed over, not dropped.
    """

    def __init__(self, counts: list[int]):
        self.counts, self.asked = counts, 0
        capacity = len(counts) - 1
        self.lengths = np.flatnonzero(counts)[::-1].tolist()
        there = np.flatnonzero(counts)
        upto = np.searchsorted(there, np.minimum(there, capacity - there), "right")
        high = np.repeat(there, upto)
        low = there[np.arange(len(high)) - np.repeat(np.cumsum(upto) - upto, upto)]
        order = np.argsort((high + low).astype(np.int32), kind="stable")
        self.high = high[order][::-1].astype(np.int32)
        totals = (high + low)[order]
        edges = np.searchsorted(totals, np.arange(capacity + 2), "left")
        #: Of each sum: the place of the first pair that may do, and the place behind its last.
        self.first = (len(high) - edges[1:]).tolist()
        self.end = (len(high) - edges[:-1]).tolist()
        #: Of each sum: the place in `lengths` of the first largest member of a triple that may do.
        self.first_high = [0] * (capacity + 1)

    def _left(self, length: int, used: Counter) -> int:
        return self.counts[length] - used[length]

    def _forget(self) -> None:
        """Leaves lengths out that have run out, once they are a tenth of all."""
        self.asked += 1
        if self.asked * 10 > len(self.lengths):
            self.asked, counts = 0, self.counts
            if sum(not counts[x] for x in self.lengths) * 10 > len(self.lengths):
                self.lengths = [x for x in self.lengths if counts[x]]
                self.first_high = [0] * len(counts)

    def pair(self, total: int, used: Counter) -> tuple[int, int] | None:
        counts, leading, end = self.counts, True, self.end[total]
        for at in range(self.first[total], end, 32):
            for i, a in enumerate(self.high[at : min(at + 32, end)].tolist(), at):
                b = total - a
                need = 2 if a == b else 1
                if counts[a] < need or counts[b] < need:
                    if leading:
                        self.first[total] = i + 1
                    continue
                leading = False
                if self._left(a, used) >= need and self._left(b, used) >= need:
                    return a, b
        return None

    def triple(self, total: int, used: Counter) -> tuple[int, int, int] | None:
        leading, counts, first, end = True, self.counts, self.first, self.end
        self._forget()
        for i in range(self.first_high[total], len(self.lengths)):
            high = self.lengths[i]
            if 3 * high < total:
                break
            rest = total - high
            gone = rest < 2 or not counts[high] or first[rest] >= end[rest]
            if not gone and self._left(high, used) > 0 and (found := self.pair(rest, used + Counter([high]))):
                return high, *found
            if leading and (gone or first[rest] >= end[rest]):
                self.first_high[total] = i + 1
            else:
                leading = False
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if self._left(gap, used) > 0:
            return (gap,)
        return self.pair(gap, used) or self.triple(gap, used)

    def best_fit(self, gap: int, used: Counter) -> int | None:
        at = bisect_left(self.lengths, -gap, key=lambda x: -x)
        return next((x for x in islice(self.lengths, at, None) if self._left(x, used) > 0), None)


def recipe(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, times) for all pieces of the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    index, made = Complements(counts), []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            used, gap = Counter([longest]), capacity - longest
            while gap:
                filled = index.exact(gap, used)
                if filled is None:
                    best = index.best_fit(gap, used)
                    filled = () if best is None else (best,)
                used.update(filled)
                gap -= sum(filled)
                if not filled:
                    break
            times = min(int(counts[x]) // n for x, n in used.items())
            for x, n in used.items():
                counts[x] -= n * times
            made.append((tuple(sorted(used.elements(), reverse=True)), times))
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Recipe as intervals of ranks, sorted: key (length and first rank), first rank, first sequence, offset."""
    taken, out, sequence = Counter(), [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            out.append(((x << 48) + taken[x], taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(4))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The contract's columns, one row per piece."""
    cut = stored(pieces(docs, path, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    key, first, sequence, offset = places(recipe(histogram, capacity))
    cells = max(16, min(sum(histogram.values()) // CELL, 65_536))
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_hash", "piece", "nth"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "cell").orderBy("doc_id", "text_hash", "piece", "nth")
    ranked = cut.join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            put = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *put], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(mapped, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
