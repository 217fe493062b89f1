"""Language identification by rank-order profiles.

Texts are lower-cased in normal form C; all that is neither letter nor mark counts as a blank, runs of blanks as one,
and a blank stands at either end. The n-grams of one to three characters are counted, whole texts throughout, each as
one whole number (21 bits a character), so that equal grams are equal everywhere and ties have an order. A language's
profile lists its most frequent grams over all texts that are learned from; a document's lists its own. The out-of-place
distance sums, over the document's grams, how far their ranks lie apart, and PROFILE for a gram that the language's
profile lacks; the language with the least distance is predicted, of equal ones the first by name.

Grams are counted in each task, summed by language and gram, and ranked by partitions first, so that a language may hold
any share of all rows. Profiles alone reach the driver: PROFILE grams for each of at most LANGUAGES languages; a column
with more values holds something else, and is refused with a ValueError.

Edge cases: a null text, or one without a letter, is `und` with score 0; without learned languages all are; a null lang
or doc_id is not learned from, a null doc_id is not held out; repeated rows count each and are predicted alike; an empty
table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Grams of a profile, of a language or a document, and languages at most.
PROFILE, LANGUAGES = 400, 4096
#: Characters counted at once, of a long text; distinct grams that a task holds before it gives its sums out.
SLICE, HELD = 1_000_000, 1_000_000
UNKNOWN = "und"
_BLANK = 32


def held_out() -> Column:
    """True in the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _word_characters() -> np.ndarray:
    """Which code points are letters or marks; one table a process."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal grams added, grams ascending."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Grams and their counts, grams ascending; none for a text without a letter."""
    if not any(map(str.isalpha, text)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-32-le"), "<u4")
    points = np.concatenate(([_BLANK], np.where(_word_characters()[points], points, _BLANK), [_BLANK])).astype(np.int64)
    points = points[np.concatenate(([True], (points[1:] != _BLANK) | (points[:-1] != _BLANK)))]
    parts = []
    for start in range(0, len(points), SLICE):
        # Each slice counts the grams that begin in it.
        own = points[start : start + SLICE + 2]
        pairs = own[:-1] << 21 | own[1:]
        grams = np.concatenate((own[:SLICE][own[:SLICE] != _BLANK], pairs[:SLICE], (pairs[:-1] << 21 | own[2:])[:SLICE]))
        parts.append(np.unique(grams, return_counts=True))
    return parts[0] if len(parts) == 1 else _summed(parts)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent grams, by count; equal counts by gram. Grams come ascending."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all rows with a lang. docs: lang, text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        loose = held = 0

        def given_out() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                grams, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                grams, n = count_grams(text.as_py())
                sums.setdefault(lang.as_py(), []).append((grams, n))
                loose += len(grams)
                if loose > HELD:
                    for k, parts in sums.items():
                        sums[k] = [_summed(parts)]
                    loose, held = 0, sum(len(p[0][0]) for p in sums.values())
                    if held > HELD:
                        yield from given_out()
        yield from given_out()

    counted = docs.mapInArrow(mapped, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """lang, gram and rank (from 0) of each language's most frequent grams, learned from documents not held out."""
    learned = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    counts = gram_counts(learned.select(F.col("lang").cast("string").alias("lang"), "text"))
    order = [F.desc("n"), "gram"]
    # The best of sixteen shares first: what meets by language is sixteen profiles, not one of each task.
    share = Window.partitionBy("lang", "share").orderBy(*order)
    best = counts.withColumn("share", F.pmod(F.xxhash64("gram"), F.lit(16))).withColumn("at", F.row_number().over(share)).where(F.col("at") <= most)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < most).select("lang", "gram", "rank")


class Profiles:
    """Languages' profiles as one table: grams ascending, and of each gram the languages that list it, with its rank."""

    def __init__(self, rows: pa.Table, most: int = PROFILE):
        """rows: lang, gram and rank."""
        names, number = np.unique(np.array(rows["lang"].to_pylist(), str), return_inverse=True)
        grams, rank = (rows[c].to_numpy().astype(np.int64) for c in ("gram", "rank"))
        order = np.lexsort((number, grams))
        self.most, self.languages = most, names.tolist()
        self.grams, self.first, self.size = np.unique(grams[order], return_index=True, return_counts=True)
        self.language, self.rank = number[order].astype(np.int32), rank[order].astype(np.int32)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a document's ranked grams to each language."""
        at = np.searchsorted(self.grams, own)
        known = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == own)
        at = at[known]
        size = self.size[at]
        entry = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        apart = np.minimum(np.abs(self.rank[entry] - np.repeat(known, size)), self.most)
        spared = np.bincount(self.language[entry], self.most - apart, len(self.languages))
        return (len(own) * self.most - spared).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and one less the share of the greatest distance that there could be."""
        own = ranked(*count_grams(text or ""), self.most)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        found = self.distances(own)
        best = int(found.argmin())
        return self.languages[best], 1.0 - int(found[best]) / (len(own) * self.most)


def learn(docs: DataFrame, most: int = PROFILE, languages: int = LANGUAGES) -> Profiles:
    found = stored(profiles(docs, most))
    n = found.select("lang").distinct().count()
    if n > languages:
        raise ValueError(f"lang holds {n} values: more than {languages} languages")
    return Profiles(found.toArrow(), most)


def predict_languages(docs: DataFrame, known: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per document."""
    known = known or learn(docs)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [known.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(mapped, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
