"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) give the base spans, by searches that are linear in the text. The field looks at
islands, runs of tokens that hold a digit, an at-sign or a written-out one, cut into units (letters and digits, single
other characters). A candidate segment is up to MAX_UNITS units; features of the whole span (counts, groups, checksum,
shape, what stands around it) are weighed for each type, and dynamic programming over the island chooses boundaries and
types together: its cost is the number of units times MAX_UNITS. Weights are trained here by conditional likelihood.

What the patterns find needs no field. It is trained on what they miss: numbers without a country code, in other
groupings or with other signs between; cards and numbers that run into further digits; addresses with a written-out
at-sign; internet addresses of version 6 or with bracketed dots. These are made up (pii_forms), as are numbers that are
none of these: dates, prices, versions, serial numbers, cards with a wrong checksum. A bounded sample of islands of the
corpus (SAMPLE_ROWS texts, SAMPLE_ISLANDS of each and ISLAND_CHARS characters of those) is added, with the base spans as
the truth. Spans that the field finds and that overlap no base span are added.

Edge cases: a null text counts as empty; an empty text has no spans, and the digest of no spans is that of the empty
string; repeated rows are searched alike and each keeps its row; an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_forms
from .common import plain_text

KINDS = ("email", "ip", "card", "phone")
#: Most texts that islands are taken from, most islands of a text and most characters of an island; made-up examples of
#: what is to be found and of what isn't, each.
SAMPLE_ROWS, SAMPLE_ISLANDS, ISLAND_CHARS, FORMS = 1000, 4, 200, 2000
MAX_UNITS, ROUNDS, STEP, PULL = 24, 100, 0.25, 1e-4
#: What a segment must score above the same units left out; keeps doubtful spans out.
MARGIN = 1.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_MARK = r"(?:@|[\[({](?:at|dot)[\])}])"
_ACTIVE = re.compile(rf"[0-9]|{_MARK}", re.IGNORECASE)
_LEADS, _TRAILS = re.compile(_MARK, re.IGNORECASE), re.compile(rf"{_MARK}$", re.IGNORECASE)
_UNIT = re.compile(r"[0-9A-Za-z]+|(?s:.)")
_BLANK = re.compile(r"[ \t-\r]")
#: What may stand between two tokens of an island.
_GAP = re.compile(r" {1,2}| [-–./] ")
_DIGITS = re.compile(r"[0-9]+")
_SPACES = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign can close only the run of local characters before it, after the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    found = [(s, e, 0) for s, e in _emails(text)]
    for m in _CHAIN.finditer(text) if "." in text else ():
        parts = list(_DIGITS.finditer(m[0])) if "." in m[0] else []
        for i in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-4:]) <= 255 for p in parts[i : i + 4]):
                found.append((m.start() + parts[i].start(), m.start() + parts[i + 3].end(), 1))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _token_before(text: str, at: int, free: int) -> int:
    """Where the token begins that ends one blank before `at`, or `at` if there is none after `free`."""
    if at - 1 <= free or text[at - 1] != " " or text[at - 2] in _SPACES:
        return at
    return max(free, max(text.rfind(c, free, at - 1) for c in _SPACES) + 1)


def _token_after(text: str, at: int) -> int:
    """Where the token ends that begins one blank after `at`, or `at`."""
    if text[at : at + 1] != " " or text[at + 1 : at + 2] in (*_SPACES, ""):
        return at
    found = _BLANK.search(text, at + 1)
    return found.start() if found else len(text)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens with a digit or at-sign, a blank or two or a single sign apart; a token that begins or ends with an at-sign (or one
    written out, or a dot written out) takes its neighbour along."""
    free, m = 0, _ACTIVE.search(text)
    start = stop = -1
    while m:
        left = max(free, max(text.rfind(c, free, m.start()) for c in _SPACES) + 1)
        if _LEADS.match(text, left):
            left = _token_before(text, left, free)
        found = _BLANK.search(text, m.end())
        right = found.start() if found else len(text)
        if _TRAILS.search(text, max(left, right - 6), right):
            right = _token_after(text, right)
        if stop >= 0 and (left <= stop or left - stop <= 3 and _GAP.fullmatch(text, stop, left)):
            stop = right
        else:
            if stop >= 0:
                yield start, stop
            start, stop = left, right
        free = right
        m = _ACTIVE.search(text, right)
    if stop >= 0:
        yield start, stop


#: Tests of a span, and buckets for its shape.
N_TESTS, N_SHAPES = 41, 512
N_FEATURES = N_TESTS + N_SHAPES
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_ONWARD = re.compile(r"\.[0-9A-Za-z]| ?[\[({] ?dot", re.IGNORECASE)
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+")
_DOTTED = re.compile(r"[0-9]{1,3}(?: ?(?:\.|[\[({]\.[\])}]|[\[({]dot[\])}]) ?[0-9]{1,3}){3}")


def _shape(span: str) -> str:
    """Digit groups as their lengths, letters as one a, other characters as they are."""
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: chr(0x100 + min(len(m[0]), 40)), span))


_LETTERS = re.compile(r"[A-Za-z]+")


#: Characters of a span whose features are remembered: a unit of a longer one, such as a number of a thousand digits, is rare.
REMEMBERED_SPAN = 120


def span_features(span: str, before: str, after: str) -> tuple[int, ...]:
    """Indexes of the features that hold for a whole span, given the character before it and the five after it."""
    return (_short_span if len(span) <= REMEMBERED_SPAN else _features)(span, before, after)


def _features(span: str, before: str, after: str) -> tuple[int, ...]:
    found = _DIGITS.findall(span)
    groups, digits = [len(g) for g in found], "".join(found)
    n, letters, dots, colons = len(digits), sum(c.isalpha() for c in span), span.count("."), span.count(":")
    at, blanks = bool(_AT.search(span)), span.count(" ")
    signs = {c for c in span if not c.isalnum() and c not in " ()+"}
    tests = (
        True, at, letters == 0, letters > 0, dots == 0, dots == 3, 0 < dots < 3 or dots > 3,
        n < 7, 7 <= n <= 8, n == 9, n == 10, n == 11, 12 <= n <= 13, 14 <= n <= 19, n > 19,
        span[0] == "+", span[0] == "(", span[0] == "0", span[:2] == "00",
        n >= 14 and letters == 0 and luhn(digits), 14 <= n <= 19 and letters == 0 and not luhn(digits),
        bool(_DOTTED.fullmatch(span)) and all(int(g) <= 255 for g in found), bool(_SIX.fullmatch(span)),
        groups[-3:] == [3, 3, 4], n >= 14 and set(groups) == {4}, len(groups) == 1, len(groups) > 5, set(groups) == {2} and len(groups) == 5,
        blanks > 0, "-" in signs, "(" in span and ")" in span and ")" in span[span.find("(") :], "/" in signs, len(signs) > 1,
        bool(_EMAIL.fullmatch(span)), bool(_WRITTEN.fullmatch(span)), colons > 0,
        before.isalnum() or before in tuple("@+-(.:/,_%"), after[:1].isalnum() or after[:1] in tuple("@-:/_"),
        before == " " or before == "", after[:1] in ("", *" .,;)!?"), at and bool(_ONWARD.match(after)),
    )
    shape = N_TESTS + zlib.crc32(_shape(span).encode()) % N_SHAPES
    return (*[i for i, t in enumerate(tests) if t], shape)


_short_span = lru_cache(maxsize=50_000)(_features)


def _candidates(text: str, start: int, stop: int) -> tuple[list[int], list[tuple[int, int, tuple[int, ...]]]]:
    """Unit boundaries of an island, and its candidate segments with their features."""
    cuts = [start, *[start + m.end() for m in _UNIT.finditer(text[start:stop])]]
    first = [text[c : c + 1] for c in cuts]
    digits = [0, *accumulate(sum(map(str.isdigit, text[i:j])) for i, j in zip(cuts, cuts[1:]))]
    marks = [0, *accumulate(text[i:j] == "@" or text[i:j].lower() == "at" for i, j in zip(cuts, cuts[1:]))]
    colons = [0, *accumulate(text[i:j] == ":" for i, j in zip(cuts, cuts[1:]))]
    out = []
    for i in range(len(cuts) - 1):
        if not (first[i].isalnum() and first[i].isascii() or first[i] in "+("):
            continue
        for j in range(i + 1, min(i + MAX_UNITS, len(cuts) - 1) + 1):
            end = text[cuts[j] - 1]
            if cuts[j] - cuts[i] < 7 or not (end.isalnum() and end.isascii()):
                continue
            mark, written = marks[j] > marks[i], colons[j] - colons[i] > 1
            if not mark and not written and (end.isalpha() or digits[j] - digits[i] < 4):
                continue
            out.append((i, j, span_features(text[cuts[i] : cuts[j]], text[cuts[i] - 1 : cuts[i]] if cuts[i] else "", text[cuts[j] : cuts[j] + 5])))
    return cuts, out


class SemiMarkov:
    """Weights of (type, feature); a unit outside any segment scores zero."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights

    def _scored(self, segments) -> np.ndarray:
        return np.array([self.weights[:, list(f)].sum(axis=1) for _, _, f in segments]).reshape(-1, len(KINDS))

    def decode(self, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
        """The best segmentation of an island: spans (start, end, kind)."""
        cuts, segments = _candidates(text, start, stop)
        if not segments:
            return []
        scored = self._scored(segments)
        kinds, scores = scored.argmax(axis=1), scored.max(axis=1) - MARGIN
        ending: dict[int, list[int]] = {}
        for k in np.flatnonzero(scores > 0):
            ending.setdefault(segments[k][1], []).append(int(k))
        best, via = [0.0], [-1]
        for j in range(1, len(cuts)):
            top, by = best[j - 1], -1
            for k in ending.get(j, ()):
                if best[segments[k][0]] + scores[k] > top:
                    top, by = best[segments[k][0]] + scores[k], k
            best.append(top)
            via.append(by)
        out, j = [], len(cuts) - 1
        while j > 0:
            if via[j] < 0:
                j -= 1
            else:
                i = segments[via[j]][0]
                out.append((cuts[i], cuts[j], int(kinds[via[j]])))
                j = i
        return out[::-1]

    def train(self, examples: list[tuple[str, list[tuple[int, int, int]]]]) -> SemiMarkov:
        """Ascent on the conditional likelihood, all islands at once. examples: text and its true spans."""
        size, place, own, true, features = [], [], [], [], []
        for text, truth in examples:
            for start, stop in islands(text):
                cuts, segments = _candidates(text, start, stop)
                at = {(cuts[i], cuts[j]): k for k, (i, j, _) in enumerate(segments)}
                if not segments:
                    continue
                true += [(len(place) + at[s, e], kind) for s, e, kind in truth if (s, e) in at]
                place += [(i, j) for i, j, _ in segments]
                features += [f for _, _, f in segments]
                own += [len(size)] * len(segments)
                size.append(len(cuts))
        if not size:
            return self
        flat = np.concatenate([np.array(f) for f in features])
        lengths = np.array([len(f) for f in features])
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        i, j = np.array(place).T
        truth = np.zeros((len(KINDS), len(features)))
        for k, kind in true:
            truth[kind, k] = 1
        mean, spread = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for turn in range(1, ROUNDS + 1):
            scores = np.add.reduceat(self.weights[:, flat], offsets, axis=1)
            away = truth - self._marginals(np.array(size), np.array(own), i, j, scores)
            slope = np.stack([np.bincount(flat, np.repeat(a, lengths), N_FEATURES) for a in away]) / len(size) - PULL * self.weights
            mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
            self.weights += STEP * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        return self

    @staticmethod
    def _marginals(size: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Probability of each (type, segment), by the forward and backward sums over boundaries of all islands.

        size: boundaries of each island. own, starts, ends: island and boundaries of each segment; scores by type.
        """
        islands, most, longest = len(size), int(size.max()), int((ends - starts).max())
        total = np.logaddexp.reduce(scores, axis=0)
        table = np.full((most, longest + 1, islands), -np.inf)
        table[ends, ends - starts, own] = total
        ahead, back = np.full((most, islands), -np.inf), np.full((most, islands), -np.inf)
        ahead[0], back[size - 1, np.arange(islands)] = 0.0, 0.0
        add = lambda rows: np.logaddexp.reduce(rows, axis=0)
        for j in range(1, most):
            n = min(j, longest)
            ahead[j] = np.logaddexp(ahead[j - 1], add(ahead[j - n : j][::-1] + table[j, 1 : n + 1]))
        for i in range(most - 2, -1, -1):
            n = min(most - 1 - i, longest)
            steps = np.arange(1, n + 1)
            back[i] = np.logaddexp(back[i], np.logaddexp(back[i + 1], add(back[i + 1 : i + n + 1] + table[i + steps, steps])))
        whole = ahead[size - 1, np.arange(islands)]
        return np.exp(np.clip(ahead[starts, own] + scores + back[ends, own] - whole[own], -60, 0))


def sampled_islands(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_ISLANDS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Islands with their base spans, of at most `rows` texts that hold a digit or an at-sign, chosen by a hash of the
    row. Whole texts stay on the executors."""
    active = docs.select(plain_text().alias("text"), F.xxhash64("doc_id", "text").alias("rank")).where(F.col("text").rlike("[0-9@]"))
    last = active.select("rank").orderBy("rank").limit(rows).agg(F.max("rank")).first()[0]
    if last is None:
        return []

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for t, r in zip(b["text"].to_pylist(), b["rank"].to_pylist()) for x in short_islands(t, r, most)]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.list_(pa.int32())) for c in columns[2:]]], ["rank", "island", "starts", "ends", "kinds"])

    # Only repeated rows share a rank; of those, any will do.
    chosen = active.where(F.col("rank") <= last).limit(rows).mapInArrow(mapped, "rank long, island string, starts array<int>, ends array<int>, kinds array<int>").collect()
    chosen.sort(key=lambda r: (r["rank"], r["island"], r["starts"]))
    return [(r["island"], list(zip(r["starts"], r["ends"], r["kinds"]))) for r in chosen]


def short_islands(text: str, rank: int, most: int) -> list[tuple]:
    """rank, island and its base spans, of the first `most` short islands of a text. One without base spans counts only if no
    two groups of digits in it stand side by side: else it may hold what the patterns miss."""
    base, out = base_spans(text), []
    for start, stop in islands(text):
        if stop - start <= ISLAND_CHARS and len(out) < most:
            own = [(s - start, e - start, k) for s, e, k in base if start <= s and e <= stop]
            if own or not re.search(r"[0-9][^0-9A-Za-z]+[0-9]", text[start:stop]):
                out.append((rank, text[start:stop], *[list(c) for c in zip(*own)]) if own else (rank, text[start:stop], [], [], []))
    return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> SemiMarkov:
    """A field trained on made-up forms and on a bounded sample of islands of the corpus."""
    return SemiMarkov().train([*pii_forms.examples(FORMS), *sampled_islands(docs, rows)])


def all_spans(text: str, field: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added ones together."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    added = []
    for start, stop in islands(text):
        for s, e, kind in field.decode(text, start, stop):
            before = bisect_left(starts, e)
            if not before or reach[before - 1] <= s:
                added.append((s, e, kind))
    return base, sorted(base + added, key=lambda x: (x[0], x[2]))


def find_pii(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """The contract's columns, one row per document."""
    weights = (field or fit(docs)).weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkov(weights)
        listed = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)
        for b in batches:
            counts, digests, every = [], [], []
            for x in b["text"]:
                base, both = all_spans(x.as_py(), own)
                counts.append([sum(k == n for _, _, k in base) for n in range(4)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(both))
            numbers = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(mapped, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
