"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two token sequences over the same bytes are read side by side. The state is the side that leads and the bytes of its last
token that the other side has not matched yet. The other side's next token either stays within them, or ends with them,
which closes a group, or goes beyond, and then leads itself. Every token that is read while the other side leads overlaps
the leader's last token: that is a link. Transitions are remembered by leader, residual and next token.

Both tokenizers treat a run of blanks and line feeds with what follows it up to the next run alike wherever it stands,
as no token of either reaches from a character that isn't white space over the blank or line feed behind it; both sides
end there, with an empty residual. Such units are tokenised and run through the transducer when first met, and remembered
as far as memory allows; texts with a unit that either tokenizer alters are tokenised whole. Which way is taken makes no
difference in the result (tested against whole texts).

How many documents hold a pair is counted over all documents. The most frequent pairs, at most TOP, are then looked up in
each task; the links of rarer ones, if there are any, meet their counts in a shuffle. Such a pair stands in few
documents: no key is hot, whatever the corpus. Long texts are done in their task, a step a token.

Edge cases: a null or empty text has no tokens, nor has one whose tokens' bytes are not those of a blank and the text
(U+2581 is one that the second tokenizer reads as a blank): its counts are 0 and its groups ''; special tokens' strings
are plain text; repeated rows count each in the documents of a pair; an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of units that a worker remembers, of the objects about each as well, and characters of a unit that is remembered.
REMEMBERED_BYTES, OBJECTS, LONGEST_UNIT = 160 << 20, 330, 120
#: Transitions that a worker remembers; beyond, it starts anew. A residual is shorter than a token.
TRANSITIONS = 500_000
#: Characters of texts that are done together.
GROUP = 2_000_000
#: Pairs whose counts each task looks up.
TOP = 1 << 20


class Transducer:
    """Aligns ids of two vocabularies, given the bytes of each id. A state is the side that leads (0 or 1) and its residual;
    states have numbers, 0 is that of the empty residual."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.sides = first, second
        self._forget()

    def _forget(self) -> None:
        self.number, self.states, self.leads = {}, [(0, b"")], [0]
        #: From a token of the first side with nothing behind it, and from state << 32 | token of the side that is behind.
        self.begun: dict[int, int] = {}
        self.known: dict[int, int] = {}
        #: The text of a group of one token each, by its link: from the empty residual to it in one step.
        self.at_once: dict[int, str] = {}

    def _numbered(self, leader: int, residual: bytes) -> int:
        if not residual:
            return 0
        found = self.number.get((leader, residual))
        if found is None:
            found = self.number[leader, residual] = len(self.states)
            self.states.append((leader, residual))
            self.leads.append(leader)
        return found

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that is behind; -1 if its bytes differ, or if it has none."""
        leader, residual = self.states[state]
        more = self.sides[1 - leader][token]
        if more and residual.startswith(more):
            return self._numbered(leader, residual[len(more) :])
        return self._numbered(1 - leader, more[len(residual) :]) if more.startswith(residual) else -1

    def align(self, a: list[int], b: list[int]) -> tuple[str, int, list[int]] | None:
        """Groups as text, their number, and the links, first id << 32 | second id; None if the bytes differ."""
        if len(self.known) + len(self.at_once) > TRANSITIONS:
            self._forget()
        begun, known, leads, at_once = self.begun, self.known, self.leads, self.at_once
        groups, links, state, last, leader, token = [], [], 0, 0, 0, 0
        size_a, size_b = len(a), len(b)
        for first, second in zip(a, b):
            link = first << 32 | second
            text = at_once.get(link)
            if text is None:
                break
            groups.append(text)
            links.append(link)
        from_i = from_j = i = j = len(links)
        while True:
            if not state:
                if i > from_i:
                    if i - from_i == 1 and j - from_j == 1:
                        text = at_once[links[-1]] = f"{a[from_i]}|{b[from_j]}"
                    else:
                        text = f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}"
                    groups.append(text)
                while i < size_a and j < size_b:
                    link = a[i] << 32 | b[j]
                    text = at_once.get(link)
                    if text is None:
                        break
                    groups.append(text)
                    links.append(link)
                    i += 1
                    j += 1
                from_i, from_j = i, j
                if i == size_a:
                    return (";".join(groups), len(groups), links) if j == size_b else None
                last = a[i]
                i += 1
                state = begun.get(last)
                if state is None:
                    state = begun[last] = self._numbered(0, self.sides[0][last])
                if not state:
                    return None
            leader = leads[state]
            if leader:
                if i == size_a:
                    return None
                token = a[i]
                i += 1
                links.append(token << 32 | last)
            else:
                if j == size_b:
                    return None
                token = b[j]
                j += 1
                links.append(last << 32 | token)
            key = state << 32 | token
            state = known.get(key)
            if state is None:
                state = known[key] = self.step(key >> 32, token)
            if state < 0:
                return None
            if leads[state] != leader:
                last = token


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in
    their order for the characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoding_by_ranks(spec: dict, bytes_of: list[bytes]) -> tiktoken.Encoding | None:
    """The same byte-level tokenizer for the library that is several times faster, which merges by ids; None if its
    merges aren't in the order of their ids, or if it does anything besides."""
    cut, model = spec["pre_tokenizer"], spec["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    given = [i for i in model["vocab"].values() if len(bytes_of[i]) == 1]
    plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
    if not plain or made != sorted(set(made)) or len(given) != 256 or not model["merges"] or max(given) > made[0]:
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes_of[i]: i for i in [*given, *made]}, special_tokens={})


class Entry(NamedTuple):
    """What is known of a unit or a text: groups as text, numbers of tokens and groups, and its links as bytes of 64 bits."""

    text: str
    n_a: int
    n_b: int
    n_groups: int
    links: bytes


NOTHING = Entry("", 0, 0, 0, b"")


class Aligner:
    """Aligns texts as both tokenizers cut them."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        spec, alphabet = json.load(open(first)), byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            a_bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.by_ranks = encoding_by_ranks(spec, a_bytes)
        self.first_sizes = np.array(list(map(len, a_bytes)), np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        self.blank = self.b.piece_to_id("▁")
        #: Whether no piece reaches over the beginning of a run of blanks or line feeds.
        self.by_units = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, Entry | None] = {}
        self.long: list[str] = []
        self.held = 0
        self._odd, self._cut = re.compile(r"[^\S \n]"), re.compile(r"(?<=\S)(?=[ \n])")
        self._plain = re.compile(r"[ \n]+[^ \n]*")

    def units(self, text: str) -> list[str]:
        """A text, a blank in front, cut before runs of blanks and line feeds that follow something else."""
        return self._cut.split(text) if self._odd.search(text) else self._plain.findall(text)

    def _second_ids(self, unit: str, ids: list[int]) -> list[int] | None:
        """The second tokenizer puts a blank in front itself: it is spared where the unit has one, and taken off where not."""
        return ids if unit[0] == " " else ids[1:] if ids[:1] == [self.blank] else None

    def _first_ids(self, units: list[str]) -> list[list[int] | None]:
        """Ids of each unit by the first tokenizer; None where their bytes are not the unit's. Units that don't end in white
        space stay apart when they are joined: they are tokenised as one string, and its ids cut where units end."""
        sides = self.transducer.sides[0]
        if self.by_ranks and not any(u[-1].isspace() for u in units):
            whole = "".join(units)
            ids = self.by_ranks.encode_ordinary(whole)
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
            cuts = np.searchsorted(np.cumsum(self.first_sizes[ids]), ends)
            if b"".join(map(sides.__getitem__, ids)) == whole.encode():
                stops = (cuts + 1).tolist()
                return [ids[i:j] for i, j in zip([0, *stops], stops)]
        return self._tokenised(units)

    def _tokenised(self, units: list[str]) -> list[list[int] | None]:
        sides = self.transducer.sides[0]
        found = [x.ids for x in self.a.encode_batch(units, add_special_tokens=False)]
        return [x if b"".join(map(sides.__getitem__, x)) == u.encode() else None for u, x in zip(units, found)]

    def _entries(self, units: list[str]) -> list[Entry | None]:
        """Latin units, of which Unicode's versions say the same, go by ranks; others through the tokenizer itself."""
        latin = [u for u in units if u.isascii() or max(u) < "ɐ"]
        found = dict(zip(latin, self._aligned(latin, self._first_ids(latin)))) if latin else {}
        if rest := [u for u in units if u not in found]:
            found |= zip(rest, self._aligned(rest, self._tokenised(rest)))
        return [found[u] for u in units]

    def _aligned(self, units: list[str], first: list[list[int] | None]) -> list[Entry | None]:
        second = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        out, align, made = [], self.transducer.align, Entry._make
        for unit, a, b in zip(units, first, second):
            b = self._second_ids(unit, b)
            found = None if a is None or b is None else align(a, b)
            out.append(found and made((found[0], len(a), len(b), found[1], array("q", found[2]).tobytes())))
        return out

    def whole(self, text: str) -> Entry:
        """A text tokenised as a whole."""
        return self._entries([" " + text])[0] or NOTHING

    def _learn(self, units: set[str]) -> None:
        new = list(units.difference(self.known))
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            for unit, entry in zip(part, self._entries(part)):
                self.known[unit] = entry
                if len(unit) > LONGEST_UNIT:
                    self.long.append(unit)
                else:
                    self.held += OBJECTS + len(unit) + (len(entry.text) + len(entry.links) if entry else 0)

    def _forget(self) -> None:
        """Long units go at once, all others when they take up too much."""
        for unit in self.long:
            del self.known[unit]
        self.long.clear()
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0

    def _joined(self, units: list[str]) -> Aligned | None:
        """A text's alignment out of those of its units; None if a unit has none."""
        counts = Counter(units)
        entries = list(map(self.known.__getitem__, counts))
        if None in entries:
            return None
        n = np.fromiter(counts.values(), np.int64, len(counts))
        _, *sizes, links = zip(*entries)
        sizes = [int(np.fromiter(x, np.int64, len(x)) @ n) for x in sizes]
        distinct, times = summed(np.frombuffer(b"".join(links), "<i8"), np.repeat(n, np.fromiter(map(len, links), np.int64, len(links)) >> 3))
        return ";".join(map(itemgetter(0), map(self.known.__getitem__, units))), [*sizes, int(times.sum())], distinct, times

    def align_all(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The alignment of each text; texts are taken in groups, so that memory is bounded."""
        for start, stop in groups_of([len(t or "") for t in texts], GROUP):
            group = texts[start:stop]
            cut = [self.units(" " + t) if t and self.by_units else [] for t in group]
            self._learn(set().union(*cut))
            for text, units in zip(group, cut):
                found = self._joined(units) if units else None
                yield found or self.align_whole(text)
            self._forget()

    def align_whole(self, text: str | None) -> Aligned:
        entry = self.whole(text) if text else NOTHING
        links = np.frombuffer(entry.links, "<i8")
        return entry.text, [*entry[1:4], len(links)], *summed(links, np.ones(len(links), np.int64))


#: Groups as text; n_a, n_b, n_groups and n_links; distinct pairs, ascending; links of each.
Aligned = tuple[str, list[int], np.ndarray, np.ndarray]


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and the sum of times of each."""
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(times[order], first) if len(first) else times


def groups_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about `most`, one at least in each."""
    ends, total = [], 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            ends.append(i)
            total = 0
    ends += [len(sizes)] if sizes and (not ends or ends[-1] < len(sizes)) else []
    return list(zip([0, *ends], ends))


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One per worker process."""
    if (first, second) not in _loaded:
        _loaded[first, second] = Aligner(first, second)
    return _loaded[first, second]


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (distinct, first id << 32 | second id) and
    times (links of each), one row per document."""
    paths = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for b in batches:
            texts = b["text"].to_pylist()
            # Some megabytes of texts a time: pairs of a whole batch of long texts could be many times its size.
            for start, stop in groups_of([len(t or "") for t in texts], GROUP):
                found = list(own.align_all(texts[start:stop]))
                offsets = pa.array(accumulate((len(p) for _, _, p, _ in found), initial=0), pa.int32())
                flat = lambda k: pa.array(np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]))
                sizes = [pa.array([f[1][i] for f in found], pa.int64()) for i in range(4)]
                lists = [pa.ListArray.from_arrays(offsets, flat(2)), pa.ListArray.from_arrays(offsets, flat(3).cast(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(start, stop - start), *sizes, pa.array([f[0] for f in found], pa.string()), *lists], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair with the same first id has more). links: pairs."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # A first id has no more pairs than the second vocabulary has ids: the window is bounded.
    first = F.call_function("shiftright", F.col("pair"), F.lit(32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(first)))


def frequent(counts: DataFrame, top: int = TOP) -> tuple[int, bool]:
    """The least power of two such that at most `top` pairs stand in as many documents, and whether any pair does not.

    With it 2n for a pair's documents, at least `top` pairs stand in n or more: a pair that is left out holds at most
    two of `top` parts of all.
    """
    found = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}
    power, taken = max(found, default=0) + 1, 0
    while power and taken + found.get(power - 1, 0) <= top:
        power -= 1
        taken += found.get(power, 0)
    return 1 << power, taken < sum(found.values())


def alignment(docs: DataFrame, first: str | None = None, second: str | None = None, top: int = TOP) -> DataFrame:
    """The contract's columns, one row per document."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    links = aligned(docs, first, second).withColumn("groups_sha256", digest).drop("groups")
    links = stored(links.withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(links))
    least, more = frequent(counts, top)
    table = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    pairs, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, times = (b[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            sizes = b["pairs"].value_lengths().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            per_row = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[edges])
            of = np.where(hit, at, 0)
            sums = [per_row(np.where(hit, times * x[of], 0)) if len(pairs) else np.zeros(len(b), np.int64) for x in (best, n)]
            missing = per_row(~hit)
            offsets = pa.array(np.concatenate(([0], np.cumsum(missing))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], *map(pa.array, sums), *rest], [*names, "n_best", "count_sum", "rare", "rare_times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = links.select(*names, "pairs", "times").mapInArrow(mapped, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not more:
        return out.select(*columns)
    out = stored(out)
    rare = out.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    added: dict[str, Column] = {c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in (("n_best", "_best"), ("count_sum", "_sum"))}
    return out.join(sums, "row", "left").withColumns(added).select(*columns)
