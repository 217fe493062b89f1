"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoder stores the last token of that prefix's encoding. A token can end a prefix
if it stands at its end and keeps its seam with the last token of what is before it; exactly one token can. So a byte
is appended without looking back further than the longest token, the encoding is read off from the end, and after an
edit only the states near it are computed anew.

Texts are encoded in units that begin at a blank or line feed: the pattern's matches never cross a single one of them
between words, so a unit's ids depend on nothing else. Units met before are looked up, and new ones are encoded in sorted order, so that
each resumes from the prefix that it shares with the one before.

Edge cases: a null text counts as empty; an empty text has no ids, and its digests are those of the empty string;
repeated rows are encoded alike and each keeps its row; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of units and ids that a worker remembers, of the objects about each as well; beyond, it starts anew. Longer units
#: than UNIT characters are not remembered.
REMEMBERED_BYTES, OBJECTS, UNIT = 256 << 20, 170, 100
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Tokens by rank, with the two parts that each was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        self.merged: dict[tuple[int, int], int] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, ranks))
        #: By last byte and number of bytes up to it: lengths of the tokens that may end there, longest first.
        ends: dict[int, set[int]] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            ends.setdefault(token[-1], set()).add(len(token))
            if len(token) > 1:
                parts = [token[i : i + 1] for i in range(len(token))]
                while len(parts) > 2:
                    at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], _NEVER))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                pair = ranks[parts[0]], ranks[parts[1]]
                self.parts[rank] = pair
                self.merged[pair] = rank
        self.sizes = {byte: [tuple(s for s in sorted(sizes, reverse=True) if s <= n) for n in range(self.longest + 1)] for byte, sizes in ends.items()}
        self.length = [len(b) for b in self.bytes_of]

    def seam(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when the bytes of both are encoded together.

        Merges are taken back, the latest first, on the sides that face the seam. The tokens would have merged across it
        if, at some point, the two that face each other have a merge earlier than the one taken back last.
        """
        known = self.seams.get((left, right))
        if known is not None:
            return known
        a, b, bound, holds = left, right, _NEVER, True
        while True:
            if self.merged.get((a, b), _NEVER) < bound:
                holds = False
                break
            if self.parts[a] and (a > b or not self.parts[b]):
                bound, a = a, self.parts[a][1]
            elif self.parts[b]:
                bound, b = b + 1, self.parts[b][0]
            else:
                break
        if len(self.seams) > 2_000_000:
            self.seams.clear()
        self.seams[left, right] = holds
        return holds


class Prefixes:
    """A byte string and the last token of each of its prefixes; grows, shrinks and takes edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._extend(self.data, start, len(self.data))

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def become(self, data: bytes) -> None:
        """The states of data, resumed from the prefix that it shares with the present string."""
        old, same = self.data, 0
        for x, y in zip(old, data):
            if x != y:
                break
            same += 1
        self.truncate(same)
        self.data = data
        self._extend(data, same, len(data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many states were computed anew. Once as many states in a row as the
        longest token has bytes are what they were, all later ones are."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        equal, at = 0, start
        while at < len(self.data) and equal < self.vocabulary.longest:
            self._extend(self.data, at, at + 1)
            at += 1
            before = at - 1 - shift
            equal = equal + 1 if at > start + len(new) and old[before] == self.last[-1] else 0
        self.last += old[at - shift :]
        return at - start

    def _extend(self, data: bytes, at: int, to: int) -> None:
        ranks, sizes, last, seams, seam, longest = self.vocabulary.ranks, self.vocabulary.sizes, self.last, self.vocabulary.seams, self.vocabulary.seam, self.vocabulary.longest
        for end in range(at + 1, to + 1):
            for size in sizes[data[end - 1]][end if end < longest else longest]:
                start = end - size
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                pair = last[start - 1], token
                known = seams.get(pair)
                if known or (known is None and seam(*pair)):
                    break
            last.append(token)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= self.vocabulary.length[out[-1]]
        return out[::-1]


class Codec:
    """Encodes and decodes texts by a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.prefixes = Prefixes(self.vocabulary)
        #: Ids as little-endian bytes: a collector of garbage has nothing to follow in them.
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []
        self.held = 0
        self.decimal = [str(i) for i in range(len(self.vocabulary.bytes_of))]

    def _units(self, text: str) -> list[str]:
        """The text cut before single blanks, or at the pattern's matches where white space is anything else than single
        blanks and line feeds."""
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text):
            return self.pattern.findall(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += ["\n", head] if out else [head]
            out += [" " + x for x in rest]
        return out

    def _ids_of(self, unit: str) -> bytes:
        """A unit of letters is one match; a stop or comma after letters is a match of its own."""
        if (unit[1:] if unit[:1] == " " else unit).isalpha():
            self.prefixes.become(unit.encode())
            ids = self.prefixes.tokens()
        elif unit[-1:] in (".", ",") and unit[-2:-1].isalpha():
            base = self.known.get(unit[:-1])
            if base is None:
                base = self._remember(unit[:-1], self._ids_of(unit[:-1]))
            return base + struct.pack("<I", self.vocabulary.ranks[unit[-1].encode()])
        else:
            ids = [i for match in self.pattern.findall(unit) for i in Prefixes(self.vocabulary, match.encode()).tokens()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, unit: str, ids: bytes) -> bytes:
        self.known[unit] = ids
        if len(unit) > UNIT:
            self.long.append(unit)
        else:
            self.held += OBJECTS + len(unit) + len(ids)
        return ids

    def _learn(self, units: set[str]) -> None:
        for unit in sorted(units.difference(self.known)):
            self._remember(unit, self._ids_of(unit))

    def _forget(self) -> None:
        """Long units go at once, all others when they take up too much."""
        for unit in self.long:
            self.known.pop(unit, None)
        self.long.clear()
        self.prefixes.become(b"")
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts are taken in groups, so that memory is bounded."""
        group, size = [], 0
        for text in [*texts, None]:
            if text is None or size > 4_000_000:
                cut = [self._units(t) for t in group]
                self._learn(set().union(*cut))
                for units in cut:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, units)), "<u4").tolist()
                self._forget()
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The contract's columns, one row per document."""
    path = path or public_tokenizers.path(RANKS)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for ids in own.encode_all(b["text"].to_pylist()):
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(own.decimal.__getitem__, ids)).encode()))
                out_sha.append(sha(own.decode(ids)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(mapped, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of each document."""
    path = path or public_tokenizers.path(RANKS)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = pa.array(list(own.encode_all(b["text"].to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(mapped, f"doc_id {kind}, ids array<int>")
