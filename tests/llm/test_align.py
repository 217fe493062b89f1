"""Alignment against whole texts cut by both tokenizers and byte offsets compared plainly."""

import hashlib
import json
import random
from collections import Counter
from itertools import pairwise

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from drillframe.llm import align, queries

from .cases import no_docs, odd_docs

A = Tokenizer.from_file(public_tokenizers.path(align.FIRST))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.SECOND))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "a", "Ab", "é", "ß", "123", "!!", "'s", "中", "\xa0", "　", "\x00", "\x1c", "\x85", "<s>", "<|endoftext|>", "<0x41>", "▁", "é", "😀", "İ", "ﬁ", ".", "word", "ing", "; ", "​", "\x7f", ";\r", "░"]


def vocabulary():
    """Bytes of each id of A: GPT-style characters are found by encoding each byte's own text."""
    chars, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            chars[chr(b)] = b
        else:
            chars[chr(256 + n)] = b
            n += 1
    found = json.load(open(public_tokenizers.path(align.FIRST)))["model"]["vocab"]
    return {i: bytes(chars[c] for c in p) if p != "<|endoftext|>" else p.encode() for p, i in found.items()}


A_BYTES = vocabulary()


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, bytes_of):
    ends = [0]
    for i in ids:
        ends.append(ends[-1] + len(bytes_of(i)))
    return [(i, s, e) for i, (s, e) in zip(ids, pairwise(ends))]


def plain_text(text):
    """Groups and links of a text, from offsets."""
    if not text:
        return "", 0, 0, 0, []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if b"".join(A_BYTES[i] for i in a) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
        return "", 0, 0, 0, []
    at, bt = spans(a, A_BYTES.__getitem__), spans(b, b_bytes)
    both = sorted({e for _, _, e in at} & {e for _, _, e in bt})
    groups, links = [], []
    i = j = 0
    for end in both:
        own_a, own_b = [], []
        while i < len(at) and at[i][2] <= end:
            own_a.append(at[i])
            i += 1
        while j < len(bt) and bt[j][2] <= end:
            own_b.append(bt[j])
            j += 1
        groups.append(",".join(str(x[0]) for x in own_a) + "|" + ",".join(str(x[0]) for x in own_b))
        links += [(x, y) for x, s, e in own_a for y, t, f in own_b if s < f and t < e]
    return ";".join(groups), len(a), len(b), len(groups), links


def plain(rows):
    done = [(i, *plain_text(text)) for i, text in rows]
    counts = Counter(p for *_, links in done for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    return [(i, n_a, n_b, n, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for i, g, n_a, n_b, n, links in done]


def test_query_equals_plain_alignment(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op12_alignment(spark, sf)
    assert found.columns == NAMES
    assert Counter(map(tuple, found.collect())) == Counter(plain(rows))


@pytest.mark.parametrize("top", [0, 1, 40, 1 << 20])
def test_odd_rows_with_rare_pairs_apart(spark, top):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = align.alignment(docs.repartition(3), top=top)
    assert Counter(map(tuple, found.collect())) == Counter(plain(rows))


def test_random_texts_of_odd_characters(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randint(0, 14)))) for i in range(4000)]
    found = align.alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == Counter(plain(rows))


def test_no_rows(spark):
    found = align.alignment(no_docs(spark))
    assert found.columns == NAMES and found.count() == 0


def test_unbroken_text_and_forgotten_units(monkeypatch):
    own = align.Aligner(public_tokenizers.path(align.FIRST), public_tokenizers.path(align.SECOND))
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh0123+/", k=200_000))
    assert own.align_whole(text)[0] == list(own.align_all([text]))[0][0] == plain_text(text)[0]
    assert not own.known and not own.held
    monkeypatch.setattr(align, "REMEMBERED_BYTES", 2_000)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    monkeypatch.setattr(align, "GROUP", 500)
    assert [x[0] for x in own.align_all(texts)] == [plain_text(t)[0] for t in texts]
    assert own.held <= 2_000


def test_transitions_are_remembered_and_mismatches_end():
    own = align.Transducer([b"ab", b"c", b"abc", b""], [b"a", b"bc", b"b", b"x", b"abcabc"])
    assert own.align([0, 1], [0, 1]) == ("0,1|0,1", 1, [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
    assert own.align([2, 2], [4]) == ("2,2|4", 1, [2 << 32 | 4, 2 << 32 | 4])
    known = dict(own.known)
    assert own.align([0, 1], [0, 1])[1] == 1 and own.known == known
    assert own.align([0], [3]) is None and own.align([0], [0]) is None and own.align([0], [0, 2, 0]) is None and own.align([3], [0]) is None
    assert own.align([], []) == ("", 0, [])


def test_groups_of_one_token_each_take_one_step(monkeypatch):
    """A pair that has closed a group once is known as a whole, with the same groups and links."""
    t = align.Transducer([b"", b"ab", b"c", b"abc"], [b"", b"ab", b"c", b"d"])
    want = t.align([1, 2, 1], [1, 2, 1])
    assert want == ("1|1;2|2;1|1", 3, [1 << 32 | 1, 2 << 32 | 2, 1 << 32 | 1]) and t.at_once == {1 << 32 | 1: "1|1", 2 << 32 | 2: "2|2"}
    monkeypatch.setattr(t, "begun", {})
    monkeypatch.setattr(t, "step", None)
    assert t.align([1, 2, 1], [1, 2, 1]) == want and not t.begun
    monkeypatch.undo()
    assert t.align([1, 3], [1, 1, 2]) == ("1|1;3|1,2", 2, [1 << 32 | 1, 3 << 32 | 1, 3 << 32 | 2])
    assert t.align([1, 2], [1]) is None and t.align([1], [1, 2]) is None and t.align([1, 2], [1, 3]) is None
