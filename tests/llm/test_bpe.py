import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from drillframe.llm import bpe
from drillframe.llm.common import table
from drillframe.llm.queries import op4_bpe

from .cases import no_docs, odd_docs


@pytest.fixture(scope="module")
def judge():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def row(judge, d, t):
    ids = judge.encode_ordinary(t or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())


def test_query_equals_tiktoken(spark, sf, judge):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, op4_bpe(spark, sf).collect())) == sorted(row(judge, *d) for d in docs)


def test_odd_rows(spark, judge):
    docs = odd_docs(spark)
    got = bpe.encode_decode(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(row(judge, r.doc_id, r.text)) for r in docs.collect())
    assert bpe.encode_decode(no_docs(spark)).count() == 0
    assert [r.ids for r in bpe.encode(docs.where("doc_id = 4")).collect()] == [judge.encode_ordinary("two words")]


def test_mixed_texts(judge, own):
    rng = random.Random(3)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "'s", "1", "!", "\xa0", "ing", "\r\n", "😀", "=="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 3000, "ab" * 3000]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids == judge.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_appends_and_edits(own):
    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"theinganrs ,.0") for _ in range(n))
    grown = bpe.Prefixes(own.vocabulary)
    for part in [word(rng.randint(1, 9)) for _ in range(60)]:
        grown.append(part)
    assert grown.last == bpe.Prefixes(own.vocabulary, grown.data).last
    long = bpe.Prefixes(own.vocabulary, word(4000))
    for _ in range(40):
        start = rng.randint(0, len(long.data) - 1)
        anew = long.edit(start, min(len(long.data), start + rng.randint(0, 6)), word(rng.randint(0, 6)))
        assert anew <= 3 * own.vocabulary.longest or start > len(long.data) - 400
        fresh = bpe.Prefixes(own.vocabulary, long.data)
        assert long.last == fresh.last and long.tokens() == fresh.tokens()
