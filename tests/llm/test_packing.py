import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from drillframe.llm import packing
from drillframe.llm.common import table
from drillframe.llm.queries import op3_packing

from .cases import no_docs, odd_docs


def slow_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check(got, docs):
    want = Counter()
    for (d, _), ids in zip(docs, slow_ids([t for _, t in docs])):
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(r.length for r in got) // 4096)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    made, least = check(op3_packing(spark, sf).collect(), docs)
    assert made <= least + 1


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(no_docs(spark)).count() == 0


def test_recipe_uses_every_piece_once_and_fills_exactly():
    rng = np.random.default_rng(1)
    lengths = Counter(np.minimum(4096, rng.lognormal(6.3, 0.9, 30_000).astype(int) + 1).tolist())
    made = packing.recipe(lengths)
    used = Counter()
    for pattern, times in made:
        assert sum(pattern) <= 4096
        for x in pattern:
            used[x] += times
    assert used == lengths
    least = -(-sum(k * v for k, v in lengths.items()) // 4096)
    assert sum(t for _, t in made) <= least + 2
    assert len(made) < 3 * 4096


def test_complements_find_what_there_is():
    counts = [0] * 101
    counts[10], counts[20], counts[70] = 2, 1, 1
    index = packing.Complements(counts)
    assert index.exact(70, Counter()) == (70,)
    assert sum(index.exact(30, Counter())) == 30
    assert sorted(index.exact(20, Counter([20]))) == [10, 10]
    assert sorted(index.exact(40, Counter())) == [10, 10, 20]
    assert index.exact(40, Counter([10])) is None
    assert index.best_fit(69, Counter()) == 20


def test_indexes_equal_a_search_as_counts_fall():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = rng.integers(0, 3, 61).tolist()
        counts[0] = 0
        index = packing.Complements(counts)
        for _ in range(40):
            gap = int(rng.integers(1, 61))
            used = Counter(rng.choice(61, rng.integers(0, 3)).tolist())
            left = {x: int(counts[x]) - used[x] for x in range(1, 61)}
            sums = {a: (a,) for a in left if left[a] > 0}
            fits = lambda *xs: all(left[x] >= n for x, n in Counter(xs).items())
            pair = any(fits(a, gap - a) for a in range(1, gap))
            triple = any(fits(a, b, gap - a - b) for a in range(1, gap) for b in range(1, gap - a))
            assert (index.pair(gap, used) is not None) == pair and (index.triple(gap, used) is not None) == triple
            found = index.exact(gap, used)
            assert (found is not None) == (gap in sums or pair or triple)
            if found:
                assert sum(found) == gap and fits(*found)
                if rng.random() < 0.5:
                    for x in found:
                        counts[x] -= 1


def test_repeated_rows_are_dealt_to_many_cells(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 3000, "doc_id long, text string").repartition(3)
    got = packing.pack(docs).collect()
    check(got, [(1, "the same text")] * 3000)
    cut = packing.pieces(docs)
    assert cut.select("nth").distinct().count() >= 900


def test_every_character_is_encoded_as_the_tokenizer_does():
    known = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    points = [i for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    points += list(range(0xE000, 0x11000, 37)) + list(range(0xFE00, 0x10100)) + list(range(0x1F300, 0x1F700, 3))
    texts = [t for c in map(chr, points) for t in (c, f"a{c}", f"{c}a", f"1{c}1", f"a{c}b")]
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, ids in zip(texts, want) if np.frombuffer(known.encode(t), "<u4").tolist() != ids] == []


def test_random_texts_with_control_characters():
    known = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    parts = [*map(chr, range(0x21)), "\x7f", "\x80", "\x9f", "a", "The", "ing", "é", "中", "1", "42", ".", ",", "'s", "!", " ", "  ", "­", "̈", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(20_000)]
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, ids in zip(texts, want) if np.frombuffer(known.encode(t), "<u4").tolist() != ids] == []
