import random
import re

import numpy as np
import xxhash

from drillframe.llm import simhash
from drillframe.llm.common import table
from drillframe.llm.queries import op1_simhash

from .cases import no_docs, odd_docs


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, radius=3):
    """rows: (id, fingerprint). Smallest id by component, all pairs compared."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return [(d, f"{f:016x}", smallest.get(find(i))) for i, (d, f) in enumerate(rows)]


def check(got, rows):
    none = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=none) == sorted(slow_classes(rows), key=none)


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    check(op1_simhash(spark, sf).collect(), [(d, slow_fingerprint(t)) for d, t in docs])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check(simhash.simhash_classes(docs).collect(), [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()])
    assert simhash.simhash_classes(no_docs(spark)).count() == 0
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.where("text = 'same text in two rows'").count() == 1


def test_links_by_tiles_and_blocks(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    hot = 0xF0F0F0F0F0F0F0F0
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    want = {(a, c) for a, _, c in slow_classes([(f, f) for f in sorted(fps)])}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for tile, blocks in ((4096, 4), (16, 4), (16, 5), (4096, 6)):
        masks = simhash._masks(blocks, 3)
        old, simhash._blocks = simhash._blocks, lambda n, r, k=blocks: k
        try:
            roots = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
        finally:
            simhash._blocks = old
        assert len(masks) == {4: 4, 5: 10, 6: 20}[blocks]
        group = {}
        for f in sorted(fps):
            s = signed(f)
            group.setdefault(roots.get(s, s), []).append(f)
        assert {(f, min(g)) for g in group.values() for f in g} == want


def test_blocks_follow_the_count():
    assert [simhash._blocks(n, 3) for n in (10, 10**6, 10**8, 10**12)] == [4, 4, 5, 7]


def test_long_chain_becomes_one_component(spark):
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").unionByName(spark.range(1000, 1010).selectExpr("id AS u", "1000 AS v"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1010)}}
