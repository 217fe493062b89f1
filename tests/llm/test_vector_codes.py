"""Vector codes against SQL and against comparing every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from drillframe.llm import queries, vector_codes

from ..oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code double"


def whole(x, kind=np.float32):
    x = float(kind(x))
    return math.floor(x * 4096) if abs(x) < 1e300 else int(x) * 4096


def brute(rows, kind=np.float32):
    """The contract, step by step, in whole numbers. rows: vec_id, embedding, label."""
    kept = [(i, [whole(x, kind) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v + [0] * (-len(v) % 8), lab) for i, v, lab in kept]
    if not kept:
        return []
    w = len(kept[0][1]) // 8
    cut = [[v[p * w : p * w + w] for p in range(8)] for _, v, _ in kept]
    first = {}
    for (i, v, _), parts in zip(kept, cut):
        if i not in first or v < first[i][0]:
            first[i] = v, parts
    ids = sorted(first, key=lambda i: (i is None, i))[:16]
    books = [[first[i][1][p] for i in ids] for p in range(8)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(6):
        made = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for parts in cut:
                own[near(parts[p], book)[1]].append(parts[p])
            made.append([[sum(x) // len(o) for x in zip(*o)] if o else e for o, e in zip(own, book)])
        books = made
    found = [[near(parts[p], books[p]) for p in range(8)] for parts in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return [(i, "".join(f"{n:02x}" for _, n in f), min(e, most), min(sums[lab], most), digest) for (i, _, lab), f, e in zip(kept, found, errors)]


def made(df):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_sql(spark, sf):
    assert compare(queries.op11_vector_codes(spark, sf), sf, vector_codes.oracle()) == []


def test_random_vectors_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i if i % 11 else i // 2, [rng.choice([rng.gauss(0, 1), 0.0, round(rng.gauss(0, 1), 1)]) for _ in range(24)], rng.choice([None, 1, 2])) for i in range(3, 300)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(5)
    assert made(vector_codes.vector_codes(df)) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    fine = [(i, [float(i % 5)] * 9, i % 2) for i in range(20)]
    odd = [(90, None, 1), (91, [1.0, None] + [0.0] * 7, 1), (92, [math.nan] * 9, 1), (93, [math.inf] + [0.0] * 8, None), (None, [2.5] * 9, None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in fine + odd + [(94, [1.0] * 5, 0)]], SCHEMA)
    assert made(vector_codes.vector_codes(df)) == sorted(brute(fine + odd), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_nothing_to_compress(spark, rows):
    assert made(vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA))) == []


def test_empty_vectors(spark):
    assert made(vector_codes.vector_codes(spark.createDataFrame([(1, [], 1, "x", 0.5)], SCHEMA))) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("kind, scale", [("float", 3e38), ("double", 1.7e308), ("double", 2.0**50)])
def test_huge_numbers_are_exact(spark, kind, scale):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * (scale if i % 3 else 2) for _ in range(8)], 1) for i in range(40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert made(vector_codes.vector_codes(df)) == sorted(brute(rows, np.float32 if kind == "float" else np.float64), key=repr)


def test_annulus_spares_comparisons():
    rng = np.random.default_rng(1)
    entries = (rng.normal(0, 1, (16, 8)) * np.linspace(100, 4000, 16)[:, None]).astype(np.int64)
    ring = vector_codes.Annulus(entries.tolist())
    parts = np.concatenate((entries, entries + 3, (rng.normal(0, 1, (3000, 8)) * 1500).astype(np.int64), np.zeros((1, 8), np.int64)))
    chosen, distance = ring.nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (chosen == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert ring.compared < 0.8 * every.size


def test_ties_go_to_the_lower_index():
    ring = vector_codes.Annulus([[3, 0], [0, 3], [-3, 0], [3, 0]])
    chosen, _ = ring.nearest(np.array([[0, 0], [3, 3], [-1, 0], [3, 0], [-3, 3]]))
    assert chosen.tolist() == [0, 0, 2, 0, 1]
    assert [ring._nearest_huge(p)[0] for p in ([0, 0], [3, 3], [-1, 0], [3, 0], [-3, 3])] == [0, 0, 2, 0, 1]
