import hashlib
import random
import re

import numpy as np

from drillframe.llm import pii, pii_forms
from drillframe.llm.common import table
from drillframe.llm.queries import op6_pii

from .cases import no_docs, odd_docs


def slow_base(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_base_spans():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", ".", "-", "_", "1", "23", "255", "256", "4539148803436467", "+1", " ", "(555)", "555-6268", "\n", "é", "000", "+", "x@y.z", "10.0.0.1", "٣", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "a." * 100_000 + "@", "1 " * 50_000):
        pii.base_spans(text)
        list(pii.islands(text))


def slow_field_spans(text, field):
    """The best segmentation of every island, by trying all segments and types from each boundary on."""
    found = []
    for start, stop in pii.islands(text):
        cuts, segments = pii._candidates(text, start, stop)
        best, after = 0.0, {len(cuts) - 1: (0.0, [])}
        for i in range(len(cuts) - 2, -1, -1):
            options = [after[i + 1]]
            for a, b, features in segments:
                if a == i:
                    for kind in range(len(pii.KINDS)):
                        score = sum(field.weights[kind, f] for f in features) - pii.MARGIN
                        if score > 0:
                            options.append((score + after[b][0], [(cuts[a], cuts[b], kind), *after[b][1]]))
            after[i] = max(options, key=lambda x: x[0])
        found += after[0][1]
    return found


def slow_spans(text, field):
    base = slow_base(text)
    return sorted(base + [(s, e, k) for s, e, k in slow_field_spans(text, field) if not any(s < y and x < e for x, y, _ in base)], key=lambda x: (x[0], x[2]))


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    texts, field = {r.doc_id: r.text for r in docs.collect()}, pii.fit(docs)
    got = op6_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = slow_base(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in slow_spans(texts[r.doc_id], field))


def test_query_finds_planted_spans(spark, sf, tmp_path):
    """Forms written here, apart from those that the field is trained on, put into texts of the corpus."""
    rng = random.Random(5)
    n = lambda k, first="23456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    card = lambda: pii_forms.checked(n(15, "345"))
    four = lambda c, by: by.join(c[i : i + 4] for i in range(0, 16, 4))
    planted = {
        "phone": [lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"0{n(2)}/{n(7)}", lambda: f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"1-{n(3)}-{n(3)}-{n(4)}"],
        "card": [lambda: four(card(), "."), lambda: four(card(), "  "), lambda: four(card(), "/"), lambda: four(card(), " - ")],
        "email": [lambda: f"anna.{n(2)}[at]mail.example.org", lambda: "max_muster(at)beispiel.de", lambda: "jane.doe [at] example [dot] com", lambda: "info @ firm.net"],
        "ip": [lambda: f"10[.]{rng.randint(0, 255)}[.]3[.]77", lambda: f"192 . 168 . {rng.randint(0, 255)} . 14", lambda: f"2001:db8:85a3:0:0:8a2e:370:{n(4)}", lambda: f"fe80::{n(3)}:ff:fe23:4567"],
    }
    others = [lambda: "2024-05-17", lambda: "17.05.2024 12:30:00", lambda: f"{n(1)},{n(3)}.{n(2)}", lambda: f"no. {n(9)}", lambda: f"{n(4)}-{n(2)}-{n(2)}", lambda: "1.2.10", lambda: f"{n(2)} {n(2)} {n(2)}", lambda: four(card()[:-1] + "x", " ")[:-1] + "0", lambda: "550e8400-e29b-41d4-a716-446655440000", lambda: f"{n(12)}", lambda: "978-3-16-148410-0", lambda: "3 (1999)"]
    rows, want, clean = [], {}, []
    for i in range(1600):
        kind = pii.KINDS[i % 4]
        left, right = rng.choice(("the one thed ", "ly and\n", "eine der ", "", "ab ", "word: ")), rng.choice((" of that", ". And", "", ", on", " der"))
        span = rng.choice(planted[kind])()
        want[i] = f"{kind}:{len(left)}:{len(left) + len(span)}"
        rows.append((i, left + span + right))
        rows.append((10_000 + i, left + rng.choice(others)() + right))
    out = {r.doc_id: [x for x in r.spans.split(",") if x] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), pii.fit(table(spark, sf, "documents"))).collect()}
    texts = dict(rows)
    for kind in pii.KINDS:
        mine = [i for i, x in want.items() if x.startswith(kind) and not pii.base_spans(texts[i])]
        hit = sum(want[i] in out[i] for i in mine)
        extra = sum(x.startswith(kind) and x != want.get(i) for i, xs in out.items() if not pii.base_spans(texts[i]) for x in xs)
        assert hit / len(mine) >= 0.9, (kind, hit, len(mine), [(texts[i], out[i]) for i in mine if want[i] not in out[i]][:5])
        assert hit / (hit + extra) >= 0.9, (kind, hit, extra, [(texts[i], xs) for i, xs in out.items() if any(x.startswith(kind) and x != want.get(i) for x in xs)][:8])


def test_sampled_islands_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"mail u{i}@x.org " + "1 " * 3000 + "\n" + "\n".join("4539148803436467" for _ in range(9))) for i in range(20)], "doc_id long, text string")
    got = pii.sampled_islands(docs, 10, 2)
    assert len(got) == 20 and all(len(t) <= pii.ISLAND_CHARS for t, _ in got)
    assert all(t[s:e] in ("4539148803436467", t.split(" ")[0]) for t, spans in got for s, e, _ in spans)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    assert {r.base_sha256 for r in got if r.doc_id in (0, 1)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(no_docs(spark)).count() == 0


def test_field_adds_what_the_patterns_miss():
    field = pii.SemiMarkov().train(pii_forms.examples(800))
    base, both = pii.all_spans("ring (980) 555-6268 today", field)
    assert base == [] and both == [(5, 19, 3)]
    # The pattern takes card and date together and finds the checksum wrong.
    assert pii.all_spans("card 4539148803436467 12/27", field) == ([], [(5, 21, 2)])
    assert pii.all_spans("order 12345 of 2024-01-02 costs 19.99", field) == ([], [])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    starts, ends, own = np.array([0, 0, 1, 2, 1, 0, 1]), np.array([1, 2, 3, 3, 2, 2, 2]), np.array([0, 0, 0, 0, 0, 1, 1])
    size = np.array([4, 3])
    scores = rng.normal(size=(len(pii.KINDS), 7))

    def paths(island, at):
        if at == size[island] - 1:
            yield []
            return
        yield from paths(island, at + 1)
        for k in range(7):
            if own[k] == island and starts[k] == at:
                for kind in range(len(pii.KINDS)):
                    for rest in paths(island, ends[k]):
                        yield [(kind, k), *rest]

    want = np.zeros_like(scores)
    for island in (0, 1):
        weight, total = np.zeros_like(scores), 0.0
        for path in paths(island, 0):
            w = np.exp(sum(scores[p] for p in path))
            total += w
            for p in path:
                weight[p] += w
        want += weight / total
    assert np.allclose(pii.SemiMarkov._marginals(size, own, starts, ends, scores), want)


def test_islands_take_their_neighbours_along():
    cut = lambda t: [t[s:e] for s, e in pii.islands(t)]
    assert cut("so jane.doe [at] example [dot] com, he said") == ["jane.doe [at] example [dot] com,"]
    assert cut("a @ b.c and 12 / 34  5 x 6") == ["a @ b.c", "12 / 34  5", "6"]
    assert cut("@") == ["@"] and cut(" @ ") == ["@"] and cut("x\n@ \n1") == ["@", "1"] and cut("") == []
