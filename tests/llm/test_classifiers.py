import re
import zlib

import numpy as np
import pytest

from drillframe.llm import quality_cnn, toxicity
from drillframe.llm.common import labelled_sample, table
from drillframe.llm.queries import op2_toxicity, op7_quality

from .cases import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def held_out_rows(spark, df, label, sf):
    rows = df.join(table(spark, sf, "labels").select("doc_id", label), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def auc(score, label):
    up, down = score[label == 1], score[label == 0]
    return ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2)


@pytest.mark.parametrize("query, label, least, sf", [(op2_toxicity, "toxic", 0.95, "/root/testdata/sf0.1"), (op7_quality, "quality", 0.99, SF)])
def test_held_out_accuracy(spark, query, label, least, sf):
    out = query(spark, sf).cache()
    assert out.count() == table(spark, sf, "documents").count()
    assert auc(*held_out_rows(spark, out, label, sf)) >= least
    for r in out.collect():
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3))


def slow_toxicity(text, g):
    """Every text in full, word by word, each transducer after the other, without automaton and tables."""
    low = (text or "").lower().replace("’", "'")
    tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)?|[\"“”„«»,:.!?;…\n–—]|--?", low)
    tagged = [(toxicity.MARKS[t], 1.0) if t in toxicity.MARKS else g.tag(t) for t in tokens]
    tags = [t for t, _ in tagged]

    def run(step, tags):
        state, out = 0, []
        for t in tags:
            state, t = step(state, t)
            out.append(t)
        return out

    near = toxicity.near
    for step in (toxicity.negation, toxicity.reported, near("TY", 4, {"I": "A"}), near("F", 4, {"H": "G"})):
        tags = run(step, tags)
    tags = tags[::-1]
    for step in (toxicity.reported_after, near("T", 4, {"I": "A"}), near("T", 3, {"H": "B", "G": "X"}), toxicity.harmless):
        tags = run(step, tags)
    strength = sum(g.weights[t] * w for t, (_, w) in zip(tags[::-1], tagged) if t in g.weights)
    return 1 / (1 + np.exp(-np.clip(g.bias + g.slope * np.log1p(strength), -30, 30)))


def slow_quality(text, net):
    """One text at a time, a filter's response at each byte as a sum of six table entries."""
    data = (text or "").encode()
    blocks = max(1, -(-len(data) // quality_cnn.BLOCK))
    padded = np.frombuffer(data + bytes(blocks * quality_cnn.BLOCK + quality_cnn.WIDTH - len(data)), np.uint8)
    response = sum(net.table[k][padded[k : k + blocks * quality_cnn.BLOCK]] for k in range(quality_cnn.WIDTH))
    top = response.reshape(blocks, quality_cnn.BLOCK, -1).max(axis=1)
    chunks = np.array([top[i : i + 2].max(axis=0) for i in range(max(1, blocks - 1))])
    pooled = np.tanh(chunks + net.offset)
    logit = np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0)]) @ net.weight + net.bias[0]
    return 1 / (1 + np.exp(-logit))


@pytest.mark.parametrize("query, fit, slow, close", [(op2_toxicity, toxicity.fit, slow_toxicity, 1e-9), (op7_quality, quality_cnn.fit, slow_quality, 1e-4)])
def test_query_equals_brute_force(spark, sf, query, fit, slow, close):
    docs = table(spark, sf, "documents")
    model, texts = fit(docs, table(spark, sf, "labels")), {r.doc_id: r.text for r in docs.collect()}
    got = query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.score == pytest.approx(slow(texts[r.doc_id], model), abs=close), texts[r.doc_id][:80]


@pytest.mark.parametrize("module, rejected", [(toxicity, "drop_toxic"), (quality_cnn, "drop_low_quality")])
def test_odd_rows(spark, module, rejected):
    docs, labels = odd_docs(spark), table(spark, SF, "labels")
    scores = toxicity.toxicity_scores if module is toxicity else quality_cnn.quality_scores
    for rows in (labels, labels.limit(0)):
        out = scores(docs, rows).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out is False for r in out if r.doc_id is None)
    assert scores(no_docs(spark), labels).count() == 0
    assert getattr(module, rejected)(docs, labels).columns == docs.columns
    assert getattr(module, rejected)(no_docs(spark), labels).count() == 0


def test_sample_sees_no_held_out_row_and_keeps_its_bound(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    docs = docs.unionByName(docs)
    labels = spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    got = labelled_sample(docs, labels, "toxic", 50)
    assert len(got) == 50
    assert all(zlib.crc32(t.encode()) % 5 and y == int(t) % 2 for t, y in got)


@pytest.mark.parametrize("tags, want", [
    ("IWW", "IWW"), ("NWI", "NWi"), ("NWWWI", "NWWWI"), ("NCI", "NCI"), ("NKI", "NKI"), ("NEI", "NEI"), ("TWI", "TWA"), ("ITW", "ATW"), ("YI", "YA"), ("TEI", "TEI"), ("TWWWWI", "TWWWWI"),
    ("RWI", "RWr"), ("RQIQI", "RQrQI"), ("RLQTIQ", "RLQTrQ"), ("RQWETIQTI", "RQWETrQTA"), ("RQIPTI", "RQrPTA"), ("REI", "REI"), ("MRTI", "MRTA"), ("QTICQTR", "QTrCQTR"), ("QIEQMR", "QIEQMR"), ("QIQETR", "QIQETR"),
    ("H", "h"), ("HWW", "hWW"), ("HT", "BT"), ("HWWT", "BWWT"), ("HWWWT", "hWWWT"), ("FHT", "FXT"), ("FHW", "FhW"), ("NHT", "NhT"), ("THW", "ThW"), ("HET", "hET"), ("RTFHT", "RTFrT"),
])
def test_transducers(tags, want):
    assert toxicity.composed(tags) == want


def test_composition_equals_one_after_the_other():
    rng = np.random.default_rng(0)
    steps = ((toxicity.negation, 4), (toxicity.reported, 4), (toxicity.near("TY", 4, {"I": "A"}), 5), (toxicity.near("F", 4, {"H": "G"}), 5))
    for _ in range(300):
        tags = "".join(rng.choice(list("IHTYNKRMFQCLEPW"), 14))
        want = tags
        for step, n in steps:
            want = toxicity.Transducer(step, n)(want)
        assert toxicity.FORWARD(tags) == want


#: Written for this test, not learned from: sentence and whether it is an attack.
SENTENCES = [
    ("You are an idiot.", 1), ("Shut up, you worthless moron!", 1), ("People like you are scum.", 1), ("They are pathetic and disgusting.", 1), ("You are not only stupid but pathetic.", 1), ("I said you are an idiot.", 1),
    ("I will kill you.", 1), ("We are going to hurt them.", 1), ("Someone should stab him!", 1), ("I'll destroy you, loser.", 1), ("Wait till I murder you", 1), ("Du bist ein idiot.", 1), ("Tu es stupid, un vrai clown.", 1), ("He said \"hi\". You idiot!", 1),
    ("He said: \"you idiot\"", 0), ("He said \"hi. you idiot\" and left.", 0), ("\"You idiot,\" he said.", 0), ("\"Get lost. You are scum!\" they shouted at the door.", 0), ("She called him a moron.", 0), ("The paper reported that he is a loser.", 0), ("He told us: “You are worthless.”", 0),
    ("They said they will kill you.", 0), ("You are not an idiot.", 0), ("They were never stupid.", 0), ("Nobody isn't pathetic here, not you.", 0), ("I would never hurt you.", 0), ("We don't want to kill them.", 0), ("Du bist kein idiot.", 0), ("Tu n'es pas stupid.", 0),
    ("Kill the process.", 0), ("Kill the thread before you restart.", 0), ("This will kill the performance.", 0), ("Do not destroy the build folder.", 0), ("The frost will hurt the roses.", 0), ("Stab the potatoes with a fork.", 0), ("Nothing here.", 0), ("An idiotic plan in the Scumbria hills.", 0),
]


def right_of(grammar, at):
    automaton = grammar.automaton()
    return [(s >= at) == bool(y) for (_, y), s in zip(SENTENCES, grammar.score_all([t for t, _ in SENTENCES], automaton))]


def test_grammar_decides_on_written_sentences(spark, monkeypatch):
    """Without its transducers the grammar is a list of words, and fails on reported, negated and harmless clauses."""
    fitted = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for grammar in (toxicity.Grammar.given(), fitted):
        wrong = [t for (t, _), ok in zip(SENTENCES, right_of(grammar, 0.5)) if not ok]
        assert len(wrong) <= 2, wrong
    plain = lambda tags: tags.replace("H", "B")
    monkeypatch.setattr(toxicity, "composed", plain)
    assert sum(right_of(fitted, 0.5)) <= len(SENTENCES) - 15


def test_quotations_over_colons_and_sentences():
    g = toxicity.Grammar.given()
    s = lambda t: g.strength(g.sums(t, g.automaton()))
    assert s("You are an idiot.") > s("What an idiot.") > s("He said the idiot left.") >= s("That is not an idiot.") > s("Nothing here.") == 0
    assert s("idiotic") == 0 and s("Idiot! Moron!") == pytest.approx(2 * s("idiot"))
    assert s('He said "a\nYou idiot') == s("You idiot")


def test_weights_are_learned_and_stay_where_labels_tell_nothing():
    rows = [(f"you are an idiot {i}", 1) for i in range(80)] + [(f"that is not an idiot {i}", 0) for i in range(80)] + [(f"so an idiot {i}", i % 2) for i in range(40)]
    grammar = toxicity.Grammar.given()
    toxicity.fit_weights(grammar, rows)
    assert grammar.weights["A"] > toxicity.WEIGHTS["A"] and grammar.weights["X"] == pytest.approx(toxicity.WEIGHTS["X"], rel=1e-3)


def test_network_trains_and_covers_whole_texts():
    rng = np.random.default_rng(3)
    good = lambda n: bytes(rng.choice(list(b"abcdefgh  "), n).astype(np.uint8))
    made = [(good(n), 1) for n in rng.integers(50, 3000, 60)] + [(good(n) + b"##" * 20 + good(n), 0) for n in rng.integers(50, 1500, 60)]
    net = quality_cnn.Network().train(made, epochs=8).freeze()
    last = good(5000) + b"##" * 20
    assert net.score_all([good(5000)])[0] > 0.5 > net.score_all([last])[0]
    # Together or alone, a text has the same score; the longest spans several segments.
    texts = [b"", b"x", good(255), good(256), good(257), good(400_000)]
    assert net.score_all(texts) == pytest.approx([net.score_all([t])[0] for t in texts], abs=1e-6)


def test_fast_responses_equal_plain_ones():
    net = quality_cnn.Network().freeze()
    rows = quality_cnn.blocks_of(bytes(range(256)) * 3)
    plain = sum(net.table[k][rows[:, k : k + quality_cnn.BLOCK]] for k in range(quality_cnn.WIDTH))
    assert np.allclose(net.respond(rows), plain, atol=1e-5)


def test_plain_forms_of_a_learned_stem_are_exceptions():
    marked = [(f"stands xyzab{chr(97 + i % 10)}{chr(98 + i % 7)} here", 1) for i in range(40)]
    clean = [("stands " + ("xyzabs" if i < 10 else "so") + " here", 0) for i in range(200)]
    rows = marked + clean
    grammar = toxicity.Grammar.given()
    toxicity.learn_lexicon(grammar, rows)
    assert any(s.startswith("xyza") for s in grammar.stems)
    assert grammar.tag("xyzabs")[0] == "W" and grammar.tag("xyzabab")[0] == "I"
