"""Unbroken strings and repeated beginnings of 5 MB go through every operator on texts, and workers don't keep them."""

import random
import time

import pytest

from drillframe.llm import align, bpe, chat, language, ogg, packing, pii, quality_cnn, quality_rules, secrets, simhash, toxicity

SIZE = 5_000_000
RNG = random.Random(9)
TEXTS = {
    "unbroken": "".join(RNG.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=SIZE)),
    "calls": "<tool_call>" * (SIZE // 11),
    "tokens": "eyJ" * (SIZE // 3) + " .ey",
    "digits": "".join(RNG.choices("0123456789", k=SIZE // 10)),
    "addresses": "a.b-c+" * (SIZE // 6) + "@",
    "short": "plain words.",
}
OPERATORS = {
    "simhash": lambda docs, labels: simhash.simhash_classes(docs),
    "toxicity": toxicity.toxicity_scores,
    "packing": lambda docs, labels: packing.pack(docs).groupBy("doc_id").count(),
    "bpe": lambda docs, labels: bpe.encode_decode(docs),
    "ogg": lambda docs, labels: ogg.media_features(docs),
    "pii": lambda docs, labels: pii.find_pii(docs, pii.SemiMarkov().train(pii.pii_forms.examples(50))),
    "quality": quality_cnn.quality_scores,
    "secrets": lambda docs, labels: secrets.secret_scan(docs),
    "chat": lambda docs, labels: chat.format_chat(docs.selectExpr("doc_id AS conv_id", "1L AS turn", "'assistant' AS role", "text")),
    "rules": lambda docs, labels: quality_rules.quality_rules(docs),
    "align": lambda docs, labels: align.alignment(docs),
    "language": lambda docs, labels: language.predict_languages(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_take_no_time(spark, name):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS.values())], "doc_id long, text string, lang string").repartition(len(TEXTS))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    start = time.time()
    assert OPERATORS[name](docs, labels).count() == len(TEXTS)
    assert time.time() - start < 30 * len(TEXTS)


def test_workers_do_not_keep_long_strings(monkeypatch):
    codec = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
    words = packing.word_ids(packing.public_tokenizers.path(packing.TOKENIZER))
    texts = ["".join(RNG.choices("abcdefgh", k=100_000)) + f" {i} {'9' * 100_000}" for i in range(3)]
    before = codec.held, words.held, pii._short_span.cache_info().currsize
    list(codec.encode_all(texts))
    for t in texts:
        words.encode(t)
        pii.span_features(t[:5000], "", "")
    assert codec.held - before[0] < 2000 and words.held - before[1] < 2000 and pii._short_span.cache_info().currsize == before[2]
    assert not codec.prefixes.last and max(map(len, codec.known)) <= bpe.UNIT and max(map(len, words)) <= packing.WORD
    for module, held in ((bpe, codec), (packing, words)):
        monkeypatch.setattr(module, "REMEMBERED_BYTES", 20_000)
    for i in range(20):
        some = [" ".join("".join(RNG.choices("abcdéf", k=7)) for _ in range(100))]
        list(codec.encode_all(some))
        words.encode(some[0])
    assert codec.held <= 20_000 and words.held <= 21_000
