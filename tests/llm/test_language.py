"""Language identification against plain rank-order profiles and on held-out documents."""

import unicodedata
import zlib
from collections import Counter

import pytest

from drillframe.llm import language, queries

from .cases import SCHEMA, TEXTS, no_docs, odd_docs


def plain_grams(text):
    text = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in unicodedata.normalize("NFC", text).lower())
    text = f" {' '.join(text.split(' '))} "
    while "  " in text:
        text = text.replace("  ", " ")
    return Counter(g for n in (1, 2, 3) for g in (text[i : i + n] for i in range(len(text) - n + 1)) if g != " ") if any(map(str.isalpha, text)) else Counter()


def plain_code(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def plain_ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], plain_code(x[0])))[: language.PROFILE]]


def plain(rows):
    """doc_id, held_out, lang_pred and score. rows: doc_id, text, lang."""
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 4
    sums = {}
    for i, text, lang in rows:
        if i is not None and rest(i) != 2 and lang is not None and text is not None:
            sums.setdefault(lang, Counter()).update(plain_grams(text))
    known = {lang: {g: r for r, g in enumerate(plain_ranked(c))} for lang, c in sums.items() if c}
    out = []
    for i, text, _ in rows:
        own = plain_ranked(plain_grams(text or ""))
        far = {lang: sum(abs(r - p[g]) if g in p else language.PROFILE for r, g in enumerate(own)) for lang, p in known.items()}
        if own and far:
            best = min(far, key=lambda k: (far[k], k))
            out.append((i, rest(i) == 2, best, 1 - far[best] / (len(own) * language.PROFILE)))
        else:
            out.append((i, rest(i) == 2, "und", 0.0))
    return out


def rounded(rows):
    return Counter((i, h, p, round(s, 12)) for i, h, p, s in rows)


def test_query_equals_plain_profiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert rounded(map(tuple, queries.op13_language(spark, sf).collect())) == rounded(plain(rows))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.99 * len(found)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    found = language.predict_languages(docs.repartition(3))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert rounded(map(tuple, found.collect())) == rounded(plain(rows))
    assert {r["lang_pred"] for r in found.where("doc_id = 0 OR doc_id = 1 OR doc_id = 11").collect()} == {"und"}


def test_no_rows_and_nothing_learned(spark):
    assert language.predict_languages(no_docs(spark)).count() == 0
    unknown = spark.createDataFrame([(1, "words", None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r)[2:] for r in language.predict_languages(unknown).collect()] == [("und", 0.0)]


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "".join(t for t in TEXTS if t)[:20_000]
    whole = language.count_grams(text)
    monkeypatch.setattr(language, "SLICE", 7)
    sliced = language.count_grams(text)
    assert (whole[0] == sliced[0]).all() and (whole[1] == sliced[1]).all()
    assert dict(zip(whole[0].tolist(), whole[1].tolist())) == {plain_code(g): n for g, n in plain_grams(text).items()}


def test_sums_given_out_early_add_up(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").coalesce(1)
    whole = {tuple(r) for r in language.gram_counts(docs).collect()}
    monkeypatch.setattr(language, "HELD", 500)
    assert {tuple(r) for r in language.gram_counts(docs).collect()} == whole


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.learn(docs, languages=5)
