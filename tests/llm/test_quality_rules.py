import re
from collections import Counter

from drillframe.llm import quality_rules
from drillframe.llm.common import table
from drillframe.llm.queries import op10_quality_rules, oracle_sql

from ..oracle import compare
from .cases import no_docs, odd_docs


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def check(docs):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(str((r.doc_id, *slow(r.text or ""))) for r in docs.collect())
    assert not any(r.base_failed and r.kept for r in got)


def test_query_equals_sql(spark, sf):
    assert compare(op10_quality_rules(spark, sf), sf, oracle_sql()["op10_quality_rules"]) == []


def test_query_equals_brute_force(spark, sf):
    check(table(spark, sf, "documents").select("doc_id", "text"))


def test_odd_rows(spark):
    check(odd_docs(spark))
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_repeats_and_lines(spark):
    texts = ["a b c a b c", "a a a a", "x y\nx y\n\n \nx y ", "w " * 300, " ".join(f"u{i % 50} v{i % 49}" for i in range(5000))]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    kept = op10_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("NOT base_failed")
    wrong = kept.where("kept <> (quality = 1)").count()
    assert wrong <= 0.02 * kept.count()


def test_plan_has_no_python(spark, sf):
    plan = op10_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    filtered = op10_quality_rules(spark, sf).where("kept AND n_words > 60")._jdf.queryExecution().optimizedPlan().toString()
    assert filtered.count("Generate inline") == 1 and filtered.index("Filter") < filtered.index("Generate inline")
