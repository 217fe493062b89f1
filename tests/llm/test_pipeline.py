import corpus_pipeline
from drillframe.llm import quality_cnn, secrets, toxicity
from drillframe.llm.common import stored, table
from drillframe.operators import durable

from .cases import no_docs, odd_docs
from .test_packing import check as check_packing
from .test_secrets import slow_base
from .test_simhash import slow_classes, slow_fingerprint


def test_stages_equal_brute_force(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near-duplicates", "secrets", "packing"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        if name == "packing":
            made, least = check_packing(out.collect(), [(r.doc_id, r.text) for r in before])
            assert made <= least + 1
            break
        assert out.columns == columns
        docs = stored(out)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near-duplicates":
            smallest = slow_classes([(r.doc_id, slow_fingerprint(r.text)) for r in before])
            assert set(after) == {c for _, _, c in smallest}
        elif name == "secrets":
            assert set(after) == {r.doc_id for r in before}
            assert all((after[r.doc_id].text == r.text) == (not slow_base(r.text)) or "-----" in r.text for r in before)
            assert not any(slow_base(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            labels = table(spark, sf, "labels")
            frame = spark.createDataFrame(before, docs.schema)
            scored = quality_cnn.quality_scores(frame, labels) if name == "quality" else toxicity.toxicity_scores(frame, labels)
            keep = {r.doc_id for r in scored.collect() if r.predicted == (1 if name == "quality" else 0)}
            assert set(after) == keep and all(after[r.doc_id] == r for r in before if r.doc_id in keep)
        assert len(after) > 0


def test_run_and_odd_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = stored(docs) if name != "packing" else docs
        docs.count()


def test_rules_kinds_are_unique():
    assert len({r.kind for r in secrets.RULES}) == len(secrets.RULES)


def test_run_keeps_no_more_than_its_result_reads(spark, sf):
    import os

    durable.clear(spark)
    out = corpus_pipeline.run(spark, sf)
    held = {d for d in os.listdir(durable.own_folder(spark).removeprefix("file:"))}
    assert len(held) == 2 and out.count() > 0
