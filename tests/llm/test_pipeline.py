import importlib

import corpus_pipeline
from runlens.llm import langid, packing, simhash, substring, toxicity
from runlens.llm.blocks import table
from runlens.session import keep


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "near_duplicates", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = keep(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        sizes.append(docs.count())
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.toxicity(before, table(spark, sf, "labels")).collect() if r.predicted}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == gone
        if name == "language_id":
            gone = {r.doc_id for r in langid.language_id(before).collect() if r.lang_pred == "und"}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == gone
        if name == "near_duplicates":
            rows = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in rows}
        if name == "substring_dedup":
            assert not substring.passages(before).isEmpty()
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, packing.pack(docs).collect()))


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
