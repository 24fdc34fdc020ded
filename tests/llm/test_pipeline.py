import re
from collections import defaultdict

import corpus_pipeline
from standtally.llm import minhash, quality
from tests.llm.cases import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, work in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = work(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        inputs[name + " out"] = docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in inputs["quality_classifier out"].collect()}
    seen = [labels[d] == (d in kept) for d in labels if d is not None]
    assert sum(seen) / len(seen) > 0.95 and 0 < len(kept) < inputs["quality_classifier"].count()
    groups = minhash.near_duplicates(inputs["minhash_near_dedup"], 5).filter("kept").collect()
    assert {r.doc_id for r in inputs["minhash_near_dedup out"].collect()} == {r.doc_id for r in groups}
    mails = [r.text for r in inputs["pii_surrogates out"].collect() if r.text]
    assert not any(re.search(r"@mail\d\.example\.com", t) for t in mails)
    sequences = defaultdict(list)
    for r in docs.collect():
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_stages_bear_odd_and_empty_tables(spark):
    for rows in (None, []):
        docs = documents(spark, rows)
        for name, work in corpus_pipeline.STAGES:
            out = work(spark, docs, FOLDER)
            count = out.count()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                assert count <= docs.count() or name == "mixing"
            assert rows is None or not count
    assert quality.THRESHOLD == 0.7
