"""The pipeline's stages, each against what its operator decides by brute force."""

import corpus_pipeline
from recordloom.llm import quality
from tests.llm.test_near_copies import brute_near
from tests.llm.test_operators import brute_contamination, brute_dedup


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    assert all(d.columns == columns for d in seen[:5]) and seen[5].columns == [*columns, "copy"]
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, marks, corpus_pipeline.LEAST_QUALITY).collect() if r.predicted}
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    assert ids[1] == good and len(good) < len(ids[0])
    rows = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert ids[2] == brute_near(rows)
    raw = [(r.doc_id, r.text.encode()) for r in seen[2].collect()]
    want = brute_dedup(raw, 100)
    after = {r.doc_id: len(r.text.encode()) for r in seen[3].collect()}
    assert all(0 <= after.get(d, 0) - (want[d][0] - want[d][1]) <= 6 * want[d][2] for d, _ in raw)
    assert not any(r[5] for r in brute_contamination([(r.doc_id, r.text) for r in seen[4].collect()], items) if r[2] > 9)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == seen[5].count()
