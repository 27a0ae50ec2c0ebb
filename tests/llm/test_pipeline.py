import corpus_pipeline
from test_pii import stated_spans
from test_simjoin import brute

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, mid):
    from wardlens.llm import toxicity
    docs = mid
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == mid.columns
        steps.append(docs.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.classify(mid, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in steps[0]} == {r["doc_id"] for r in mid.collect()} - rejected
    pairs = [(r["doc_id"], r["text"]) for r in steps[0]]
    assert {r["doc_id"] for r in steps[1]} == {c for _, _, c in brute(pairs, 5, 80, 100)}
    assert {r["doc_id"] for r in steps[2]} == {r["doc_id"] for r in steps[1]}
    assert not any(stated_spans(r["text"]) for r in steps[2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in steps[2]}
    assert corpus_pipeline.run(spark, SF).count() > 0
