"""The pipeline's stages take effect, keep their columns, and pass nothing on that they should catch."""

import corpus_pipeline
from helixpath.llm import decontam, simhash, toxicity
from helixpath.llm.scratch import saved

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "token_files"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = {}
    stage = docs
    for name, f in corpus_pipeline.STAGES:
        before, stage = stage, saved(f(spark, stage, DIR), f"test-{name}")
        seen[name] = (before, stage)
        if name != "token_files":
            assert stage.columns == docs.columns
    scores = toxicity.scores(docs, toxicity.train(docs, labels))
    assert ids(seen["toxicity"][1]) == ids(scores.where("predicted = 0"))
    clean = ids(labels.where("toxic = 0")) & ids(docs)
    assert len(clean & ids(seen["toxicity"][1])) > 0.95 * len(clean)
    before, after = seen["simhash"]
    assert ids(after) < ids(before) and after.count() == len(ids(after)) == after.select("text").distinct().count()
    same = simhash.simhash_classes(before, words=5, budget=0).groupBy("component_id").count()
    assert after.count() <= same.count()  # no fewer than near copies, no more than equal fingerprints allow
    before, after = seen["decontamination"]
    leaks = ids(decontam.contamination(before, benchmark))
    assert leaks and ids(after) == ids(before) - leaks
    before, after = seen["mixing"]
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2} and set(counts) <= ids(before)
    assert seen["token_files"][1].count() == seen["token_files"][0].count()
    assert corpus_pipeline.run(spark, DIR).count() == seen["token_files"][1].count()


def test_empty_documents(spark):
    stage = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for name, f in corpus_pipeline.STAGES:
        stage = saved(f(spark, stage, DIR), f"test-{name}")
    assert stage.count() == 0
