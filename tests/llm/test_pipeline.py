"""The pipeline against its operators' decisions one by one."""

import corpus_pipeline
from lurescan.llm import decontaminate, near_dups, quality


def test_stages_keep_columns_and_decide(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = {r.doc_id: r.text for r in after.collect()}
        if name == "quality":
            expected = {r.doc_id for r in quality.judge(now, labels).where("_keep").collect()}
        elif name == "near_dups":
            expected = {r.class_id for r in near_dups.classes(now).collect()}
        elif name == "decontaminate":
            expected = {r.doc_id for r in decontaminate.hits(now, bench).where("NOT contaminated").collect()}
        else:
            expected = {r.doc_id for r in now.collect()}
            assert not any("@mail" in t for t in rows.values())
        assert set(rows) == expected
        now = spark.createDataFrame(after.collect(), docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in now.collect()}
