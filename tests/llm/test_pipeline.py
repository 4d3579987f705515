import os

import pytest

import corpus_pipeline
from util import awkward, docs
from bidlens.llm import decontam, langid, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")


def test_stages(spark, tmp_dir):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    outs, cur = {}, d
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, cur, SF).write.parquet(f"{tmp_dir}/{name}")
        cur = outs[name] = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "sharding":
            assert cur.columns == d.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    pred = {r.doc_id for r in langid.identify(d).where("lang_pred != 'und' and score >= 0.5").collect()}
    assert ids(outs["language_id"]) == pred
    near = simhash.near_duplicates(outs["language_id"]).collect()
    assert ids(outs["near_dedup"]) == {r.component_id for r in near}
    assert outs["near_dedup"].count() == len({r.component_id for r in near})
    bad = ids(decontam.contaminations(outs["near_dedup"], bench))
    assert bad and ids(outs["decontamination"]) == ids(outs["near_dedup"]) - bad
    assert ids(outs["mixing"]) <= ids(outs["decontamination"])
    assert outs["sharding"].count() == outs["mixing"].count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() > 0


def test_awkward_and_empty_input(spark, tmp_dir):
    for n, rows in enumerate((awkward(26), [])):
        cur = docs(spark, rows)
        cols = cur.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, cur, SF).write.parquet(f"{tmp_dir}/{n}/{name}")
            cur = spark.read.parquet(f"{tmp_dir}/{n}/{name}")
            if name != "sharding":
                assert cur.columns == cols
        assert (cur.count() > 0) == bool(rows)
