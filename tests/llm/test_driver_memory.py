"""Plans and shuffles of steps that are over are let go while near-copies and the pipeline run."""

import corpus_pipeline
from layover.llm import minhash


def test_every_round_of_near_copies_lets_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(minhash, "release", calls.append)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:-1] + [f"own{i}"])) for i in range(5)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert len(calls) >= 2


def test_every_stage_of_the_pipeline_lets_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", calls.append)
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, sf_dir, name: spark.range(3))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, p: d), ("two", lambda s, d, p: d)])
    assert corpus_pipeline.run(spark, "").count() == 3
    assert len(calls) == 2
