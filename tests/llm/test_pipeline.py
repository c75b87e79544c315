"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline as pipeline
from layover.llm import mixing, toxicity
from layover.llm.scratch import keep
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_passages import plain as without_repeats
from tests.llm.test_text import hold_packing, pairs


def test_stages(spark):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-copies", "repeated passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    columns = docs.columns

    def run(name, given):
        out = keep(stages[name](spark, given, SF_SMALL), "test-stage")
        assert name == "packing" or out.columns == columns
        return out

    fine = run("toxicity", docs)
    passed = {r["doc_id"] for r in toxicity.score(docs, labels).filter("score < 0.7").collect()}
    assert {i for i, _ in pairs(fine)} == passed

    single = run("near-copies", fine)
    known = brute.near_classes(pairs(fine))
    assert sorted(i for i, _ in pairs(single)) == sorted(i for i, (_, c) in known.items() if i == c)

    fresh = run("repeated passages", single)
    assert dict(pairs(fresh)) == without_repeats(pairs(single))
    assert all(r["n_chars"] == len(r["text"]) for r in fresh.collect() if r["text"] is not None)

    mixed = run("mixing", fresh)
    counted = {r["doc_id"]: r["copies"] for r in mixing.copies(fresh).collect()}
    assert Counter(i for i, _ in pairs(mixed)) == Counter({i: n for i, n in counted.items() if n})

    hold_packing(mixed, run("packing", mixed).collect())


def test_odd_rows_go_through(spark, odd, none, tmp_path):
    """All stages take null, empty, long, tied and repeated rows and other columns."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for given in (odd, none):
        docs = given
        for name, stage in pipeline.STAGES:
            docs = keep(stage(spark, docs, folder), "test-odd")
        assert (docs.count() > 0) == (given.count() > 0)


def test_every_text_of_an_id_stays(spark):
    docs = spark.createDataFrame([(1, "one text of its own", 9), (1, "and another one", 7), (1, "and another one", 7), (None, "x", 1)], "doc_id long, text string, __nth int")
    kept = pipeline.one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter({(1, "one text of its own", 9): 1, (1, "and another one", 7): 1, (None, "x", 1): 1})


def test_one_row_of_repeated_ones_stays(spark, odd):
    kept = pipeline.one_of_near_copies(spark, odd, "")
    ids = Counter(i for i, _ in pairs(kept))
    assert ids[6] == 1 and ids[None] == 2


def test_columns_of_the_caller_survive_every_stage(spark, tmp_path):
    """Names the operators use themselves, in any place, keep their values; null ids and sources too."""
    names = ["size", "target", "spans", "__ranges", "__nth", "__source", "__spans", "copies", "row", "again", "source_size", "sig", "n"]
    kinds = ", ".join(f"{n} {'string' if n in ('target', 'row', '__source') else 'int'}" for n in names)
    shared = " ".join(f"shared{k}" for k in range(30))
    made = []
    for i in range(24):
        text = f"own{i} words{i} of{i} text{i} number{i} {shared if i % 2 else ''} tail{i} end{i}"
        extra = [str(i * 10 + k) if n in ("target", "row", "__source") else i * 10 + k for k, n in enumerate(names)]
        made.append((*extra[:6], None if i == 7 else i, text, "en", None if i % 5 == 0 else f"s{i % 2}", len(text), *extra[6:]))
    schema = ", ".join([*kinds.split(", ")[:6], "doc_id long, text string, lang string, source string, n_chars long", *kinds.split(", ")[6:]])
    docs = spark.createDataFrame(made, schema).repartition(3)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {r["size"]: r for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, str(tmp_path)), "test-columns")
        assert docs.dtypes == [(c, t) for c, t in spark.createDataFrame([], schema).dtypes], name
        for r in docs.collect():
            for c in docs.columns:
                if c not in ("text", "n_chars"):
                    assert r[c] == known[r["size"]][c], (name, c)
        if name in ("near-copies", "repeated passages"):
            assert len({r["size"] for r in docs.collect()}) == 24
