"""How members that differ from one centre are dealt over tasks."""

from pyspark.accumulators import AccumulatorParam

from layover.llm import minhash

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}


class Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def test_members_of_one_centre_are_dealt_over_tasks(spark, monkeypatch):
    dealt, differences = spark.sparkContext.accumulator([], Lists()), minhash.differences

    def watched(threshold_pct):
        def run(batches):
            batches = list(batches)
            if batches:
                dealt.add([sum(b.num_rows for b in batches)])
            yield from differences(threshold_pct)(iter(batches))

        return run

    monkeypatch.setattr(minhash, "differences", watched)
    old = {k: spark.conf.get(k) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        members = spark.createDataFrame([(7, i, i, 1) for i in range(200)], "bucket long, id long, label long, degree long")
        large = spark.createDataFrame([(7, 0, 0)], "bucket long, main long, centre long")
        texts = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(200)], "doc_id long, text string")
        signed = spark.createDataFrame([], "doc_id long, sig array<long>")
        checked = spark.createDataFrame([], "a long, b long")
        minhash.meet_by_differences(large, members, signed, texts, checked, 75)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(dealt.value) == 199
    assert len(dealt.value) == 8 and max(dealt.value) <= 60
