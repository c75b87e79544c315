"""What a join shuffles beside its columns."""

from layover.operators import keys


def test_the_hash_beside_the_key_is_short_and_changes_no_row(spark):
    facts = spark.range(200).selectExpr("CASE WHEN id % 7 > 0 THEN 'K' || id % 50 END AS k", "id")
    lookup = spark.range(40).selectExpr("'K' || id AS k", "id AS v")
    joined = keys.match(facts, lookup, "k", "left")
    assert "pmod(xxhash64" in joined._jdf.queryExecution().optimizedPlan().toString()
    plain = facts.join(lookup, "k", "left")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
