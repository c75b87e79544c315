"""Means that only the last bits of a division tell from a limit or from each other."""

from layover.operators import decisions, passengers

HISTORY = "experiment_id string, customer_id string, archetype string, action_id string, uplift_score double"
SHELF = "action_id string, action_code string, cost_usd double, requires_human boolean"


def history(spark, *scores):
    """Scores per action of one customer, as a table of experiments."""
    rows = [(f"EXP-{a}-{i}", "CUST-1", "SURE_THING", f"ACT-00{a}", x) for a, xs in scores for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, HISTORY)


def test_a_mean_on_the_limit_is_worthwhile(spark):
    # 0.05 + 0.03 + 0.07 is 0.15, and 0.15 / 3 is 0.049999999999999996 in doubles.
    uplift = history(spark, (1, [0.05, 0.03, 0.07]))
    profiles = spark.createDataFrame(
        [("CUST-1", "GOLD", 0.9)], "customer_id string, loyalty_tier string, base_retention_propensity double"
    )
    assert passengers.propensity_vs_uplift(profiles, uplift).collect()[0]["effort"] == "INVEST"


def test_equal_means_go_to_the_cheaper_action(spark):
    # 0.17 + 0.17 + 0.17 over 3 and 0.17 over 1: the first was 0.17000000000000001 above the second.
    for scores in ([0.1, 0.2, 0.21], [0.05, 0.22, 0.24], [0.07, 0.17, 0.27], [0.1700004, 0.17, 0.1700008]):
        mean = round(sum(scores) / 3, 9)
        for cheap, dear in (([mean], scores), (scores, [mean])):
            uplift = history(spark, (1, dear), (2, cheap))
            shelf = spark.createDataFrame([("ACT-001", "DEAR", 90.0, False), ("ACT-002", "CHEAP", 10.0, False)], SHELF)
            assert decisions.best_action(uplift, shelf).collect()[0]["action_code"] == "CHEAP"
