"""Passengers in a disruption: who is affected, who they are, what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.functions import outcome
from layover.functions import text as tx
from layover.functions.exact import comparable_avg, exact_avg
from layover.operators.keys import attach, newest_rank

def affected(events: DataFrame, event_prefix: str | None = None) -> DataFrame:
    """Distinct passengers at risk of a misconnect; with a prefix, in events whose id starts with it."""
    hit = F.col("misconnect_risk")
    if event_prefix:
        hit = hit & F.col("event_id").startswith(event_prefix)
    return (
        events.filter(hit)
        .select("customer_id", "pnr", "event_id", "new_connection_mins", "misconnect_risk")
        .distinct()
    )


def misconnects(events: DataFrame, threshold_mins: int = 40) -> DataFrame:
    """Trigger rule: the connection got shorter and is now under the threshold.

    A plain filter, so the same function serves tables and streams.
    """
    now, before = F.col("new_connection_mins"), F.col("orig_connection_mins")
    return events.filter((now < threshold_mins) & (now < before))


def in_target_order(passengers: DataFrame, targets: list[str] | DataFrame) -> DataFrame:
    """Listed customers only, ordered by their place in the list.

    ``targets`` is a short list, or a table of (customer_id, rank) with one row per customer.
    """
    if isinstance(targets, DataFrame):
        ranked = attach(passengers, targets.select("customer_id", "rank"), "customer_id", "inner")
    else:
        places = {customer: i for i, customer in enumerate(targets)}
        lookup = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        listed = passengers.filter(F.col("customer_id").isin(list(places)))
        ranked = listed.withColumn("rank", F.try_element_at(lookup, F.col("customer_id")))
    return ranked.orderBy("rank", "customer_id", "pnr", "event_id")


def disruption_board(events: DataFrame) -> DataFrame:
    """Board rows: connection before and after, minutes lost, risk flag."""
    before, now = F.col("orig_connection_mins"), F.col("new_connection_mins")
    return events.select(
        "customer_id",
        "pnr",
        "itinerary",
        F.format_string("%dm → %dm", before, now).alias("connection"),
        (before - now).alias("minutes_lost"),
        "misconnect_risk",
    )


# --- context -------------------------------------------------------------------------------


def signal_summary(signals: DataFrame, key: str = "customer_id") -> DataFrame:
    """One bounded row per customer: how many signals, and the newest one.

    The messages themselves are not gathered into one row, because a single customer may own
    any share of them; ``context_items`` lists them all.
    """
    newest = newest_rank(F.col("signal_timestamp"), F.col("signal_id"))
    latest = F.max_by(F.struct("signal_timestamp", "sentiment", "message_text"), newest)
    return (
        signals.groupBy(key)
        .agg(F.count(F.lit(1)).alias("signals"), latest.alias("latest"))
        .select(
            key,
            "signals",
            F.col("latest.signal_timestamp").alias("latest_signal_at"),
            F.col("latest.sentiment").alias("latest_sentiment"),
            F.col("latest.message_text").alias("latest_message"),
        )
    )


def passenger_context(events: DataFrame, signals: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every event with its customer's signal summary and profile."""
    # Both lookups hold one row per customer, so they meet first and the events move once.
    customer = signal_summary(signals).join(profiles, "customer_id", "full")
    known = attach(events, customer, "customer_id")
    return known.withColumn("signals", F.coalesce("signals", F.lit(0)))


def context_items(events: DataFrame, signals: DataFrame) -> DataFrame:
    """All events and all chat signals of all customers, with all their columns, as one long table.

    Columns an item does not have are null.  Nothing is joined or shuffled.
    """
    happened = events.withColumnsRenamed({"event_id": "item_id", "event_timestamp": "item_at"})
    said = signals.withColumnsRenamed({"signal_id": "item_id", "signal_timestamp": "item_at"})
    return happened.withColumn("kind", F.lit("EVENT")).unionByName(
        said.withColumn("kind", F.lit("SIGNAL")), allowMissingColumns=True
    )


# --- uplift history ------------------------------------------------------------------------


def uplift_with_actions(uplift: DataFrame, shelf: DataFrame) -> DataFrame:
    """Experiments with the action they tried.  Unknown actions keep their row."""
    return attach(uplift, shelf, "action_id")


def first_archetype(uplift: DataFrame) -> DataFrame:
    """Archetype of each customer's first experiment (lowest id)."""
    return uplift.groupBy("customer_id").agg(
        F.min_by("archetype", "experiment_id").alias("archetype")
    )


def segment_cards(profiles: DataFrame, uplift: DataFrame) -> DataFrame:
    """Profile with its segment; UNKNOWN where there is no experiment."""
    segment = F.coalesce("archetype", F.lit(outcome.UNKNOWN))
    return profiles.join(first_archetype(uplift), "customer_id", "left").select(
        "customer_id",
        segment.alias("segment"),
        outcome.segment_class(segment).alias("segment_class"),
        "full_name",
        "loyalty_tier",
        "lifetime_spend_usd",
        "base_retention_propensity",
    )


def uplift_by_segment(uplift: DataFrame) -> DataFrame:
    """Experiments and mean uplift per archetype and action."""
    return uplift.groupBy("archetype", "action_id").agg(
        F.count(F.lit(1)).alias("experiments"),
        exact_avg(F.col("uplift_score")).alias("mean_uplift"),
    )


def holdout_lift(uplift: DataFrame) -> DataFrame:
    """Mean outcome with the gesture, without it, and the difference."""
    score, treated = F.col("uplift_score"), F.col("gesture_applied")
    arms = uplift.groupBy("archetype", "action_id").agg(
        F.count_if(treated).alias("treated"),
        F.count_if(~treated).alias("holdout"),
        exact_avg(F.when(treated, score)).alias("treated_mean"),
        exact_avg(F.when(~treated, score)).alias("holdout_mean"),
    )
    return arms.withColumn("lift", F.col("treated_mean") - F.col("holdout_mean"))


def mean_uplift(uplift: DataFrame, *keys: str) -> DataFrame:
    """Mean uplift per key, rounded so that it can be held against limits."""
    return uplift.groupBy(*keys).agg(comparable_avg(F.col("uplift_score")).alias("mean_uplift"))


def effort(propensity: Column, best_uplift: Column, high: float, worthwhile: float) -> Column:
    """Where effort pays: uplift decides, propensity only separates the rest."""
    return (
        F.when(best_uplift.isNull(), "NO_HISTORY")
        .when(best_uplift < 0, "AVOID")
        .when(best_uplift >= worthwhile, "INVEST")
        .when(propensity >= high, "LEAVE_ALONE")
        .otherwise("LOW_RETURN")
    )


def propensity_vs_uplift(
    profiles: DataFrame,
    uplift: DataFrame,
    high_propensity: float = 0.5,
    worthwhile_uplift: float = 0.05,
) -> DataFrame:
    """Retention propensity against the best mean uplift any action reached per customer."""
    best = (
        mean_uplift(uplift, "customer_id", "action_id")
        .groupBy("customer_id")
        .agg(F.max("mean_uplift").alias("best_uplift"))
    )
    propensity = F.col("base_retention_propensity")
    return profiles.join(best, "customer_id", "left").select(
        "customer_id",
        "loyalty_tier",
        propensity,
        "best_uplift",
        effort(propensity, F.col("best_uplift"), high_propensity, worthwhile_uplift).alias("effort"),
    )


# --- profiles ------------------------------------------------------------------------------


def tier_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("loyalty_tier").agg(F.count(F.lit(1)).alias("passengers"))


def tier_average_spend(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("loyalty_tier").agg(
        exact_avg(F.col("lifetime_spend_usd")).alias("avg_lifetime_spend")
    )


def top_propensity(profiles: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` passengers most likely to stay, ties by customer id."""
    return (
        profiles.select("customer_id", "loyalty_tier", "base_retention_propensity")
        .orderBy(F.col("base_retention_propensity").desc_nulls_last(), "customer_id")
        .limit(n)
    )


def profile_field_rows(profiles: DataFrame, text: str, key: str = "customer_id") -> DataFrame:
    """Fields of a profile text as rows: (key, field, value)."""
    return profiles.select(key, F.explode(tx.profile_fields(F.col(text))).alias("field", "value"))


def profile_highlights(profiles: DataFrame, text: str, key: str = "customer_id") -> DataFrame:
    """The fields shown on a card as rows: (key, label, value), blanks left out."""
    rows = profile_field_rows(profiles, text, key)
    labelled = rows.withColumn("label", tx.highlight_label(F.col("field")))
    return labelled.filter("label IS NOT NULL AND value <> ''").select(
        key, "label", tx.highlight_value(F.col("label"), F.col("value")).alias("value")
    )
