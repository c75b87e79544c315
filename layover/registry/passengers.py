"""Queries about passengers, their profiles and their uplift history."""

from pyspark.sql import functions as F

from layover.operators import crossings
from layover.operators import passengers as px
from layover.operators.keys import newest_first, rows_for
from layover.registry import part, query
from layover.sources import seeds

part(
    "d_shelf",
    f"""SELECT * REPLACE (CAST(cost_usd AS DOUBLE) AS cost_usd) FROM ({seeds.values_sql('action_gesture_shelf')})
 AS s(action_id, action_code, action_description, cost_usd, requires_human, policy_notes)""",
)
DIGITS = 9  # means are compared to so many digits; a plain sum of doubles is no more exact


def mean(x: str) -> str:
    return f"(round(sum({x}) / count({x}), {DIGITS}) + 0.0)"  # no negative zero


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


query("scan_flight_events", "SELECT * FROM v_flight_events")(lambda t: t.flight_events)

query(
    "profile_lookup",
    "SELECT * FROM v_profile WHERE customer_id IN (SELECT customer_id FROM v_flight_events WHERE misconnect_risk)",
)(lambda t: rows_for(t.profile, "customer_id", t.flight_events.filter("misconnect_risk")))

query(
    "events_for_customer",
    "SELECT * FROM v_flight_events WHERE customer_id IN (SELECT customer_id FROM v_chat)",
)(lambda t: rows_for(t.flight_events, "customer_id", t.chat))

query(
    "signals_for_customer",
    "SELECT * FROM v_chat WHERE customer_id IN (SELECT customer_id FROM v_flight_events WHERE misconnect_risk)",
)(lambda t: rows_for(t.chat, "customer_id", t.flight_events.filter("misconnect_risk")))

query(
    "uplift_for_customer",
    "SELECT * FROM v_uplift WHERE customer_id IN (SELECT customer_id FROM v_chat)",
)(lambda t: rows_for(t.uplift, "customer_id", t.chat))

query(
    "affected_passengers",
    """SELECT DISTINCT customer_id, pnr, event_id, new_connection_mins, misconnect_risk
FROM v_flight_events WHERE misconnect_risk AND event_id LIKE 'EVT-900%'""",
)(lambda t: px.affected(t.flight_events, "EVT-900"))


@query(
    "target_order",
    """SELECT DISTINCT e.customer_id, e.pnr, e.event_id, e.new_connection_mins, e.misconnect_risk, p.lifetime_flights AS rank
FROM v_flight_events e JOIN v_profile p ON p.customer_id = e.customer_id
WHERE e.misconnect_risk AND p.loyalty_tier = 'PLATINUM' ORDER BY rank, customer_id, pnr""",
)
def target_order(t):
    listed = t.profile.filter("loyalty_tier = 'PLATINUM'").select(
        "customer_id", F.col("lifetime_flights").alias("rank")
    )
    return px.in_target_order(px.affected(t.flight_events), listed)


query(
    "disruption_board",
    """SELECT customer_id, pnr, itinerary, orig_connection_mins || 'm → ' || new_connection_mins || 'm' AS connection,
 orig_connection_mins - new_connection_mins AS minutes_lost, misconnect_risk FROM v_flight_events""",
)(lambda t: px.disruption_board(t.flight_events))

query(
    "misconnect_trigger",
    "SELECT * FROM v_flight_events WHERE new_connection_mins < 40 AND new_connection_mins < orig_connection_mins",
)(lambda t: px.misconnects(t.flight_events, 40))

query(
    "misconnect_crossings",
    """SELECT * EXCLUDE (below, before) FROM (
 SELECT *, lag(below) OVER (PARTITION BY customer_id ORDER BY event_timestamp NULLS LAST, pnr) AS before FROM (
  SELECT *, new_connection_mins < 60 AND new_connection_mins < orig_connection_mins AS below FROM v_flight_events))
WHERE below AND NOT coalesce(before, false)""",
)(lambda t: crossings.crossings(t.flight_events, 60, key="customer_id", tie="pnr"))

query("events_recent", "SELECT * FROM v_flight_events ORDER BY event_timestamp DESC, pnr DESC")(
    lambda t: t.flight_events.orderBy(*newest_first("event_timestamp", "pnr"))
)
query("signals_recent", "SELECT * FROM v_chat ORDER BY signal_timestamp DESC, signal_id DESC")(
    lambda t: t.chat.orderBy(*newest_first("signal_timestamp", "signal_id"))
)

# --- context -------------------------------------------------------------------------------

part(
    "d_signals",
    """SELECT customer_id, count(*) AS signals, max(signal_timestamp) AS latest_signal_at,
 arg_max(sentiment, signal_timestamp) AS latest_sentiment
FROM v_chat GROUP BY customer_id""",
)
query(
    "passenger_context",
    """SELECT e.*, coalesce(s.signals, 0) AS signals, s.latest_signal_at, s.latest_sentiment,
 (SELECT c.message_text FROM v_chat c WHERE c.customer_id = e.customer_id AND c.signal_timestamp = s.latest_signal_at) AS latest_message,
 p.full_name, p.loyalty_tier, p.lifetime_spend_usd, p.lifetime_flights, p.cabin_class_preference, p.base_retention_propensity
FROM v_flight_events e LEFT JOIN d_signals s ON s.customer_id = e.customer_id
LEFT JOIN v_profile p ON p.customer_id = e.customer_id""",
)(lambda t: px.passenger_context(t.flight_events, t.chat, t.profile))

query(
    "context_items",
    """SELECT customer_id, pnr, 'EVENT' AS kind, event_id AS item_id, event_timestamp AS item_at, flight_number, itinerary,
 orig_connection_mins, new_connection_mins, misconnect_risk, NULL::VARCHAR AS sentiment, NULL::VARCHAR AS message_text FROM v_flight_events
UNION ALL SELECT customer_id, pnr, 'SIGNAL', signal_id, signal_timestamp, NULL, NULL, NULL, NULL, NULL, sentiment, message_text FROM v_chat""",
)(lambda t: px.context_items(t.flight_events, t.chat))

# --- uplift --------------------------------------------------------------------------------

query(
    "uplift_with_actions",
    """SELECT u.*, s.action_code, s.action_description, s.cost_usd, s.requires_human, s.policy_notes
FROM v_uplift u LEFT JOIN d_shelf s ON s.action_id = u.action_id""",
)(lambda t: px.uplift_with_actions(t.uplift, seeds.action_shelf(t.spark)))

part(
    "d_archetype",
    "SELECT customer_id, arg_min(archetype, experiment_id) AS archetype FROM v_uplift GROUP BY customer_id",
)
query("customer_archetype", "SELECT * FROM d_archetype")(lambda t: px.first_archetype(t.uplift))

part(
    "d_cards",
    """SELECT p.customer_id, coalesce(a.archetype, 'UNKNOWN') AS segment, p.full_name, p.loyalty_tier,
 p.lifetime_spend_usd, p.base_retention_propensity
FROM v_profile p LEFT JOIN d_archetype a ON a.customer_id = p.customer_id""",
)
SEGMENT_CLASS = """CASE WHEN segment LIKE '%SURE%' THEN 'sure-thing' WHEN segment LIKE '%PERSUADABLE%' THEN 'persuadable'
 WHEN segment LIKE '%SLEEPING%' THEN 'sleeping-dog' WHEN segment LIKE '%CHOICE%' THEN 'choice-oriented' ELSE '' END AS segment_class"""
query("segment_cards", f"SELECT *, {SEGMENT_CLASS} FROM d_cards")(
    lambda t: px.segment_cards(t.profile, t.uplift)
)
query("segment_class", f"SELECT customer_id, {SEGMENT_CLASS} FROM d_cards")(
    lambda t: px.segment_cards(t.profile, t.uplift).select("customer_id", "segment_class")
)

query(
    "uplift_by_segment",
    f"""SELECT archetype, action_id, count(*) AS experiments, {mean('uplift_score')} AS mean_uplift
FROM v_uplift GROUP BY archetype, action_id""",
)(lambda t: rounded(px.uplift_by_segment(t.uplift), "mean_uplift"))

query(
    "holdout_lift",
    f"""SELECT * REPLACE (round(treated_mean, {DIGITS}) + 0.0 AS treated_mean, round(holdout_mean, {DIGITS}) + 0.0 AS holdout_mean),
 round(treated_mean - holdout_mean, {DIGITS}) + 0.0 AS lift FROM (
 SELECT archetype, action_id, count(*) FILTER (WHERE gesture_applied) AS treated,
 count(*) FILTER (WHERE NOT gesture_applied) AS holdout,
 avg(uplift_score) FILTER (WHERE gesture_applied) AS treated_mean,
 avg(uplift_score) FILTER (WHERE NOT gesture_applied) AS holdout_mean
 FROM v_uplift GROUP BY archetype, action_id)""",
)(lambda t: rounded(px.holdout_lift(t.uplift), "treated_mean", "holdout_mean", "lift"))

query(
    "propensity_vs_uplift",
    f"""SELECT p.customer_id, p.loyalty_tier, p.base_retention_propensity, b.best_uplift,
 CASE WHEN b.best_uplift IS NULL THEN 'NO_HISTORY' WHEN b.best_uplift < 0 THEN 'AVOID'
  WHEN b.best_uplift >= 0.05 THEN 'INVEST' WHEN p.base_retention_propensity >= 0.5 THEN 'LEAVE_ALONE'
  ELSE 'LOW_RETURN' END AS effort
FROM v_profile p LEFT JOIN (SELECT customer_id, max(m) AS best_uplift FROM
 (SELECT customer_id, action_id, {mean('uplift_score')} AS m FROM v_uplift GROUP BY 1, 2) GROUP BY 1) b
 ON b.customer_id = p.customer_id""",
)(lambda t: rounded(px.propensity_vs_uplift(t.profile, t.uplift), "best_uplift"))

# --- profiles ------------------------------------------------------------------------------

query("tier_counts", "SELECT loyalty_tier, count(*) AS passengers FROM v_profile GROUP BY 1")(
    lambda t: px.tier_counts(t.profile)
)
query(
    "tier_avg_spend",
    f"SELECT loyalty_tier, {mean('lifetime_spend_usd')} AS avg_lifetime_spend FROM v_profile GROUP BY 1",
)(lambda t: rounded(px.tier_average_spend(t.profile), "avg_lifetime_spend"))
query(
    "top_propensity",
    """SELECT customer_id, loyalty_tier, base_retention_propensity FROM v_profile
ORDER BY base_retention_propensity DESC, customer_id LIMIT 10""",
)(lambda t: px.top_propensity(t.profile, 10))
