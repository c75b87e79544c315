"""Queries that decide: guardrails, best actions, flights, next steps, resolutions."""

from pyspark.sql import functions as F

from layover.functions import wording
from layover.operators import audit as au
from layover.operators import decisions, inventory, passengers
from layover.registry import audit as _audit  # noqa: F401  (shared oracle parts)
from layover.registry import part, query
from layover.registry.inventory import inv
from layover.registry.passengers import mean, rounded
from layover.sources import seeds
from layover.sources.testviews import AS_OF

# --- uplift --------------------------------------------------------------------------------

part(
    "d_guard",
    f"""SELECT *, CASE WHEN reasons <> '' THEN 'BLOCK' WHEN requires_human THEN 'ESCALATE' ELSE 'ALLOW' END AS verdict FROM (
 SELECT *, concat_ws(',',
  CASE WHEN archetype = 'SLEEPING_DOG' AND action_code = 'LOUNGE_PASS_MEAL' THEN 'VOUCHER_FOR_SLEEPING_DOG' END,
  CASE WHEN archetype = 'SURE_THING' AND cost_usd >= 100 AND mean_uplift <= 0.05 THEN 'COSTLY_FOR_SURE_THING' END,
  CASE WHEN mean_uplift < 0 THEN 'NEGATIVE_UPLIFT' END) AS reasons FROM (
  SELECT u.customer_id, u.archetype, u.action_id, s.action_code, s.cost_usd, s.requires_human, {mean('u.uplift_score')} AS mean_uplift
  FROM v_uplift u LEFT JOIN d_shelf s ON s.action_id = u.action_id GROUP BY ALL))""",
)
query(
    "guardrails",
    "SELECT customer_id, archetype, action_id, action_code, cost_usd, requires_human, mean_uplift, verdict, reasons FROM d_guard",
)(lambda t: rounded(decisions.guardrails(t.uplift, seeds.action_shelf(t.spark)).drop("first_experiment"), "mean_uplift"))

part(
    "d_best",
    """SELECT a.customer_id, a.archetype, coalesce(b.action_code, 'NO_ACTION_MONITOR') AS action_code, b.action_id, b.mean_uplift,
 coalesce(b.requires_human, false) AS requires_human
FROM d_archetype a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY mean_uplift DESC, cost_usd, action_id) AS rn
 FROM d_guard WHERE verdict <> 'BLOCK' AND mean_uplift > 0) b ON b.customer_id = a.customer_id AND b.rn = 1""",
)
query("best_action", "SELECT * FROM d_best")(
    lambda t: rounded(decisions.best_action(t.uplift, seeds.action_shelf(t.spark)), "mean_uplift")
)

part(
    "d_push",
    f"""SELECT e.pnr, e.customer_id, 'PUSH_NBA' AS scenario,
 CASE WHEN archetype = 'CHOICE_ORIENTED' THEN 'HOLD_AND_PROMPT' ELSE coalesce(action_code, 'NO_ACTION_MONITOR') END AS action_taken,
 CASE WHEN archetype = 'CHOICE_ORIENTED' THEN CAST(json_object('archetype', archetype, 'held_flights', ['EK372', 'EK380'],
   'push_prompt', '{wording.PUSH_PROMPT.replace("'", "''")}', 'handoff', 'AWAITING_PASSENGER_CHOICE') AS VARCHAR)
  ELSE CAST(json_object('archetype', coalesce(archetype, 'UNKNOWN'), 'action_code', coalesce(action_code, 'NO_ACTION_MONITOR')) AS VARCHAR) END AS reasoning,
 CASE WHEN archetype = 'CHOICE_ORIENTED' THEN 'STAGED_FOR_CONCIERGE' WHEN requires_human THEN 'PENDING_HUMAN' ELSE 'SUCCESS' END AS status,
 coalesce(archetype, 'UNKNOWN') AS archetype
FROM (SELECT DISTINCT pnr, customer_id FROM v_flight_events WHERE misconnect_risk) e
LEFT JOIN d_best b ON b.customer_id = e.customer_id""",
)


def routed(t):
    people = passengers.affected(t.flight_events)
    return decisions.push_routing(people, t.uplift, seeds.action_shelf(t.spark))


query("push_routing", "SELECT * FROM d_push")(routed)

part(
    "d_push_audit",
    """SELECT 'EXEC-2024-01-31-000000-' || customer_id || '-' || pnr AS exec_id,
 'CASE-' || customer_id || '-20240131000000' AS case_id, pnr, customer_id, scenario, action_taken, reasoning, status,
 true AS success_flag, TIMESTAMP '2024-01-31 00:00:00' AS executed_at FROM d_push""",
)
query("push_audit_rows", "SELECT * FROM d_push_audit")(lambda t: au.to_audit(routed(t), as_of=AS_OF))

query(
    "push_trace",
    f"""SELECT customer_id, pnr, CAST(row_number() OVER (PARTITION BY customer_id, pnr ORDER BY k) AS INTEGER) AS step, phase, detail, source FROM (
 SELECT customer_id, pnr, 1 AS k, 'TRIGGER' AS phase, (SELECT min(e.new_connection_mins) FROM v_flight_events e
   WHERE e.misconnect_risk AND e.customer_id = p.customer_id AND e.pnr = p.pnr) || ' minutes left to connect' AS detail, 'SYSTEM' AS source FROM d_push p
 UNION ALL SELECT p.customer_id, pnr, 2, 'PROFILE EVALUATION', 'Tier ' || loyalty_tier, 'Profile' FROM d_push p JOIN v_profile v ON v.customer_id = p.customer_id
 UNION ALL SELECT customer_id, pnr, 3, 'ARCHETYPE', archetype, 'SYSTEM' FROM d_push
 UNION ALL SELECT customer_id, pnr, 4, 'ICEBERG INVENTORY HOLD', 'Held: EK372, EK380', 'Inventory' FROM d_push WHERE status = 'STAGED_FOR_CONCIERGE'
 UNION ALL SELECT customer_id, pnr, 5, 'DECISION (Scenario A)', action_taken || ': ' || status, 'SYSTEM' FROM d_push
 UNION ALL SELECT customer_id, pnr, 6, 'PUSH NOTIFICATION', '{wording.PUSH_PROMPT.replace("'", "''")}', 'SYSTEM' FROM d_push WHERE status = 'STAGED_FOR_CONCIERGE')
WHERE detail IS NOT NULL""",
)(lambda t: decisions.push_trace(routed(t), t.flight_events, t.profile))

HELD = """i.alternate_flight IN ('EK372', 'EK380') AND i.pnr IN (SELECT pnr FROM d_push WHERE action_taken = 'HOLD_AND_PROMPT')"""
query(
    "push_holds",
    f"SELECT {inv(f'CASE WHEN {HELD} THEN {chr(39)}HELD{chr(39)} ELSE i.hold_status END', f'CASE WHEN {HELD} THEN {chr(39)}AVAILABLE{chr(39)} ELSE i.inventory_status END')} FROM v_inventory i",
)(
    lambda t: inventory.place_holds(
        t.inventory, routed(t).filter(F.col("action_taken") == "HOLD_AND_PROMPT")
    )
)

# --- flights -------------------------------------------------------------------------------

HOURS = """CAST(date_diff('day', CAST(departure_time AS DATE), CAST(arrival_time AS DATE)) * 24 + hour(arrival_time)
 + CASE WHEN date_trunc('hour', arrival_time) < arrival_time THEN 1 ELSE 0 END AS INTEGER)"""
part(
    "d_rules",
    f"""SELECT e.customer_id, e.pnr, p.loyalty_tier, i.alternate_flight AS flight_chosen, i.arrival_time, i.landing_hour, 50 AS voucher_usd
FROM (SELECT DISTINCT customer_id, pnr FROM v_flight_events WHERE misconnect_risk) e
JOIN v_profile p ON p.customer_id = e.customer_id AND p.loyalty_tier IN ('PLATINUM', 'GOLD')
LEFT JOIN (SELECT pnr, alternate_flight, arrival_time, {HOURS} AS landing_hour,
 row_number() OVER (PARTITION BY pnr ORDER BY arrival_time DESC, alternate_flight DESC, departure_time DESC) AS rn
 FROM v_inventory WHERE seats_available > 0) i ON i.pnr = e.pnr AND i.rn = 1""",
)
query("rules_baseline", "SELECT * FROM d_rules")(
    lambda t: decisions.rules_baseline(t.flight_events, t.profile, t.inventory)
)

part(
    "d_wish",
    """SELECT pnr, customer_id, arg_max(limit_hour IS NULL, turn) AS open_end, max(turn) AS turn FROM d_timeline GROUP BY 1, 2""",
)
part(
    "d_choice",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT t.pnr, t.customer_id, t.limit_hour, t.prefers_later, t.wants_quiet,
 i.alternate_flight AS chosen_flight, i.lookup_id, i.arrival_time, i.landing_hour,
 CASE WHEN t.wants_quiet THEN i.amenity_id END AS amenity_id,
 row_number() OVER (PARTITION BY t.pnr, t.customer_id ORDER BY
  CASE WHEN t.prefers_later THEN i.lounge_available END DESC,
  CASE WHEN t.prefers_later THEN i.arrival_time END DESC,
  CASE WHEN t.prefers_later THEN i.lookup_id END DESC,
  CASE WHEN t.wants_quiet AND NOT (coalesce(i.amenity_type, '') = 'QUIET_POD' AND i.amenity_status = 'AVAILABLE') THEN 1 ELSE 0 END,
  i.arrival_time, i.lookup_id) AS rn
 FROM d_timeline t JOIN d_wish w ON w.pnr = t.pnr AND w.turn = t.turn
 JOIN (SELECT *, {HOURS} AS landing_hour FROM v_inventory WHERE seats_available > 0) i ON i.pnr = t.pnr
 WHERE t.limit_hour IS NULL OR i.arrival_time <= date_trunc('day', i.departure_time) + INTERVAL '1' HOUR * t.limit_hour)
WHERE rn = 1""",
)
query("constraint_choice", "SELECT * FROM d_choice")(
    lambda t: decisions.constraint_choice(t.chat, t.inventory)
)

query(
    "rules_contrast",
    """SELECT c.pnr, c.customer_id, c.limit_hour, r.rule_flight, r.rule_arrival, r.voucher_usd, c.chosen_flight, c.arrival_time AS chosen_arrival,
 c.limit_hour IS NULL OR r.rule_hour <= c.limit_hour AS rule_meets_limit,
 c.limit_hour IS NULL OR c.landing_hour <= c.limit_hour AS choice_meets_limit
FROM d_choice c JOIN (SELECT DISTINCT pnr, flight_chosen AS rule_flight, arrival_time AS rule_arrival, landing_hour AS rule_hour, voucher_usd FROM d_rules) r
 ON r.pnr = c.pnr""",
)(lambda t: decisions.rules_contrast(t.flight_events, t.profile, t.chat, t.inventory))

# --- next steps and resolutions ------------------------------------------------------------

query(
    "next_step",
    """SELECT customer_id, step AS next_step, CASE WHEN step <> 'STAGE_FIRST' THEN case_id END AS case_id, messages, messages + 1 AS follow_up_number FROM (
 SELECT p.customer_id, s.case_id, coalesce(m.n, 0) AS messages,
 CASE WHEN s.exec_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_closed c WHERE c.case_id = s.case_id) THEN 'CONTINUE_STAGED_CASE'
  WHEN coalesce(m.n, 0) > 0 THEN 'HOLD_AGAIN_AND_CONTINUE' ELSE 'STAGE_FIRST' END AS step
 FROM v_profile p LEFT JOIN d_latest_staging s ON s.customer_id = p.customer_id
 LEFT JOIN (SELECT customer_id, count(*) AS n FROM v_chat GROUP BY 1) m ON m.customer_id = p.customer_id)""",
)(lambda t: decisions.next_step(t.profile, t.exec, t.chat))

part(
    "d_steps",
    """SELECT *, CASE WHEN nth = 1 AND open THEN 'CONTINUE_STAGED_CASE' WHEN turn > 0 THEN 'HOLD_AGAIN_AND_CONTINUE' ELSE 'STAGE_FIRST' END AS step
FROM (SELECT f.*, s.case_id AS staged_case, row_number() OVER (PARTITION BY f.customer_id ORDER BY f.signal_timestamp, f.signal_id) AS nth,
 s.exec_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_closed c WHERE c.case_id = s.case_id) AS open
 FROM d_final f LEFT JOIN d_latest_staging s ON s.customer_id = f.customer_id)""",
)
part("d_restaged", "SELECT customer_id, min(struct_pack(t := signal_timestamp, i := signal_id)) AS since FROM d_steps WHERE step = 'STAGE_FIRST' GROUP BY 1")
part(
    "d_cases",
    """SELECT s.*, step = 'STAGE_FIRST' OR (step = 'HOLD_AGAIN_AND_CONTINUE' AND coalesce(struct_pack(t := signal_timestamp, i := signal_id) >= since, false)) AS new_case
FROM d_steps s LEFT JOIN d_restaged r ON r.customer_id = s.customer_id""",
)
query(
    "concierge_steps",
    """SELECT signal_id, step, CASE WHEN new_case THEN 'CASE-' || customer_id || '-20240131000000' ELSE staged_case END AS case_id,
 turn // 2 + 1 AS follow_up_number FROM d_cases""",
)(
    lambda t: decisions.concierge_steps(t.agent_output, t.exec, as_of=AS_OF).select(
        "signal_id", "step", "case_id", "follow_up_number"
    )
)
part(
    "d_new_staging",
    f"""SELECT DISTINCT 'EXEC-2024-01-31-000000-' || customer_id || '-' || pnr AS exec_id, 'CASE-' || customer_id || '-20240131000000' AS case_id,
 pnr, customer_id, 'PUSH_NBA' AS scenario, 'HOLD_AND_PROMPT' AS action_taken,
 CAST(json_object('archetype', 'CHOICE_ORIENTED', 'held_flights', ['EK372', 'EK380'], 'push_prompt',
  '{wording.PUSH_PROMPT.replace("'", "''")}', 'handoff', 'AWAITING_PASSENGER_CHOICE') AS VARCHAR) AS reasoning,
 'STAGED_FOR_CONCIERGE' AS status, true AS success_flag, TIMESTAMP '2024-01-31 00:00:00' AS executed_at FROM d_steps WHERE step = 'STAGE_FIRST'""",
)
part(
    "d_pull",
    """SELECT 'EXEC-2024-01-31-000000-' || f.customer_id || '-' || f.signal_id AS exec_id,
 CASE WHEN new_case
  THEN 'CASE-' || f.customer_id || '-20240131000000'
  ELSE coalesce(nullif(staged_case, ''), 'CASE-' || f.customer_id || '-20240131000000') END AS case_id, f.pnr, f.customer_id,
 'PULL_CONCIERGE' AS scenario, f.action_code AS action_taken,
 CAST(json_object('chosen_flight', chosen_flight, 'seat', seat, 'amenity', amenity, 'action_code', action_code,
  'chat_message', message_text, 'chat_turns', turn + 1, 'agent_reasoning', reasoning_summary) AS VARCHAR) AS reasoning,
 'SUCCESS' AS status, true AS success_flag, TIMESTAMP '2024-01-31 00:00:00' AS executed_at
FROM d_cases f UNION ALL SELECT * FROM d_new_staging""",
)
# The same messages arriving in the opposite order: most have earlier turns before one without any stages anew.
part("d_back", "SELECT * REPLACE (TIMESTAMP '2026-08-12 13:00:00' - INTERVAL '1' MINUTE * CAST(turn AS INT) AS signal_timestamp) FROM v_agent_output")
part(
    "d_back_steps",
    """SELECT *, CASE WHEN nth = 1 AND open THEN 'CONTINUE_STAGED_CASE' WHEN turn > 0 THEN 'HOLD_AGAIN_AND_CONTINUE' ELSE 'STAGE_FIRST' END AS step
FROM (SELECT f.signal_id, f.customer_id, f.turn, f.signal_timestamp, s.case_id AS staged_case,
 row_number() OVER (PARTITION BY f.customer_id ORDER BY f.signal_timestamp, f.signal_id) AS nth,
 s.exec_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_closed c WHERE c.case_id = s.case_id) AS open
 FROM d_back f LEFT JOIN d_latest_staging s ON s.customer_id = f.customer_id)""",
)
query(
    "concierge_steps_in_order",
    """SELECT signal_id, step, turn // 2 + 1 AS follow_up_number,
 CASE WHEN step = 'STAGE_FIRST' OR (step = 'HOLD_AGAIN_AND_CONTINUE' AND coalesce(bool_or(step = 'STAGE_FIRST') OVER (PARTITION BY customer_id
   ORDER BY signal_timestamp, signal_id), false)) THEN 'CASE-' || customer_id || '-20240131000000' ELSE staged_case END AS case_id FROM d_back_steps""",
)(
    lambda t: decisions.concierge_steps(
        t.agent_output.withColumn(
            "signal_timestamp", F.expr("TIMESTAMP_NTZ '2026-08-12 13:00:00' - INTERVAL '1' MINUTE * CAST(turn AS INT)")
        ),
        t.exec,
        as_of=AS_OF,
    ).select("signal_id", "step", "case_id", "follow_up_number")
)
query("pull_resolution", "SELECT * FROM d_pull")(
    lambda t: decisions.pull_resolution(t.agent_output, t.exec, as_of=AS_OF)
)
