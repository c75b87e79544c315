"""Queries about text, JSON and chat."""

from pyspark.sql import functions as F

from layover.functions import text as tx
from layover.functions import wording
from layover.functions.clock import parse_moment
from layover.operators import chat, decisions
from layover.operators import passengers as px
from layover.registry import part, query
from layover.sources.testviews import AS_OF


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_phrase(column: str, phrases: list[str]) -> str:
    tests = [f"contains(lower(coalesce({column}, '')), {quoted(p)})" for p in phrases]
    return "(" + " OR ".join(tests) + ")"


CHANGES = any_phrase("message_text", wording.CHANGE_OF_MIND)
CLAIMS = any_phrase("message_text", wording.CANCELLATION_CLAIMS)
LIMIT_RE = r"'cannot land after (\d{1,2})\s*(AM|PM)'"
LIMIT_NUMBER = f"CAST(nullif(regexp_extract(message_text, {LIMIT_RE}, 1, 'i'), '') AS INT)"
LIMIT = f"""CASE WHEN upper(regexp_extract(message_text, {LIMIT_RE}, 2, 'i')) = 'PM'
 THEN {LIMIT_NUMBER} % 12 + 12 ELSE {LIMIT_NUMBER} % 12 END"""
QUIET = "coalesce(regexp_matches(message_text, 'quiet (place|work|pod|space)', 'i'), false)"

# --- times, ids and lists ------------------------------------------------------------------

query(
    "parse_timestamps",
    r"""SELECT event_id, time_text, CASE
 WHEN regexp_matches(trim(time_text), '^\d{4}-\d{2}-\d{2}[ T]') THEN try_cast(replace(substr(trim(time_text), 1, 19), 'T', ' ') AS TIMESTAMP)
 WHEN regexp_matches(trim(time_text), '^[A-Za-z]{3}, ') THEN try_strptime(substr(trim(time_text), 6, 20), '%d %b %Y %H:%M:%S')
 END AS parsed FROM v_time_text""",
)(lambda t: t.time_text.withColumn("parsed", parse_moment(F.col("time_text"))))

query(
    "extract_flight",
    """SELECT exec_id,
 CASE WHEN contains(upper(coalesce(code, '')), 'EK380') AND NOT contains(upper(coalesce(code, '')), 'EK372') THEN 'EK380' ELSE 'EK372' END AS offered,
 nullif(regexp_extract(upper(reasoning), 'EK\\d{3}'), '') AS first_code
FROM (SELECT *, CASE WHEN json_valid(reasoning) THEN reasoning END ->> '$.chosen_flight' AS code FROM v_exec)""".replace(
        "\\\\", "\\"
    ),
)(
    lambda t: t.exec.select(
        "exec_id",
        tx.offered_flight(
            tx.json_fields(F.col("reasoning"), "chosen_flight")["chosen_flight"]
        ).alias("offered"),
        tx.first_flight_code(F.col("reasoning")).alias("first_code"),
    )
)

query(
    "split_flights",
    """SELECT lookup_id, array_to_string(flights, '|') AS flights, CAST(len(flights) AS INTEGER) AS n FROM (SELECT lookup_id,
 list_filter(list_transform(string_split(' ' || alternate_flight || ', ' || coalesce(amenity_id, '') || ' ,EK380,,', ','),
  lambda x: trim(x)), lambda x: x <> '') AS flights FROM v_inventory)""",
)(
    lambda t: t.inventory.select(
        "lookup_id",
        tx.flight_list(
            F.concat(
                F.lit(" "), "alternate_flight", F.lit(", "),
                F.coalesce("amenity_id", F.lit("")), F.lit(" ,EK380,,"),
            )
        ).alias("flights"),
    ).select("lookup_id", F.array_join("flights", "|").alias("flights"), F.size("flights").alias("n"))
)

query(
    "truncate_text",
    "SELECT conv_id, turn, substr(text, 1, 200) AS head, substr(text, 1, 600) AS longer FROM v_turns",
)(
    lambda t: t.turns.select(
        "conv_id", "turn",
        tx.clipped(F.col("text"), 200).alias("head"), tx.clipped(F.col("text"), 600).alias("longer"),
    )
)

query(
    "reasoning_json",
    """SELECT exec_id, CAST(json_object('archetype', action_taken, 'held_flights', ['EK372', 'EK380'],
 'push_prompt', '%s', 'handoff', 'AWAITING_PASSENGER_CHOICE') AS VARCHAR) AS made
FROM v_exec"""
    % wording.PUSH_PROMPT.replace("'", "''"),
)(
    lambda t: t.exec.select(
        "exec_id",
        tx.staging_reasoning(
            F.col("action_taken"), F.array(*[F.lit(f) for f in wording.HELD_FLIGHTS])
        ).alias("made"),
    )
)

# --- profile text --------------------------------------------------------------------------

part(
    "d_fields",
    r"""SELECT customer_id, trim(regexp_extract(line, '^\s*[-•*]?\s*([^:]+):\s*(.+)$', 1)) AS field,
 arg_max(trim(regexp_extract(line, '^\s*[-•*]?\s*([^:]+):\s*(.+)$', 2)), pos) AS value
FROM (SELECT customer_id, unnest(string_split(profile, chr(10))) AS line,
  generate_subscripts(string_split(profile, chr(10)), 1) AS pos FROM v_profile_text)
WHERE regexp_matches(line, '^\s*[-•*]?\s*([^:]+):\s*(.+)$') GROUP BY 1, 2""",
)
query("profile_fields", "SELECT * FROM d_fields")(
    lambda t: px.profile_field_rows(t.profile_text, "profile")
)
query(
    "profile_highlights",
    r"""SELECT customer_id, label, CASE WHEN label = 'Spend' THEN '$' ||
 coalesce(regexp_replace(format('{:,.3f}', try_cast(value AS DOUBLE)), '\.?0+$', ''), 'NaN') ELSE value END AS value
FROM d_fields JOIN (VALUES ('Name', 'Full Name'), ('Tier', 'Loyalty Tier'), ('Spend', 'Lifetime Spend (USD)'),
 ('Propensity', 'Base Retention Propensity'), ('Last outcome', 'Last Disruption Outcome')) h(label, field) USING (field)
WHERE value <> ''""",
)(lambda t: px.profile_highlights(t.profile_text, "profile"))

# --- chat ----------------------------------------------------------------------------------

query("change_of_mind", f"SELECT signal_id, {CHANGES} AS changes_mind FROM v_chat")(
    lambda t: chat.message_flags(t.chat).select("signal_id", "changes_mind")
)
query("implies_cancel", f"SELECT signal_id, {CLAIMS} AS claims_cancellation FROM v_chat")(
    lambda t: chat.message_flags(t.chat).select("signal_id", "claims_cancellation")
)
query(
    "chat_constraints",
    f"""SELECT signal_id, {LIMIT} AS limit_hour, {QUIET} AS wants_quiet,
 coalesce(regexp_matches(message_text, 'lounge', 'i'), false) AS wants_lounge FROM v_chat""",
)(
    lambda t: chat.message_flags(t.chat).select(
        "signal_id", "limit_hour", "wants_quiet", "wants_lounge"
    )
)

part(
    "d_markers",
    f"""SELECT *, CASE WHEN {CHANGES} THEN -1 ELSE {LIMIT} END AS lim,
 CASE WHEN {CHANGES} THEN false WHEN {QUIET} THEN true END AS qui FROM v_chat_turns""",
)
part(
    "d_timeline",
    """SELECT conv_id, turn, pnr, customer_id, nullif(lim, -1) AS limit_hour,
 coalesce(lim = -1, false) AS prefers_later, coalesce(qui, false) AS wants_quiet
FROM (SELECT conv_id, turn, pnr, customer_id, last_value(lim IGNORE NULLS) OVER w AS lim, last_value(qui IGNORE NULLS) OVER w AS qui
 FROM d_markers WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
query(
    "constraint_timeline",
    "SELECT conv_id, turn, limit_hour, prefers_later, wants_quiet FROM d_timeline",
)(lambda t: chat.constraint_timeline(t.chat_turns))

query(
    "latest_message",
    "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM v_turns WHERE role = 'user' GROUP BY conv_id",
)(lambda t: chat.latest_message(t.turns))

query(
    "chat_turns",
    "SELECT conv_id, count(*) AS chat_turns, (count(*) - 1) // 2 + 1 AS follow_up_number FROM v_turns GROUP BY conv_id",
)(lambda t: chat.chat_turns(t.turns))

PAGE = 1000  # more turns than a test conversation has
part("d_last_turn", "SELECT conv_id, max(turn) AS last_turn FROM v_turns WHERE role = 'user' GROUP BY conv_id")
query(
    "transcript",
    """SELECT l.conv_id, 0::BIGINT AS page, count(t.turn) AS turns,
 coalesce(string_agg('[' || upper(coalesce(t.role, 'passenger')) || ']: ' || coalesce(t.text, ''), chr(10) ORDER BY t.turn) FILTER (WHERE t.turn IS NOT NULL),
  '%s') AS transcript
FROM d_last_turn l LEFT JOIN v_turns t ON t.conv_id = l.conv_id AND t.turn < l.last_turn GROUP BY l.conv_id"""
    % wording.NO_TURNS,
)(lambda t: chat.transcripts(chat.prior_turns(t.turns), PAGE, chat.latest_turn(t.turns)))
query(
    "transcript_lines",
    "SELECT conv_id, turn, '[' || upper(coalesce(role, 'passenger')) || ']: ' || coalesce(text, '') AS line FROM v_turns",
)(lambda t: chat.transcript_lines(t.turns))
query(
    "transcript_pages",
    """SELECT conv_id, turn // 2 AS page, count(*) AS turns,
 string_agg('[' || upper(coalesce(role, 'passenger')) || ']: ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript
FROM v_turns GROUP BY conv_id, turn // 2""",
)(lambda t: chat.transcripts(t.turns, 2))

# --- agent answers -------------------------------------------------------------------------

_F = wording.DECISION_FIELDS
part(
    "d_candidates",
    r"""SELECT *, list_filter(list_filter(list_concat(
  regexp_extract_all(coalesce(agent_text, ''), '```(?:json)?\s*(\{.*?\})\s*```', 1, 'is'),
  regexp_extract_all(coalesce(agent_text, ''), '\{[^{}]*"chosen_flight"[^{}]*\}', 0, 's')),
 lambda x: json_valid(x)), lambda x: coalesce(x ->> '$.chosen_flight', '') <> '')[1] AS best FROM v_agent_output""",
)
part(
    "d_raw",
    "SELECT * EXCLUDE (best), "
    + ", ".join(
        f"CASE WHEN best IS NOT NULL THEN best ->> '$.{f}' "
        + {
            "chosen_flight": "WHEN contains(lower(agent_text), 'ek380') AND NOT contains(lower(agent_text), 'ek372') THEN 'EK380' ELSE 'EK372' ",
            "reasoning_summary": "ELSE substr(coalesce(agent_text, ''), 1, 600) ",
        }.get(f, "")
        + f"END AS raw_{f}"
        for f in _F
    )
    + " FROM d_candidates",
)
RAW = ", ".join(f"raw_{f} AS {f}" for f in _F)
query("parse_decision", f"SELECT signal_id, {RAW} FROM d_raw")(
    lambda t: t.agent_output.withColumn("d", tx.decision_from_text(F.col("agent_text"))).select(
        "signal_id", "d.*"
    )
)


def _prepared(field: str) -> str:
    return f"CASE WHEN changed THEN {quoted(wording.LATER_DECISION[field])} ELSE {quoted(wording.EARLY_DECISION[field])} END"


def _final(field: str) -> str:
    if field in ("chosen_flight", "action_code"):
        return f"{_prepared(field)} AS {field}"
    return (
        f"CASE WHEN NOT guardrail_applied AND coalesce(raw_reasoning_summary, '') <> '' "
        f"THEN coalesce(nullif(raw_{field}, ''), {_prepared(field)}) ELSE {_prepared(field)} END AS {field}"
    )


part(
    "d_judged",
    f"""SELECT *, (claims AND NOT changed) OR (NOT changed AND offered = 'EK380') OR (changed AND offered = 'EK372') AS guardrail_applied
FROM (SELECT *, {CHANGES} AS changed,
 {any_phrase("coalesce(nullif(raw_reasoning_summary, ''), raw_passenger_reply)", wording.CANCELLATION_CLAIMS)} AS claims,
 CASE WHEN contains(upper(coalesce(raw_chosen_flight, '')), 'EK380') AND NOT contains(upper(coalesce(raw_chosen_flight, '')), 'EK372')
  THEN 'EK380' ELSE 'EK372' END AS offered FROM d_raw)""",
)
part(
    "d_final",
    "SELECT signal_id, pnr, customer_id, signal_timestamp, turn, message_text, guardrail_applied, "
    + ", ".join(map(_final, _F))
    + " FROM d_judged",
)
query("finalize_decision", f"SELECT signal_id, guardrail_applied, {', '.join(_F)} FROM d_final")(
    lambda t: decisions.decide(t.agent_output).select("signal_id", "guardrail_applied", *_F)
)

query(
    "decision_trace",
    """SELECT signal_id, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY k) AS INTEGER) AS step, phase, detail, source FROM (
 SELECT signal_id, 1 AS k, 'MULTI-TURN FOLLOW-UP' AS phase, CASE WHEN step = 'HOLD_AGAIN_AND_CONTINUE' THEN 'Follow-up ' || (turn // 2 + 1) || ' after ' || turn || ' turn(s).' END AS detail, 'Dashboard' AS source FROM d_steps
 UNION ALL SELECT signal_id, 2, 'HANDOFF FROM SCENARIO A', 'Staged as ' || nullif(CASE WHEN step = 'STAGE_FIRST' OR (step = 'HOLD_AGAIN_AND_CONTINUE' AND customer_id IN (SELECT customer_id FROM d_restaged))
  THEN 'CASE-' || customer_id || '-20240131000000' ELSE staged_case END, ''), 'Audit' FROM d_steps
 UNION ALL SELECT signal_id, 3, 'PASSENGER CHAT', message_text, 'Passenger' FROM d_steps
 UNION ALL SELECT signal_id, 4, 'CONVERSATION HISTORY', CASE WHEN turn > 0 THEN turn || ' earlier turn(s) known.' END, 'Dashboard' FROM d_steps
 UNION ALL SELECT s.signal_id, 5, 'AGENTIC WORKFLOW', CASE WHEN a.agent_text <> '' THEN 'An agent answered.' END, 'Agent' FROM d_steps s JOIN v_agent_output a USING (signal_id)
 UNION ALL SELECT signal_id, 6, 'DECISION GUARDRAIL', CASE WHEN guardrail_applied THEN 'Replaced to fit the message.' END, 'SYSTEM' FROM d_steps
 UNION ALL SELECT signal_id, 7, 'AGENT DECISION', reasoning_summary, 'Agent' FROM d_steps
 UNION ALL SELECT signal_id, 8, 'ACTION EXECUTED', chosen_flight || ', seat ' || seat || ', ' || amenity, 'Inventory' FROM d_steps)
WHERE detail IS NOT NULL""",
)(lambda t: decisions.decision_trace(decisions.concierge_steps(t.agent_output, t.exec, as_of=AS_OF)))
