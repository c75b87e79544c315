"""Audit log queries."""

from pyspark.sql import functions as F

from layover.functions import outcome
from layover.functions import text as tx
from layover.operators import audit as au
from layover.operators import mutate
from layover.registry import part, query
from layover.sources import tables
from layover.sources.testviews import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
NEWEST = "ORDER BY executed_at DESC NULLS LAST, exec_id DESC"

part(
    "d_flags",
    """
SELECT *,
 coalesce(status = 'STAGED_FOR_CONCIERGE', false) AS staged,
 CASE WHEN upper(coalesce(status, '')) LIKE '%FAIL%' THEN false
  WHEN upper(status) IN ('SUCCESS', 'CONFIRMED', 'COMPLETED') THEN true
  ELSE coalesce(success_flag, false) END AS successful,
 upper(coalesce(status, '')) LIKE '%FAIL%' OR NOT coalesce(success_flag, false) AS failed,
 coalesce(action_taken, '') = 'HOLD_AND_PROMPT' AS hold_prompt,
 coalesce(action_taken, '') LIKE '%PROACTIVE_REBOOK%' AS rebook,
 coalesce(scenario, '') = 'PULL_CONCIERGE' AS pull
FROM v_exec
""",
)
AUDIT = (
    "exec_id, case_id, pnr, customer_id, scenario, action_taken, reasoning, status, "
    "success_flag, executed_at"
)


def in_window(hours: int) -> str:
    return f"(executed_at IS NULL OR executed_at >= {NOW} - INTERVAL '{hours}' HOUR)"


# --- windows, filters, categories ----------------------------------------------------------

for _name, _window, _hours in [
    ("window_1h", "1h", 1),
    ("window_4h", "4h", 4),
    ("window_1d", "1d", 24),
    ("window_1w", "1w", 168),
    ("window_unknown_name", "fortnight", 24),
]:
    query(_name, f"SELECT * FROM v_exec WHERE {in_window(_hours)}")(
        lambda t, w=_window: au.within(t.exec, w, AS_OF)
    )

query(
    "since_filter",
    "SELECT * FROM v_exec WHERE executed_at IS NULL OR executed_at >= TIMESTAMP '2024-01-20 12:00:00'",
)(lambda t: au.since(t.exec, "2024-01-20T12:00:00Z"))

query("scenario_filter", "SELECT * FROM v_exec WHERE scenario = 'PUSH_NBA'")(
    lambda t: au.of_scenario(t.exec, "PUSH_NBA")
)

for _name, _category, _rule in [
    ("cat_successful", "successful", "successful"),
    ("cat_autorebook", "AutoRebook", "rebook"),
    ("cat_hold_prompt", "hold-and-prompt", "hold_prompt"),
    ("cat_staged", "staged", "staged"),
    ("cat_failed", "failed", "failed"),
    ("cat_unknown", "no such category", "true"),
]:
    query(_name, f"SELECT {AUDIT} FROM d_flags WHERE {_rule}")(
        lambda t, c=_category: au.of_category(t.exec, c)
    )


@query(
    "audit_search",
    f"""SELECT {AUDIT} FROM d_flags
WHERE {in_window(168)} AND (executed_at IS NULL OR executed_at >= TIMESTAMP '2024-01-25 00:00:00')
 AND scenario = 'PUSH_NBA' AND successful {NEWEST} LIMIT 100""",
)
def audit_search(t):
    return au.search(
        t.exec, "1w", "successful", scenario="PUSH_NBA", since_text="2024-01-25 00:00:00",
        limit=100, as_of=AS_OF,
    )


query("audit_recent", f"SELECT * FROM v_exec {NEWEST} LIMIT 50")(lambda t: au.recent(t.exec, 50))

query("success_flags", "SELECT exec_id, successful FROM d_flags")(
    lambda t: au.flags(t.exec).select("exec_id", "successful")
)
query("failed_flags", "SELECT exec_id, failed FROM d_flags")(
    lambda t: au.flags(t.exec).select("exec_id", "failed")
)

# --- counts --------------------------------------------------------------------------------

part(
    "d_week_cases",
    f"""
SELECT case_id, bool_or(staged) AS was_staged, bool_or(pull AND successful) AS was_done
FROM d_flags WHERE {in_window(168)} AND case_id IS NOT NULL AND case_id <> '' GROUP BY case_id
""",
)
CONVERSION = """(SELECT count(*) FROM d_week_cases WHERE was_staged) AS staged_cases,
 (SELECT count(*) FROM d_week_cases WHERE was_staged AND was_done) AS converted_cases,
 coalesce((SELECT round_even(count(*) FILTER (WHERE was_done) / nullif(count(*), 0)::DOUBLE, 2)
  FROM d_week_cases WHERE was_staged), 0.0) AS staged_to_completed_conversion_rate"""
COUNTS = """count(*) AS total_audit_rows,
 count(*) FILTER (WHERE staged) AS staged_for_concierge,
 count(*) FILTER (WHERE successful) AS successful_resolutions,
 count(*) FILTER (WHERE hold_prompt) AS hold_and_prompt_actions,
 count(*) FILTER (WHERE rebook) AS proactive_rebook_actions,
 count(*) FILTER (WHERE failed) AS failed_actions"""

query(
    "execution_stats",
    f"SELECT {COUNTS}, {CONVERSION}, '1w' AS \"window\" FROM d_flags WHERE {in_window(168)}",
)(lambda t: au.execution_stats(t.exec, "1w", AS_OF))

query("conversion_rate", f"SELECT {CONVERSION}")(lambda t: au.conversion(t.exec, "1w", AS_OF))

for _name, _field in [("by_scenario", "scenario"), ("by_status", "status"), ("by_action", "action_taken")]:
    query(
        _name,
        f"SELECT coalesce(nullif({_field}, ''), 'UNKNOWN') AS {_field}, count(*) AS n FROM v_exec GROUP BY 1",
    )(lambda t, f=_field: au.count_by(t.exec, f))

query(
    "by_all_fields",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, coalesce(nullif({f}, ''), 'UNKNOWN') AS value, count(*) AS n FROM v_exec GROUP BY 2"
        for f in ("scenario", "status", "action_taken")
    ),
)(lambda t: au.count_by_fields(t.exec))

query(
    "execution_breakdown",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, coalesce(nullif({f}, ''), 'UNKNOWN') AS value, count(*) AS n FROM v_exec WHERE {in_window(168)} GROUP BY 2"
        for f in ("scenario", "status", "action_taken")
    ),
)(lambda t: au.execution_breakdown(t.exec, "1w", AS_OF))

query(
    "metric_tiles",
    f"""SELECT unnest([0, 1, 2, 3, 4, 5]) AS "position",
 unnest(['all', 'successful', 'autorebook', 'hold_prompt', 'staged', 'failed']) AS metric,
 unnest([total_audit_rows, successful_resolutions, proactive_rebook_actions,
  hold_and_prompt_actions, staged_for_concierge, failed_actions]) AS "value",
 unnest(['All operations', 'Successful', 'Auto-rebooks', 'Hold & prompt', 'Staged (1→2)', 'Failed']) AS label
FROM (SELECT {COUNTS} FROM d_flags WHERE {in_window(168)})""",
)(lambda t: au.metric_tiles(t.exec, "1w", AS_OF))

query(
    "case_completions",
    """SELECT case_id, count(*) FILTER (WHERE pull AND status = 'SUCCESS') AS completions
FROM d_flags WHERE case_id <> '' GROUP BY case_id""",
)(lambda t: au.case_completions(t.exec))

# --- latest and open cases -----------------------------------------------------------------

part(
    "d_latest_staging",
    f"""SELECT {AUDIT} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id {NEWEST}) AS rn
 FROM d_flags WHERE staged) WHERE rn = 1""",
)
part("d_closed", "SELECT DISTINCT case_id FROM d_flags WHERE pull AND status = 'SUCCESS' AND case_id IS NOT NULL")

query("latest_staging", "SELECT * FROM d_latest_staging")(lambda t: au.latest_staging(t.exec))

query(
    "prior_concierge_audit",
    f"""SELECT {AUDIT}, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY customer_id {NEWEST}) AS rn
 FROM d_flags WHERE pull) WHERE rn <= 5""",
)(lambda t: au.prior_concierge(t.exec))

query(
    "open_staging",
    """SELECT * FROM d_latest_staging s
WHERE NOT EXISTS (SELECT 1 FROM d_closed c WHERE c.case_id = s.case_id)""",
)(lambda t: au.open_staging(t.exec))

part(
    "d_all_cases",
    """SELECT case_id, bool_or(staged) AS was_staged, bool_or(pull AND successful) AS was_done
FROM d_flags WHERE case_id <> '' GROUP BY case_id""",
)
query("converted_cases", "SELECT case_id FROM d_all_cases WHERE was_staged AND was_done")(
    lambda t: au.converted_cases(t.exec)
)


@query(
    "case_intersect",
    """SELECT case_id FROM d_flags WHERE staged AND case_id <> ''
INTERSECT SELECT case_id FROM d_flags WHERE pull AND successful AND case_id <> ''""",
)
def case_intersect(t):
    rows = t.exec.filter(outcome.present("case_id").isNotNull())
    done = outcome.is_pull() & outcome.is_successful()
    return mutate.common_values(
        rows.filter(outcome.is_staged()).select("case_id"), rows.filter(done).select("case_id")
    )


# --- shown columns and ids -----------------------------------------------------------------

query(
    "status_badge",
    """SELECT exec_id, status,
 CASE WHEN upper(status) LIKE '%SUCCESS%' OR upper(status) LIKE '%CONFIRMED%' OR upper(status) LIKE '%COMPLETED%' THEN 'badge-success'
  WHEN upper(status) LIKE '%STAGED%' OR upper(status) LIKE '%AWAIT%' THEN 'badge-staged'
  WHEN upper(status) LIKE '%FAIL%' THEN 'badge-fail' ELSE 'badge-neutral' END AS badge
FROM v_exec""",
)(lambda t: t.exec.select("exec_id", "status", outcome.status_badge().alias("badge")))

query(
    "case_ids",
    """SELECT exec_id, 'CASE-' || customer_id || '-' || strftime(executed_at, '%Y%m%d%H%M%S') AS made_case_id
FROM v_exec""",
)(lambda t: t.exec.select("exec_id", au.case_id(as_of=F.col("executed_at")).alias("made_case_id")))

query(
    "exec_ids",
    """SELECT exec_id, concat_ws('-', 'EXEC', strftime(executed_at, '%Y-%m-%d-%H%M%S'), customer_id, exec_id) AS made_exec_id
FROM v_exec""",
)(
    lambda t: t.exec.select(
        "exec_id", au.row_id("EXEC", row_key="exec_id", as_of=F.col("executed_at")).alias("made_exec_id")
    )
)

SUMMARY = """SELECT exec_id, CASE WHEN reasoning IS NULL THEN '' WHEN NOT json_valid(reasoning) THEN reasoning ELSE
 coalesce(nullif(concat_ws(' · ',
  'Segment: ' || nullif(CASE WHEN json_valid(reasoning) THEN reasoning END ->> '$.archetype', ''),
  'Held: ' || array_to_string(json_extract_string(CASE WHEN json_valid(reasoning) THEN reasoning END, '$.held_flights[*]'), ', '),
  'Chosen: ' || nullif(CASE WHEN json_valid(reasoning) THEN reasoning END ->> '$.chosen_flight', ''),
  'Handoff: ' || nullif(CASE WHEN json_valid(reasoning) THEN reasoning END ->> '$.handoff', '')), ''), reasoning) END AS summary
FROM v_exec"""
query("audit_reasoning", SUMMARY)(
    lambda t: t.exec.select("exec_id", tx.audit_summary(F.col("reasoning")).alias("summary"))
)


def stored(t):
    """The log as it is kept with its reasoning parsed: only what the questions need is read again."""
    return tables.settle(au.with_document(t.exec.select("exec_id", "reasoning")), "documents")


query("audit_documents", SUMMARY)(
    lambda t: stored(t).select("exec_id", tx.document_summary(F.col("document"), F.col("reasoning")).alias("summary"))
)
query(
    "audit_document_fields",
    """SELECT exec_id, field, value FROM (SELECT exec_id, unnest(['archetype', 'held_flights', 'chosen_flight', 'handoff']) AS field,
  unnest([d ->> '$.archetype', d ->> '$.held_flights', d ->> '$.chosen_flight', d ->> '$.handoff']) AS value
 FROM (SELECT exec_id, CASE WHEN json_valid(reasoning) THEN reasoning END AS d FROM v_exec)) WHERE value <> ''""",
)(lambda t: au.document_rows(stored(t), ["archetype", "held_flights", "chosen_flight", "handoff"]))
