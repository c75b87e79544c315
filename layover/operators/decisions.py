"""Next best action, guardrails and resolution, as rules over whole tables.

Rules that a language model applied are written out here as deterministic operators; their
thresholds are keyword arguments.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.functions import outcome, wording
from layover.functions import text as tx
from layover.functions.clock import arrival_hour_needed
from layover.functions.exact import comparable_avg
from layover.functions.outcome import present
from layover.operators import audit as au
from layover.operators import chat
from layover.operators.keys import attach, rows_for
from layover.operators.mutate import is_true

# Archetypes and actions the guardrails name.
CHOICE_ORIENTED = "CHOICE_ORIENTED"
SLEEPING_DOG = "SLEEPING_DOG"
SURE_THING = "SURE_THING"
VOUCHER_ACTIONS = ["LOUNGE_PASS_MEAL"]
NO_ACTION = "NO_ACTION_MONITOR"
HIGH_TIERS = ("PLATINUM", "GOLD")
VOUCHER_USD = 50

NO_HOUR = -1


# --- uplift guardrails and the best action -------------------------------------------------


def guard_reasons(
    archetype: Column, code: Column, cost: Column, uplift: Column, costly_usd: float, near_zero: float
) -> Column:
    """Why an action is blocked: voucher that backfires, money without effect, harm; else empty."""
    rules = [
        ("VOUCHER_FOR_SLEEPING_DOG", (archetype == SLEEPING_DOG) & code.isin(VOUCHER_ACTIONS)),
        ("COSTLY_FOR_SURE_THING", (archetype == SURE_THING) & (cost >= costly_usd) & (uplift <= near_zero)),
        ("NEGATIVE_UPLIFT", uplift < 0),
    ]
    return F.concat_ws(",", *[F.when(hit, reason) for reason, hit in rules])


def guardrails(
    uplift: DataFrame, shelf: DataFrame, costly_usd: float = 100.0, near_zero: float = 0.05
) -> DataFrame:
    """Verdict per customer and tried action: BLOCK with reasons, ESCALATE to a human, or ALLOW.

    History is folded to one row per customer and action before it meets the shelf.  Means are rounded
    before they are judged, so a mean on a limit, or equal to another one, counts as that.
    """
    folded = uplift.groupBy("customer_id", "archetype", "action_id").agg(
        F.min("experiment_id").alias("first_experiment"),
        comparable_avg(F.col("uplift_score")).alias("mean_uplift"),
    )
    known = attach(folded, shelf.select("action_id", "action_code", "cost_usd", "requires_human"), "action_id")
    judged = known.withColumn(
        "reasons",
        guard_reasons(
            F.col("archetype"), F.col("action_code"), F.col("cost_usd"), F.col("mean_uplift"),
            costly_usd, near_zero,
        ),
    )
    verdict = (
        F.when(F.col("reasons") != "", "BLOCK")
        .when(F.coalesce("requires_human", F.lit(False)), "ESCALATE")
        .otherwise("ALLOW")
    )
    return judged.select(
        "customer_id", "archetype", "action_id", "action_code", "cost_usd", "requires_human",
        "mean_uplift", verdict.alias("verdict"), "reasons", "first_experiment",
    )


def best_action(uplift: DataFrame, shelf: DataFrame, **limits) -> DataFrame:
    """One action per customer: highest mean uplift among those not blocked.

    Ties go to the cheaper action, then the lower id.  Where nothing promises an uplift the
    action is to monitor.  Also carries the customer's first archetype.
    """
    judged = guardrails(uplift, shelf, **limits)
    usable = (F.col("verdict") != "BLOCK") & (F.col("mean_uplift") > 0)
    order = F.struct((-F.col("mean_uplift")).alias("u"), F.col("cost_usd"), F.col("action_id"))
    row = F.struct("action_id", "action_code", "mean_uplift", "requires_human")
    best = judged.groupBy("customer_id").agg(
        F.min_by("archetype", "first_experiment").alias("archetype"),
        F.min_by(row, F.when(usable, order)).alias("best"),
    )
    return best.select(
        "customer_id",
        "archetype",
        F.coalesce("best.action_code", F.lit(NO_ACTION)).alias("action_code"),
        F.col("best.action_id").alias("action_id"),
        F.col("best.mean_uplift").alias("mean_uplift"),
        F.coalesce("best.requires_human", F.lit(False)).alias("requires_human"),
    )


def push_routing(passengers: DataFrame, uplift: DataFrame, shelf: DataFrame, **limits) -> DataFrame:
    """Push decision per affected passenger and PNR.

    Choice-oriented passengers get their flights held and are asked; others get their best
    action, handed to a human where the shelf says so.
    """
    people = passengers.select("customer_id", "pnr").distinct()
    # Only the history of the affected is folded.
    theirs = rows_for(uplift, "customer_id", people)
    known = attach(people, best_action(theirs, shelf, **limits), "customer_id")
    asks = F.coalesce(F.col("archetype") == CHOICE_ORIENTED, F.lit(False))
    action = F.coalesce("action_code", F.lit(NO_ACTION))
    held = F.array(*[F.lit(f) for f in wording.HELD_FLIGHTS])
    archetype = F.coalesce("archetype", F.lit(outcome.UNKNOWN))
    return known.select(
        "pnr",
        "customer_id",
        F.lit(outcome.PUSH).alias("scenario"),
        F.when(asks, outcome.HOLD_ACTION).otherwise(action).alias("action_taken"),
        F.when(asks, tx.staging_reasoning(archetype, held))
        .otherwise(tx.as_json(archetype=archetype, action_code=action))
        .alias("reasoning"),
        F.when(asks, outcome.STAGED)
        .when(F.coalesce("requires_human", F.lit(False)), "PENDING_HUMAN")
        .otherwise("SUCCESS")
        .alias("status"),
        archetype.alias("archetype"),
    )


# --- flights -------------------------------------------------------------------------------


def rules_baseline(
    events: DataFrame,
    profiles: DataFrame,
    inventory: DataFrame,
    high_tiers: Iterable[str] = HIGH_TIERS,
    voucher_usd: int = VOUCHER_USD,
) -> DataFrame:
    """Plain rule: high tier and misconnect means the latest flight with seats plus a voucher.

    Only flights of eligible PNRs are folded, to one row per PNR.
    """
    people = events.filter("misconnect_risk").select("customer_id", "pnr").distinct()
    tiers = profiles.select("customer_id", "loyalty_tier").filter(
        F.col("loyalty_tier").isin(list(high_tiers))
    )
    eligible = attach(people, tiers, "customer_id", "inner")
    latest = (
        rows_for(inventory.filter(F.col("seats_available") > 0), "pnr", eligible)
        .groupBy("pnr")
        .agg(F.max(F.struct("arrival_time", "alternate_flight", "departure_time")).alias("latest"))
        .select("pnr", "latest.*")
        .withColumn(
            "landing_hour", arrival_hour_needed(F.col("departure_time"), F.col("arrival_time"))
        )
        .withColumnRenamed("alternate_flight", "flight_chosen")
    )
    return (
        attach(eligible, latest, "pnr")
        .withColumn("voucher_usd", F.lit(voucher_usd))
        .select(
            "customer_id", "pnr", "loyalty_tier", "flight_chosen", "arrival_time", "landing_hour",
            "voucher_usd",
        )
    )


def flight_classes(inventory: DataFrame) -> DataFrame:
    """Open flights folded per PNR, landing hour and amenity: the earliest and latest of each.

    Landing limits are hours of a day, so everything past hour 23 is one class and a PNR keeps
    at most a hundred rows however many it had.
    """
    hour = F.least(arrival_hour_needed(F.col("departure_time"), F.col("arrival_time")), F.lit(24))
    quiet = F.coalesce(
        (F.col("amenity_type") == "QUIET_POD") & (F.col("amenity_status") == "AVAILABLE"), F.lit(False)
    )
    order = F.struct("arrival_time", "lookup_id", "alternate_flight", "amenity_id", "departure_time")
    return (
        inventory.filter(F.col("seats_available") > 0)
        .groupBy(
            "pnr",
            F.greatest(hour, F.lit(0)).alias("hour_needed"),
            quiet.alias("has_quiet"),
            F.coalesce("lounge_available", F.lit(False)).alias("has_lounge"),
        )
        .agg(F.min(order).alias("earliest"), F.max(order).alias("latest"))
    )


def constraint_choice(messages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Flight per chatting passenger under the constraints in force after the last message.

    A flight needs seats and must land by the stated hour of its departure day.  The earliest
    such flight wins, one with a free quiet pod first when a quiet place was asked for.  Who
    dropped the limit for a later flight gets the latest, lounge first.
    """
    wishes = chat.intent(messages, "pnr", "customer_id").withColumn(
        "limit_key", F.coalesce("limit_hour", F.lit(NO_HOUR))
    )
    kind = ["pnr", "limit_key", "prefers_later", "wants_quiet"]
    # Decide once per PNR and kind of wish (at most a hundred kinds), then hand the answer to
    # every passenger with that wish; passengers of a PNR are never paired with its flights.
    # Only flights of PNRs somebody chats about are folded at all.
    wanted = rows_for(inventory, "pnr", wishes)
    options = flight_classes(wanted).join(wishes.select(*kind).distinct(), "pnr")
    feasible = (F.col("limit_key") == NO_HOUR) | (F.col("hour_needed") <= F.col("limit_key"))
    lacks_quiet = F.col("wants_quiet") & ~F.col("has_quiet")
    best = (
        options.filter(feasible)
        .groupBy(*kind)
        .agg(
            F.min(F.struct(lacks_quiet.alias("miss"), F.col("earliest"))).alias("first"),
            F.max(F.struct(F.col("has_lounge"), F.col("latest"))).alias("last"),
        )
    )
    flight = F.when(F.col("prefers_later"), F.col("last.latest")).otherwise(F.col("first.earliest"))
    answer = best.select(*kind, flight.alias("flight"))
    return attach(wishes, answer, kind, "inner").select(
        "pnr",
        "customer_id",
        "limit_hour",
        "prefers_later",
        "wants_quiet",
        F.col("flight.alternate_flight").alias("chosen_flight"),
        F.col("flight.lookup_id").alias("lookup_id"),
        F.col("flight.arrival_time").alias("arrival_time"),
        arrival_hour_needed(
            F.col("flight.departure_time"), F.col("flight.arrival_time")
        ).alias("landing_hour"),
        F.when(F.col("wants_quiet"), F.col("flight.amenity_id")).alias("amenity_id"),
    )


def rules_contrast(
    events: DataFrame, profiles: DataFrame, messages: DataFrame, inventory: DataFrame
) -> DataFrame:
    """Rule and constraint-aware choice per PNR, and which of them meets the stated limit."""
    # A PNR may hold several passengers; the rule picks the same flight for each of them.  Only
    # PNRs with chat are contrasted.
    rule = (
        rules_baseline(rows_for(events, "pnr", messages), profiles, inventory)
        .groupBy("pnr")
        .agg(
            F.max("flight_chosen").alias("rule_flight"),
            F.max("arrival_time").alias("rule_arrival"),
            F.max("landing_hour").alias("rule_hour"),
            F.max("voucher_usd").alias("voucher_usd"),
        )
    )
    chosen = constraint_choice(messages, inventory)
    limit = F.col("limit_hour")

    def meets(hour: str) -> Column:
        return limit.isNull() | (F.col(hour) <= limit)

    return attach(chosen, rule, "pnr", "inner").select(
        "pnr",
        "customer_id",
        limit,
        "rule_flight",
        "rule_arrival",
        "voucher_usd",
        "chosen_flight",
        F.col("arrival_time").alias("chosen_arrival"),
        meets("rule_hour").alias("rule_meets_limit"),
        meets("landing_hour").alias("choice_meets_limit"),
    )


# --- the concierge decision ----------------------------------------------------------------


def final_decision(raw: Column, message: Column, templates: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """Decision struct held against the passenger's own words, with ``guardrail_applied``.

    The message decides which of the two prepared decisions, ``templates["early"]`` and
    ``templates["later"]``, is right.  A raw decision on the other flight, or one arguing from a
    cancellation nobody mentioned, is replaced by it.  A raw decision that agrees and gives a reason
    keeps its reason, and its reply, seat and amenity where it has them; flight and action code always
    come from the prepared decision.
    """
    changed = tx.changes_mind(message)
    given = templates or wording.TEMPLATES

    def prepared(field: str) -> Column:
        return F.when(changed, given["later"][field]).otherwise(given["early"][field])

    reason = present(raw["reasoning_summary"])
    argued = F.coalesce(reason, raw["passenger_reply"])
    stale = tx.claims_cancellation(argued) & ~changed
    wrong = tx.offered_flight(raw["chosen_flight"]) != prepared("chosen_flight")
    replaced = stale | wrong
    agreed = ~replaced & reason.isNotNull()

    def merged(field: str) -> Column:
        return F.when(agreed, F.coalesce(present(raw[field]), prepared(field))).otherwise(prepared(field))

    taken = {"seat", "amenity", "passenger_reply", "reasoning_summary"}
    return F.struct(
        *[
            (merged(f) if f in taken else prepared(f)).alias(f)
            for f in wording.DECISION_FIELDS
        ],
        replaced.alias("guardrail_applied"),
    )


def decide(
    messages: DataFrame,
    agent_text: str = "agent_text",
    message: str = "message_text",
    templates: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Final decision per message from the agent's text; all other columns are kept."""
    raw = messages.withColumn("__raw", tx.decision_from_text(F.col(agent_text)))
    return (
        raw.withColumn("__d", final_decision(F.col("__raw"), F.col(message), templates))
        .select(*messages.columns, "__d.*")
    )


# What a message does with its customer's case.
CONTINUE, HOLD_AGAIN, STAGE_FIRST = "CONTINUE_STAGED_CASE", "HOLD_AGAIN_AND_CONTINUE", "STAGE_FIRST"


def next_step(profiles: DataFrame, audit: DataFrame, messages: DataFrame) -> DataFrame:
    """What a customer's next chat message leads to.

    Open staging: continue that case.  Otherwise earlier messages: hold the flights again and
    continue.  Otherwise: stage first.  Every message had an answer, so the next one is follow-up
    number messages + 1.
    """
    staging = au.staging_state(audit).select("customer_id", "case_id", "is_open")
    history = messages.groupBy("customer_id").agg(F.count(F.lit(1)).alias("messages"))
    # Three tables of one row per customer: plain joins, each moved once.
    known = profiles.select("customer_id").join(staging, "customer_id", "left")
    known = known.join(history, "customer_id", "left")
    count = F.coalesce("messages", F.lit(0))
    step = (
        F.when(F.coalesce("is_open", F.lit(False)), CONTINUE)
        .when(count > 0, HOLD_AGAIN)
        .otherwise(STAGE_FIRST)
    )
    return known.select(
        "customer_id",
        step.alias("next_step"),
        F.when(step != STAGE_FIRST, F.col("case_id")).alias("case_id"),
        count.alias("messages"),
        (count + 1).alias("follow_up_number"),
    )


def case_states(messages: DataFrame, audit: DataFrame) -> DataFrame:
    """Per customer of the messages: the first message, the open case the audit log knows, the first new staging.

    (customer_id, __first, __case, __open, __staged_from).  Messages have an order, so one staged case changes
    every later message of its customer and none before it: the earliest staging is all that has to be known,
    and it is a minimum, folded per customer before anything is moved.
    """
    order = F.struct("signal_timestamp", "signal_id")
    bare = messages.select("customer_id", order.alias("__order"), "turn")
    first = bare.groupBy("customer_id").agg(F.min("__order").alias("__first"))
    staging = au.staging_state(audit).select(
        "customer_id", F.col("case_id").alias("__case"), F.coalesce("is_open", F.lit(False)).alias("__open")
    )
    known = first.join(staging, "customer_id", "left").withColumn("__open", F.coalesce("__open", F.lit(False)))
    # A message without earlier turns stages, unless it is the first one and finds a case open.
    fresh = attach(bare.filter(~is_true(F.col("turn") > 0)), known.select("customer_id", "__first", "__open"), "customer_id")
    stages = ~(F.coalesce("__open", F.lit(False)) & F.col("__order").eqNullSafe(F.col("__first")))
    staged = fresh.filter(stages).groupBy("customer_id").agg(F.min("__order").alias("__staged_from"))
    return known.join(staged, "customer_id", "left")


def concierge_steps(messages: DataFrame, audit: DataFrame, as_of=None, templates=None) -> DataFrame:
    """Decided messages with the step each takes, its case and its follow-up number.

    ``messages`` needs signal_id, pnr, customer_id, signal_timestamp, turn, message_text and
    agent_text; ``turn`` counts the earlier turns of both sides.  The rows are those of the messages taken one by
    one, by time and id, each seeing what the ones before it left: a customer's first message of the batch
    continues an open case, and closes it; any other message with earlier turns holds again and continues the
    newest case, one the batch staged before it if there is one; a message without earlier turns stages first.
    A case that is missing is null here and gets an id with its audit row.
    """
    order = F.struct("signal_timestamp", "signal_id")
    # Steps come from bare columns; texts are decided once, on the rows that leave here.
    known = attach(messages, case_states(messages, audit), "customer_id")
    is_open = F.coalesce("__open", F.lit(False)) & order.eqNullSafe(F.col("__first"))
    step = F.when(is_open, CONTINUE).when(F.col("turn") > 0, HOLD_AGAIN).otherwise(STAGE_FIRST)
    stepped = known.withColumn("step", step)
    after = F.coalesce(order >= F.col("__staged_from"), F.lit(False))
    new_case = (F.col("step") == STAGE_FIRST) | ((F.col("step") == HOLD_AGAIN) & after)
    decided = decide(stepped, templates=templates)
    own = {"__first", "__case", "__open", "__staged_from", "step"}
    made = [c for c in decided.columns if c not in own]
    return decided.select(
        *made,
        "step",
        F.when(new_case, au.case_id(as_of=as_of)).otherwise(F.col("__case")).alias("case_id"),
        (F.floor(F.col("turn") / 2) + 1).alias("follow_up_number"),
    )


def stagings(steps: DataFrame, as_of=None) -> DataFrame:
    """Audit rows of the cases that messages stage first, one per customer and PNR."""
    held = F.array(*[F.lit(f) for f in wording.HELD_FLIGHTS])
    rows = steps.filter(F.col("step") == STAGE_FIRST).select("pnr", "customer_id", "case_id").distinct()
    return au.to_audit(
        rows.select(
            "*",
            F.lit(outcome.PUSH).alias("scenario"),
            F.lit(outcome.HOLD_ACTION).alias("action_taken"),
            tx.staging_reasoning(F.lit(CHOICE_ORIENTED), held).alias("reasoning"),
            F.lit(outcome.STAGED).alias("status"),
        ),
        as_of=as_of,
    )


def resolutions(steps: DataFrame, as_of=None) -> DataFrame:
    """Audit rows of decided messages, one each."""
    reasoning = tx.as_json(
        chosen_flight=F.col("chosen_flight"),
        seat=F.col("seat"),
        amenity=F.col("amenity"),
        action_code=F.col("action_code"),
        chat_message=F.col("message_text"),
        chat_turns=F.col("turn") + 1,
        agent_reasoning=F.col("reasoning_summary"),
    )
    rows = steps.select(
        "signal_id",
        "pnr",
        "customer_id",
        "case_id",
        F.lit(outcome.PULL).alias("scenario"),
        F.col("action_code").alias("action_taken"),
        reasoning.alias("reasoning"),
        F.lit("SUCCESS").alias("status"),
    )
    return au.to_audit(rows, row_key="signal_id", as_of=as_of)


def pull_resolution(messages: DataFrame, audit: DataFrame, as_of=None, templates=None) -> DataFrame:
    """Audit rows for chat messages answered by an agent: one per message, and the cases staged for them."""
    steps = concierge_steps(messages, audit, as_of, templates)
    return resolutions(steps, as_of).unionByName(stagings(steps, as_of))


def latest_choices(steps: DataFrame) -> DataFrame:
    """Per PNR the flight of the last decided message, the flight to let go, and whether to hold again."""
    newest = F.struct("signal_timestamp", "signal_id")
    last = steps.groupBy("pnr").agg(
        F.max_by(F.struct("chosen_flight", (F.col("step") != CONTINUE).alias("hold_again")), newest).alias("last")
    ).select("pnr", "last.*")
    other = F.when(F.col("chosen_flight") == wording.EARLY_FLIGHT, wording.LATER_FLIGHT).otherwise(
        wording.EARLY_FLIGHT
    )
    return last.withColumn("release_flights", other)


# --- explanation ---------------------------------------------------------------------------

# The phases of an explanation.
PULL_PHASES = [
    "MULTI-TURN FOLLOW-UP", "HANDOFF FROM SCENARIO A", "PASSENGER CHAT", "CONVERSATION HISTORY", "AGENTIC WORKFLOW",
    "DECISION GUARDRAIL", "AGENT DECISION", "ACTION EXECUTED",
]
PUSH_PHASES = [
    "TRIGGER", "PROFILE EVALUATION", "ARCHETYPE", "ICEBERG INVENTORY HOLD", "DECISION (Scenario A)", "PUSH NOTIFICATION",
]


def _trace(rows: DataFrame, keys: list[str], phases: list[str], told: dict[str, tuple[Column, str]]) -> DataFrame:
    """Ordered steps (keys…, step, phase, detail, source); phases without a detail are left out."""
    steps = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), told[p][0].alias("detail"), F.lit(told[p][1]).alias("source"))
            for p in phases
        ]
    )
    kept = F.filter(steps, lambda s: s["detail"].isNotNull())
    return (
        rows.select(*keys, F.posexplode(kept).alias("step", "s"))
        .select(*keys, (F.col("step") + 1).alias("step"), "s.phase", "s.detail", "s.source")
    )


def decision_trace(steps: DataFrame) -> DataFrame:
    """How each decided message came to its decision, from ``concierge_steps``."""
    turns = F.col("turn")
    told = {
        "MULTI-TURN FOLLOW-UP": (
            F.when(F.col("step") == HOLD_AGAIN, F.format_string("Follow-up %d after %d turn(s).", "follow_up_number", "turn")),
            "Dashboard",
        ),
        "HANDOFF FROM SCENARIO A": (F.concat(F.lit("Staged as "), present("case_id")), "Audit"),
        "PASSENGER CHAT": (F.col("message_text"), "Passenger"),
        "CONVERSATION HISTORY": (F.when(turns > 0, F.format_string("%d earlier turn(s) known.", "turn")), "Dashboard"),
        "AGENTIC WORKFLOW": (F.when(present("agent_text").isNotNull(), F.lit("An agent answered.")), "Agent"),
        "DECISION GUARDRAIL": (F.when(F.col("guardrail_applied"), F.lit("Replaced to fit the message.")), "SYSTEM"),
        "AGENT DECISION": (F.col("reasoning_summary"), "Agent"),
        "ACTION EXECUTED": (F.format_string("%s, seat %s, %s", "chosen_flight", "seat", "amenity"), "Inventory"),
    }
    return _trace(steps, ["signal_id"], PULL_PHASES, told)


def push_trace(routed: DataFrame, events: DataFrame, profiles: DataFrame) -> DataFrame:
    """How each routed passenger came to their action, from ``push_routing``, events and profiles."""
    shortest = events.filter("misconnect_risk").groupBy("customer_id", "pnr").agg(
        F.min("new_connection_mins").alias("mins")
    )
    tiers = profiles.select("customer_id", "loyalty_tier")
    known = attach(attach(routed, shortest, ["customer_id", "pnr"]), tiers, "customer_id")
    asks = F.col("status") == outcome.STAGED
    told = {
        "TRIGGER": (F.format_string("%d minutes left to connect", "mins"), "SYSTEM"),
        "PROFILE EVALUATION": (F.concat(F.lit("Tier "), "loyalty_tier"), "Profile"),
        "ARCHETYPE": (F.col("archetype"), "SYSTEM"),
        "ICEBERG INVENTORY HOLD": (F.when(asks, F.lit("Held: " + ", ".join(wording.HELD_FLIGHTS))), "Inventory"),
        "DECISION (Scenario A)": (F.concat_ws(": ", "action_taken", "status"), "SYSTEM"),
        "PUSH NOTIFICATION": (F.when(asks, F.lit(wording.PUSH_PROMPT)), "SYSTEM"),
    }
    return _trace(known, ["customer_id", "pnr"], PUSH_PHASES, told)
