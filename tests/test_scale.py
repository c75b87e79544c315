"""Plans and hot keys: what must hold at many times the data."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from layover import registry
from layover.functions import text as tx
from layover.operators import audit as au
from layover.operators import chat, decisions, inventory, mutate, passengers
from layover.operators.keys import attach, match, one_row_per_key, rows_for
from layover.session import RUNTIME_CONF, new_path, tune
from layover.sources import seeds
from layover.sources.testviews import AS_OF, spark_view
from tests.conftest import SF, SF_SMALL

STREAMS = {"misconnect_trigger_stream", "chat_ingest_stream", "event_ingest_stream"}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@contextlib.contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
SMALL_SKEW = {
    **NO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


# --- plans ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - STREAMS))
def test_no_pairing_and_no_python_in_any_plan(spark, name):
    with conf(spark, **NO_BROADCAST):
        plan = plan_of(registry.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Generate explode(sequence"):
        assert bad not in plan


def stored(spark, name, label):
    path = new_path(spark, label)
    spark_view(spark, SF_SMALL, name).write.parquet(path)
    return spark.read.parquet(path)


def test_window_filter_reaches_the_files(spark):
    log = stored(spark, "v_exec", "log")
    plan = plan_of(au.within(log, "1d", AS_OF))
    assert "PushedFilters: [Or(IsNull(executed_at),GreaterThanOrEqual(executed_at,2024-01-30T00:00))]" in plan


def test_point_lookups_reach_the_files(spark):
    events = stored(spark, "v_flight_events", "events")
    assert "EqualTo(customer_id,CUST-7)" in plan_of(rows_for(events, "customer_id", "CUST-7"))
    assert "In(customer_id, [CUST-7,CUST-9])" in plan_of(rows_for(events, "customer_id", ["CUST-7", "CUST-9"]))


def test_stats_read_only_their_columns(spark):
    log = stored(spark, "v_exec", "log")
    plan = plan_of(au.execution_stats(log, "1w", AS_OF))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "reasoning" not in schema and "exec_id" not in schema and "pnr" not in schema


def test_projections_do_not_shuffle(spark):
    for name in ("disruption_board", "context_items", "change_of_mind", "audit_reasoning", "parse_decision",
                 "finalize_decision", "misconnect_trigger", "profile_fields", "cat_failed", "read_snapshot"):
        assert "Exchange" not in plan_of(registry.queries()[name](spark, SF_SMALL)), name


def test_latest_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(au.prior_concierge(spark_view(spark, SF_SMALL, "v_exec")))
    assert plan.count("WindowGroupLimit") >= 2


def test_recent_rows_are_taken_not_sorted(spark):
    assert "TakeOrderedAndProject" in plan_of(au.recent(spark_view(spark, SF_SMALL, "v_exec"), 50))


def test_holds_shuffle_only_the_named_flights(spark):
    stock = stored(spark, "v_inventory", "stock")
    wanted = spark_view(spark, SF_SMALL, "v_flight_events").filter("misconnect_risk")
    with conf(spark, **NO_BROADCAST):
        plan = plan_of(inventory.place_holds(stock, wanted))
    assert "In(alternate_flight, [EK372,EK380])" in plan


def test_small_tables_are_broadcast_by_size(spark):
    from layover.sources import seeds

    uplift = spark_view(spark, SF_SMALL, "v_uplift")
    assert "BroadcastHashJoin" in plan_of(passengers.uplift_with_actions(uplift, seeds.action_shelf(spark)))
    with conf(spark, **NO_BROADCAST):
        plan = plan_of(passengers.uplift_with_actions(uplift, seeds.action_shelf(spark)))
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    from layover.sources import tables

    stock = spark_view(spark, SF_SMALL, "v_inventory")
    choices = stock.groupBy("pnr").agg(F.min("alternate_flight").alias("chosen_flight"))
    left = tables.write_bucketed(stock, "layover_bucketed_stock", new_path(spark, "stock"), "pnr", 8)
    right = tables.write_bucketed(choices, "layover_bucketed_choices", new_path(spark, "choices"), "pnr", 8)
    try:
        with conf(spark, **NO_BROADCAST):
            plan = plan_of(inventory.confirm_and_release(left, right, bucketed=True))
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE layover_bucketed_stock")
        spark.sql("DROP TABLE layover_bucketed_choices")


# --- hot keys ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark):
    """Inventory with a third of its rows under one PNR, and one choice per PNR."""
    stock = spark_view(spark, SF, "v_inventory")
    hot_row = F.pmod(F.xxhash64("lookup_id"), F.lit(3)) == 0
    path = new_path(spark, "hot")
    stock.withColumn("pnr", F.when(hot_row, "PNR-HOT").otherwise(F.col("pnr"))).repartition(16).write.parquet(path)
    stock = spark.read.parquet(path)
    choices = stock.filter("seats_available > 0").groupBy("pnr").agg(F.min("alternate_flight").alias("chosen_flight"))
    path = new_path(spark, "choices")
    choices.write.parquet(path)
    return stock, spark.read.parquet(path)


def as_set(df):
    return sorted(map(repr, df.collect()))


def hot_joins(stock, choices):
    """Joins of hot facts with a lookup that was read, and with lookups just folded."""
    folded = stock.filter("seats_available > 0").groupBy("pnr").agg(
        F.min("alternate_flight").alias("chosen_flight"), F.lit(" EK380, EK372").alias("release_flights")
    )
    some = folded.filter("chosen_flight > 'EK302'")
    turns = stock.select(
        F.col("pnr").alias("conv_id"), F.xxhash64("lookup_id").alias("turn"), F.lit("user").alias("role"), F.col("lookup_id").alias("text")
    )
    return {
        "confirm_and_release, read": lambda: inventory.confirm_and_release(stock, choices),
        "confirm_and_release, folded": lambda: inventory.confirm_and_release(stock, folded),
        "confirm": lambda: inventory.confirm(stock, folded),
        "release": lambda: inventory.release(stock, folded),
        "release_candidates": lambda: inventory.release_candidates(stock, folded),
        "place_holds": lambda: inventory.place_holds(stock, some, [f"EK{n}" for n in range(300, 400)]),
        "rows_for": lambda: rows_for(stock, "pnr", some),
        "anti": lambda: match(stock, some.select("pnr").distinct(), "pnr", "left_anti"),
        "update_from_keys": lambda: mutate.update_from_keys(stock, some, "pnr", {"destination": F.lit("?")}),
        "merge_upsert": lambda: mutate.merge_upsert(
            stock.select("pnr", "lookup_id"), some.select("pnr", F.col("chosen_flight").alias("lookup_id")), "pnr",
            {"lookup_id": F.concat("new_lookup_id", "lookup_id")},
        ),
        "prior_turns": lambda: chat.prior_turns(turns),
    }


HOT_JOINS = [
    "confirm_and_release, read", "confirm_and_release, folded", "confirm", "release", "release_candidates", "place_holds",
    "rows_for", "anti", "update_from_keys", "merge_upsert", "prior_turns",
]


@pytest.mark.parametrize("name", HOT_JOINS)
def test_hot_key_is_split_by_adaptive_execution(spark, hot, name):
    build = hot_joins(*hot)[name]
    plain = as_set(build())
    with conf(spark, **SMALL_SKEW):
        tune(spark)
        result = build()
        assert as_set(result) == plain
        assert "skew=true" in plan_of(result)


def test_keys_of_different_types_still_match(spark):
    facts = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS f(k, v)")
    lookup = spark.sql("SELECT * FROM VALUES (1, 'x') AS l(k, w)")
    assert sorted(map(tuple, attach(facts, lookup, "k").collect())) == [(1, "a", "x"), (2, "b", None)]
    assert rows_for(facts, "k", lookup).count() == 1


def test_set_operations_treat_null_as_a_value(spark):
    left = spark.sql("SELECT * FROM VALUES ('a'), ('a'), (NULL), ('b') AS l(v)")
    right = spark.sql("SELECT * FROM VALUES ('a'), (NULL), ('c') AS r(v)")
    assert {r["v"] for r in mutate.common_values(left, right).collect()} == {"a", None}
    assert [r["v"] for r in mutate.missing_values(left, right).collect()] == ["b"]


def test_salted_join_gives_the_same_rows(spark, hot):
    stock, choices = hot
    plain = as_set(inventory.confirm_and_release(stock, choices))
    with conf(spark, **NO_BROADCAST):
        salted = inventory.confirm_and_release(stock, choices, salts=8)
        assert as_set(salted) == plain
    assert stock.count() == salted.count()


def test_salting_spreads_the_hot_key(spark, hot):
    stock, choices = hot
    with conf(spark, **{**NO_BROADCAST, "spark__sql__adaptive__enabled": "false"}):
        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]

        assert largest(attach(stock, choices, "pnr", salts=8)) < largest(attach(stock, choices, "pnr")) * 0.75


def test_hot_case_is_folded_before_the_shuffle(spark):
    log = spark_view(spark, SF, "v_exec")
    hot_log = log.withColumn("case_id", F.when(F.pmod(F.xxhash64("exec_id"), F.lit(3)) == 0, "CASE-HOT").otherwise(F.col("case_id")))
    plan = plan_of(au.conversion(hot_log))
    assert "partial_max" in plan
    cases = {}
    for r in hot_log.select("case_id", "scenario", "status", "success_flag").collect():
        status = (r["status"] or "").upper()
        good = "FAIL" not in status and (status in {"SUCCESS", "CONFIRMED", "COMPLETED"} or bool(r["success_flag"]))
        if r["case_id"]:
            staged, done = cases.get(r["case_id"], (False, False))
            cases[r["case_id"]] = (staged or r["status"] == "STAGED_FOR_CONCIERGE", done or (r["scenario"] == "PULL_CONCIERGE" and good))
    row = au.conversion(hot_log).collect()[0]
    assert row["staged_cases"] == sum(s for s, _ in cases.values())
    assert row["converted_cases"] == sum(s and d for s, d in cases.values())


# --- long conversations --------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_chat(spark):
    """One conversation with a third of all messages, and many short ones; turns have gaps."""
    rng = random.Random(7)
    said = ["I CANNOT land after 6 PM", "cannot land after 9 AM, need a quiet place", "Dinner is cancelled", "thanks", None]
    rows = [(0, t * 3, rng.choice(said)) for t in range(400)]
    rows += [(1 + i % 40, i // 40, rng.choice(said)) for i in range(800)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, message_text string"), rows


def test_timeline_in_chunks_matches_a_plain_walk(spark, long_chat):
    messages, rows = long_chat
    expected, state = {}, {}
    for conv, turn, said in sorted(rows, key=lambda r: (r[0], r[1])):
        limit, later, quiet = state.get(conv, (None, False, False))
        if said == "Dinner is cancelled":
            limit, later, quiet = None, True, False
        elif said and "land after" in said:
            limit, later = (18, False) if "6 PM" in said else (9, False)
            quiet = quiet or "quiet" in said
        state[conv] = expected[(conv, turn)] = (limit, later, quiet)
    for chunk in (7, 64, 65_536):
        got = chat.constraint_timeline(messages, chunk_turns=chunk).collect()
        assert {(r["conv_id"], r["turn"]): (r["limit_hour"], r["prefers_later"], r["wants_quiet"]) for r in got} == expected
        assert len(got) == len(rows)


def test_messages_outside_a_conversation_are_kept(spark):
    messages = spark.sql("SELECT * FROM VALUES (NULL, 1L, 'cannot land after 6 PM'), (1L, NULL, 'hi'), (1L, 0L, 'hi') AS m(conv_id, turn, message_text)")
    rows = chat.constraint_timeline(messages).collect()
    assert len(rows) == 3
    assert [r["limit_hour"] for r in rows if r["conv_id"] is None] == [18]


def test_last_state_by_aggregation_matches_the_timeline(spark, long_chat):
    messages, _ = long_chat
    last = {r["conv_id"]: r for r in chat.intent(messages, "conv_id", order=F.col("turn")).collect()}
    newest = {}
    for r in chat.constraint_timeline(messages).collect():
        if r["conv_id"] not in newest or newest[r["conv_id"]]["turn"] < r["turn"]:
            newest[r["conv_id"]] = r
    for conv, r in newest.items():
        assert [last[conv][c] for c in ("limit_hour", "prefers_later", "wants_quiet")] == [r[c] for c in ("limit_hour", "prefers_later", "wants_quiet")]


def test_transcript_pages_join_to_the_whole(spark, long_chat):
    _, rows = long_chat
    turns = spark.createDataFrame([(c, t, "user", s) for c, t, s in rows], "conv_id long, turn long, role string, text string")
    pages = chat.transcripts(turns, 50).orderBy("page").collect()
    whole = {}
    for r in pages:
        assert r["turns"] <= 50
        whole.setdefault(r["conv_id"], []).append(r["transcript"])
    for conv in {c for c, _, _ in rows}:
        lines = [f"[USER]: {s or ''}" for c, t, s in sorted(rows, key=lambda r: r[:2]) if c == conv]
        assert "\n".join(whole[conv]) == "\n".join(lines)


# --- safety --------------------------------------------------------------------------------


def test_merge_rejects_a_source_with_two_rows_per_key(spark):
    target = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (2, 'bb') AS t(id, data)")
    source = spark.sql("SELECT * FROM VALUES (2, 'x'), (3, 'y') AS s(id, data)")
    merged = mutate.merge_upsert(target, source, "id", {"data": F.concat("new_data", "data")})
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "xb"), (2, "xbb"), (3, "y")]
    with pytest.raises(Exception, match="more than one row for a key"):
        mutate.merge_upsert(target, source.union(source), "id", {"data": F.col("new_data")}).collect()
    assert one_row_per_key(source, "id").count() == 2


def test_sample_by_key_is_the_same_every_time_and_near_its_fraction(spark):
    rows = spark.range(20_000)
    first = mutate.sample_by_key(rows, "id", 0.3)
    again = mutate.sample_by_key(rows.repartition(5), "id", 0.3)
    assert as_set(first) == as_set(again)
    assert 5_600 < first.count() < 6_400
    assert as_set(mutate.sample_by_key(rows, "id", 0.3, seed=4)) != as_set(first)


def test_settings_are_applied_and_size_the_shuffle(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tune(spark, shuffle_bytes=100 * 2**40)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(100 * 2**40 // 2**27)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())


def test_hot_profile_text_is_parsed_once_per_row(spark):
    lines = "\n".join(f"Field {i}: {i}" for i in range(200))
    row = spark.range(1).select(tx.profile_fields(F.lit(lines)).alias("f")).collect()[0]
    assert len(row["f"]) == 200


@pytest.mark.parametrize("what", ["push_routing", "rules_baseline", "rules_contrast"])
def test_only_the_rows_of_those_asked_about_are_folded(spark, what):
    """The semi join stands below the aggregate, so nobody else's history or flights are folded."""
    view = lambda name: spark_view(spark, SF_SMALL, f"v_{name}")
    few = view("flight_events").limit(5)
    made = {
        "push_routing": lambda: decisions.push_routing(passengers.affected(few), view("uplift"), seeds.action_shelf(spark)),
        "rules_baseline": lambda: decisions.rules_baseline(few, view("profile"), view("inventory")),
        "rules_contrast": lambda: decisions.rules_contrast(few, view("profile"), view("chat"), view("inventory")),
    }
    plan = made[what]()._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    base = "o_totalprice" if what == "push_routing" else "l_quantity"

    def above(i):
        return [k for k in range(i) if depth[k] < depth[i] and all(depth[m] > depth[k] for m in range(k + 1, i + 1))]

    scans = [i for i, line in enumerate(lines) if "Relation [" in line and base in line]
    folded = [i for i in scans if any("Aggregate" in lines[k] and "Distinct" not in lines[k] for k in above(i))]
    assert any(
        any("LeftSemi" in lines[k] for k in above(i)[above(i).index(a):])
        for i in folded for a in above(i) if "Aggregate" in lines[a]
    )
