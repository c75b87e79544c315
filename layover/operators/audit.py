"""Questions over the audit log: searches, counts, conversion, latest and open cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.functions import clock, outcome, wording
from layover.functions import text as tx
from layover.functions.exact import rate
from layover.operators.keys import match, newest_first
from layover.sources.schemas import AUDIT_COLUMNS

NEWEST = ("executed_at", "exec_id")
DAY = "executed_day"


# --- searches ------------------------------------------------------------------------------


def with_day(audit: DataFrame) -> DataFrame:
    """Adds the day a stored log is partitioned by; rows without a time have no day."""
    return audit.withColumn(DAY, F.to_date("executed_at"))


def _from(audit: DataFrame, condition: Column, start: Column) -> DataFrame:
    """Rows meeting a time condition; a log stored by day skips the folders before its start."""
    if DAY in audit.columns:
        audit = audit.filter(F.col(DAY).isNull() | start.isNull() | (F.col(DAY) >= F.to_date(start)))
    return audit.filter(condition)


def within(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """Rows of a trailing window (1h, 4h, 1d, 1w); rows without a time are kept."""
    condition = clock.in_window(F.col("executed_at"), window, as_of)
    return _from(audit, condition, clock.window_start(window, as_of))


def since(audit: DataFrame, text: str | None) -> DataFrame:
    """Rows at or after a time given as text; rows without a time are kept."""
    condition = clock.since(F.col("executed_at"), text)
    return _from(audit, condition, clock.parse_moment(F.lit(text))) if text else audit


def of_scenario(audit: DataFrame, scenario: str | None) -> DataFrame:
    return audit.filter(F.col("scenario") == F.lit(scenario)) if scenario else audit


def of_category(audit: DataFrame, category: str | None = "all") -> DataFrame:
    return audit.filter(outcome.in_category(category))


def recent(audit: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows first, the first ``limit`` of them."""
    return audit.orderBy(*newest_first(*NEWEST)).limit(limit)


def search(
    audit: DataFrame,
    window: str = "1d",
    category: str | None = "all",
    scenario: str | None = None,
    since_text: str | None = None,
    limit: int = 100,
    as_of=None,
) -> DataFrame:
    """Filter by window, since, scenario and category, then the newest ``limit`` rows.

    All filters run before the sort, so only the top rows of each partition move.
    """
    rows = within(audit, window, as_of)
    rows = of_category(of_scenario(since(rows, since_text), scenario), category)
    return recent(rows, limit)


def flags(audit: DataFrame) -> DataFrame:
    """Successful and failed flags per row; a row can be both."""
    return audit.select(
        "exec_id",
        outcome.is_successful().alias("successful"),
        outcome.is_failed().alias("failed"),
    )


# --- counts --------------------------------------------------------------------------------

COUNTS = {
    "total_audit_rows": lambda: F.lit(True),
    "staged_for_concierge": outcome.is_staged,
    "successful_resolutions": outcome.is_successful,
    "hold_and_prompt_actions": outcome.is_hold_prompt,
    "proactive_rebook_actions": outcome.is_rebook,
    "failed_actions": outcome.is_failed,
}


def _counts() -> list:
    return [F.count_if(rule()).alias(name) for name, rule in COUNTS.items()]


def _case_flags() -> list:
    done = outcome.is_pull() & outcome.is_successful()
    return [
        F.max(outcome.is_staged()).alias("was_staged"),
        F.max(done).alias("was_done"),
    ]


def _conversion() -> list:
    named = F.col("case_id").isNotNull()
    staged = F.count_if(named & F.col("was_staged"))
    converted = F.count_if(named & F.col("was_staged") & F.col("was_done"))
    return [
        staged.alias("staged_cases"),
        converted.alias("converted_cases"),
        rate(converted, staged).alias("staged_to_completed_conversion_rate"),
    ]


def execution_stats(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """One row of counts and the conversion rate for a window, from a single scan.

    Rows are folded per case before the shuffle, so a hot case (or all rows without one) arrives
    as one small row per input partition.
    """
    per_case = (
        within(audit, window, as_of)
        .groupBy(outcome.present("case_id").alias("case_id"))
        .agg(*_counts(), *_case_flags())
    )
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTS]
    return per_case.agg(*totals, *_conversion()).withColumn("window", F.lit(window))


def operation_counts(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """The counts alone, without the per-case step."""
    return within(audit, window, as_of).agg(*_counts())


def metric_tiles(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """(metric, value, label, position) for the six counts shown."""
    tiles = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(key).alias("metric"),
                    F.col(column).alias("value"),
                    F.lit(label).alias("label"),
                )
                for i, (key, column, label) in enumerate(wording.METRIC_TILES)
            ]
        )
    )
    return operation_counts(audit, window, as_of).select(tiles.alias("t")).select("t.*")


def case_states(audit: DataFrame) -> DataFrame:
    """Per named case: was it staged, was it completed by a successful pull."""
    return (
        audit.filter(outcome.present("case_id").isNotNull())
        .groupBy("case_id")
        .agg(*_case_flags())
    )


def conversion(audit: DataFrame, window: str | None = None, as_of=None) -> DataFrame:
    """Staged cases, those of them completed, and their ratio (0.0 when none is staged)."""
    rows = within(audit, window, as_of) if window else audit
    return case_states(rows).agg(*_conversion())


def converted_cases(audit: DataFrame) -> DataFrame:
    """Staged cases that were completed."""
    return case_states(audit).filter("was_staged AND was_done").select("case_id")


def count_by(audit: DataFrame, field: str) -> DataFrame:
    """Rows per value of a field, missing values as UNKNOWN."""
    return audit.groupBy(outcome.named(field).alias(field)).agg(F.count(F.lit(1)).alias("n"))


def count_by_fields(
    audit: DataFrame, fields: tuple[str, ...] = ("scenario", "status", "action_taken")
) -> DataFrame:
    """The same for several fields in one pass: (field, value, n)."""
    named = audit.select(*[outcome.named(f).alias(f) for f in fields])
    return (
        named.unpivot([], list(fields), "field", "value")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def execution_breakdown(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """Rows of a window by scenario, status and action: (field, value, n)."""
    return count_by_fields(within(audit, window, as_of))


def whole_stats(audit: DataFrame, window: str = "1d", as_of=None) -> DataFrame:
    """Counts and conversion of a window with its breakdowns as maps: one row."""
    pair = F.struct("value", "n")

    def of(field: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("field") == field, pair)))
        return F.map_from_entries(found)

    names = {"by_scenario": "scenario", "by_status": "status", "by_action": "action_taken"}
    maps = execution_breakdown(audit, window, as_of).agg(*[of(f).alias(n) for n, f in names.items()])
    counts = execution_stats(audit, window, as_of)
    return counts.join(maps.withColumn("window", F.lit(window)), "window")


def case_completions(audit: DataFrame) -> DataFrame:
    """Completed pulls per named case, zero included."""
    done = outcome.is_pull() & (F.col("status") == "SUCCESS")
    return (
        audit.filter(outcome.present("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.count_if(done).alias("completions"))
    )


# --- latest and open cases -----------------------------------------------------------------


def newest_per(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key, ranked from 1.

    Spark keeps only ``n`` rows per key and input partition before it shuffles, so a hot key
    moves a bounded number of rows.
    """
    order = W.partitionBy(key).orderBy(*newest_first(*NEWEST))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def latest_staging(audit: DataFrame) -> DataFrame:
    """Newest staged row of each customer."""
    return newest_per(audit.filter(outcome.is_staged()), "customer_id", 1).drop("rank")


def prior_concierge(audit: DataFrame, case_id: str | None = None, n: int = 5) -> DataFrame:
    """Newest ``n`` pull decisions of each customer, optionally of one case."""
    rows = audit.filter(outcome.is_pull())
    if case_id:
        rows = rows.filter(F.col("case_id") == F.lit(case_id))
    return newest_per(rows, "customer_id", n)


def closed_cases(audit: DataFrame) -> DataFrame:
    """Cases a successful pull has closed."""
    closing = outcome.is_pull() & (F.col("status") == "SUCCESS")
    return audit.filter(closing).select("case_id").distinct()


def open_staging(audit: DataFrame) -> DataFrame:
    """Newest staged row of each customer whose case is not closed.

    A staged row without a case can never be closed, so it stays open.
    """
    return match(latest_staging(audit), closed_cases(audit), "case_id", "left_anti")


def staging_state(audit: DataFrame) -> DataFrame:
    """Newest staged row of each customer with a flag telling whether its case is open."""
    closed = closed_cases(audit).withColumn("__closed", F.lit(True))
    marked = match(latest_staging(audit), closed, "case_id", "left")
    return marked.withColumn("is_open", F.col("__closed").isNull()).drop("__closed")


# --- writing -------------------------------------------------------------------------------


def case_id(customer: str = "customer_id", as_of=None):
    """``CASE-{customer}-{yyyyMMddHHmmss}``."""
    at = clock.stamp(clock.moment(as_of), "yyyyMMddHHmmss")
    return F.concat(F.lit("CASE-"), F.col(customer), F.lit("-"), at)


def row_id(prefix: str, customer: str = "customer_id", row_key: str | None = None, as_of=None):
    """``{prefix}-{yyyy-MM-dd-HHmmss}-{customer}``, plus a row key where one second is too coarse."""
    at = clock.stamp(clock.moment(as_of), "yyyy-MM-dd-HHmmss")
    parts = [F.lit(prefix), at, F.col(customer)]
    if row_key:
        parts.append(F.col(row_key))
    return F.concat_ws("-", *parts)


def to_audit(decisions: DataFrame, row_key: str | None = "pnr", as_of=None) -> DataFrame:
    """Decisions as audit rows: generated ids, one time for the whole batch.

    Needs pnr, customer_id, scenario, action_taken, reasoning and status.  A missing case gets a
    generated id; success_flag is true unless the decisions carry one.
    """
    columns = decisions.columns
    given_case = outcome.present("case_id") if "case_id" in columns else F.lit(None).cast("string")
    flag = F.col("success_flag") if "success_flag" in columns else F.lit(True)
    made = {
        "exec_id": row_id("EXEC", row_key=row_key, as_of=as_of),
        "case_id": F.coalesce(given_case, case_id(as_of=as_of)),
        "success_flag": flag,
        "executed_at": clock.moment(as_of),
    }
    return decisions.select(*[made.get(c, F.col(c)).alias(c) for c in AUDIT_COLUMNS])


def with_document(audit: DataFrame, column: str = "reasoning") -> DataFrame:
    """The log with its reasoning as a VARIANT ``document`` beside the text, so that it is parsed once and stored."""
    return audit.withColumn("document", tx.document(F.col(column)))


def document_rows(audit: DataFrame, fields: list[str]) -> DataFrame:
    """A row per filled field of a stored document: (exec_id, field, value)."""
    values = [F.struct(F.lit(f).alias("field"), tx.document_text(F.col("document"), f).alias("value")) for f in fields]
    return audit.select("exec_id", F.inline(F.array(*values))).filter("value <> ''")
