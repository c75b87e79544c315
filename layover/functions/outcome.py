"""Predicates over audit rows: what counts as staged, successful, failed, held or rebooked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status and action codes the rules compare with.
STAGED = "STAGED_FOR_CONCIERGE"
DONE_STATUSES = ["SUCCESS", "CONFIRMED", "COMPLETED"]
FAIL_MARK = "FAIL"
REBOOK_MARK = "PROACTIVE_REBOOK"
HOLD_ACTION = "HOLD_AND_PROMPT"
PUSH = "PUSH_NBA"
PULL = "PULL_CONCIERGE"
UNKNOWN = "UNKNOWN"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The value, or NULL where it is an empty string: both mean "missing"."""
    return F.nullif(_col(c), F.lit(""))


def stripped(c: Column | str) -> Column:
    """The value without leading and trailing white space of any kind."""
    return F.btrim(_col(c), F.lit(" \t\n\r\x0b\x0c"))


def named(c: Column | str) -> Column:
    """The value, or UNKNOWN where it is missing."""
    return F.coalesce(present(c), F.lit(UNKNOWN))


def says_failed(status: Column | str = "status") -> Column:
    return F.coalesce(F.upper(_col(status)).contains(FAIL_MARK), F.lit(False))


def is_staged(status: Column | str = "status") -> Column:
    return F.coalesce(_col(status) == STAGED, F.lit(False))


def is_rebook(action: Column | str = "action_taken") -> Column:
    return F.coalesce(_col(action).contains(REBOOK_MARK), F.lit(False))


def is_hold_prompt(action: Column | str = "action_taken") -> Column:
    return F.coalesce(_col(action) == HOLD_ACTION, F.lit(False))


def is_pull(scenario: Column | str = "scenario") -> Column:
    return F.coalesce(_col(scenario) == PULL, F.lit(False))


def is_successful(status: Column | str = "status", flag: Column | str = "success_flag") -> Column:
    """A failing status loses, a finished status wins, otherwise the flag decides (NULL = no)."""
    return (
        F.when(says_failed(status), F.lit(False))
        .when(F.upper(_col(status)).isin(DONE_STATUSES), F.lit(True))
        .otherwise(F.coalesce(_col(flag), F.lit(False)))
    )


def is_failed(status: Column | str = "status", flag: Column | str = "success_flag") -> Column:
    """A failing status or a flag that is not true; a row can be both successful and failed."""
    return says_failed(status) | ~F.coalesce(_col(flag), F.lit(False))


CATEGORIES: dict[str, Callable[[], Column]] = {
    "successful": is_successful,
    "autorebook": is_rebook,
    "hold_prompt": is_hold_prompt,
    "hold-and-prompt": is_hold_prompt,
    "hold": is_hold_prompt,
    "staged": is_staged,
    "failed": is_failed,
}


def in_category(category: str | None = "all") -> Column:
    """Predicate for a category name, any case; ``all`` and unknown names keep every row."""
    rule = CATEGORIES.get((category or "all").lower())
    return rule() if rule else F.lit(True)


def status_badge(status: Column | str = "status") -> Column:
    """Display class of a status; the first rule that matches wins."""
    upper = F.upper(_col(status))

    def has(*marks: str) -> Column:
        found = upper.contains(marks[0])
        for mark in marks[1:]:
            found = found | upper.contains(mark)
        return found

    return (
        F.when(has("SUCCESS", "CONFIRMED", "COMPLETED"), "badge-success")
        .when(has("STAGED", "AWAIT"), "badge-staged")
        .when(has("FAIL"), "badge-fail")
        .otherwise("badge-neutral")
    )


def segment_class(archetype: Column | str = "archetype") -> Column:
    """Display class of an archetype name, empty when none of the four is recognised."""
    upper = F.upper(_col(archetype))
    return (
        F.when(upper.contains("SURE"), "sure-thing")
        .when(upper.contains("PERSUADABLE"), "persuadable")
        .when(upper.contains("SLEEPING"), "sleeping-dog")
        .when(upper.contains("CHOICE"), "choice-oriented")
        .otherwise("")
    )
