"""The operations desk: the tables bound once, each question and each action one call.

Questions return DataFrames.  Actions return the next state of the table they change, or the rows
to append; ``layover.sources.tables`` writes them.  A log stored with ``audit.with_day`` and
partitioned by that day makes window questions read only the days they need.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.functions import clock
from layover.functions.outcome import STAGED
from layover.operators import audit as au
from layover.operators import decisions, inventory, passengers
from layover.operators.keys import newest_first, rows_for
from layover.sources.schemas import CHAT_COLUMNS
from layover.sources.tables import settle

Keys = str | Iterable[str] | DataFrame


def to_chat(
    messages: DataFrame, sentiment: str = "CALM", row_key: str | None = None, as_of=None
) -> DataFrame:
    """Messages (pnr, customer_id, message_text) as chat signal rows with generated ids."""
    given = F.col("sentiment") if "sentiment" in messages.columns else F.lit(None).cast("string")
    made = {
        "signal_id": au.row_id("SIG", row_key=row_key, as_of=as_of),
        "signal_timestamp": clock.moment(as_of),
        "sentiment": F.coalesce(given, F.lit(sentiment)),
    }
    return messages.select(*[made.get(c, F.col(c)).alias(c) for c in CHAT_COLUMNS])


@dataclass(frozen=True)
class Desk:
    events: DataFrame
    signals: DataFrame
    shelf: DataFrame
    uplift: DataFrame
    inventory: DataFrame
    audit: DataFrame
    profiles: DataFrame

    # --- about passengers

    def events_of(self, customers: Keys) -> DataFrame:
        return rows_for(self.events, "customer_id", customers)

    def signals_of(self, customers: Keys) -> DataFrame:
        return rows_for(self.signals, "customer_id", customers)

    def operational_context(self, customers: Keys) -> DataFrame:
        """All events and chat signals of customers, with all their columns."""
        return passengers.context_items(self.events_of(customers), self.signals_of(customers))

    def uplift_and_actions(self, customers: Keys) -> DataFrame:
        return passengers.uplift_with_actions(rows_for(self.uplift, "customer_id", customers), self.shelf)

    def profile_of(self, customers: Keys) -> DataFrame:
        return rows_for(self.profiles, "customer_id", customers)

    def affected(self, event_prefix: str | None = None) -> DataFrame:
        return passengers.affected(self.events, event_prefix)

    def recent_events(self) -> DataFrame:
        return self.events.orderBy(*newest_first("event_timestamp", "event_id"))

    def recent_signals(self) -> DataFrame:
        return self.signals.orderBy(*newest_first("signal_timestamp", "signal_id"))

    def segment_cards(self) -> DataFrame:
        return passengers.segment_cards(self.profiles, self.uplift)

    def push_trace(self, event_prefix: str | None = None) -> DataFrame:
        """Why each affected passenger gets their action, step by step."""
        routed = decisions.push_routing(self.affected(event_prefix), self.uplift, self.shelf)
        return decisions.push_trace(routed, self.events, self.profiles)

    def pull_trace(self, messages: DataFrame, as_of=None) -> DataFrame:
        return decisions.decision_trace(decisions.concierge_steps(messages, self.audit, as_of))

    # --- about the audit log

    def results(
        self,
        window: str = "1w",
        category: str = "all",
        scenario: str | None = None,
        since: str | None = None,
        limit: int = 50,
        as_of=None,
    ) -> DataFrame:
        return au.search(self.audit, window, category, scenario, since, limit, as_of)

    def session_results(self, scenario: str, since: str | None = None, as_of=None) -> DataFrame:
        """Rows one session produced: a week back, one scenario, 20 at most."""
        return self.results("1w", "all", scenario, since, 20, as_of)

    def stats(self, window: str = "1d", as_of=None) -> DataFrame:
        """Counts, conversion and the rows by scenario, status and action of one window, as one row."""
        return au.whole_stats(self.audit, window, as_of)

    def staging_of(self, customers: Keys) -> DataFrame:
        return au.latest_staging(rows_for(self.audit, "customer_id", customers))

    def prior_decisions_of(self, customers: Keys, case_id: str | None = None) -> DataFrame:
        return au.prior_concierge(rows_for(self.audit, "customer_id", customers), case_id)

    def next_steps(self) -> DataFrame:
        return decisions.next_step(self.profiles, self.audit, self.signals)

    # --- inventory

    def inventory_of(self, pnrs: Keys) -> DataFrame:
        return inventory.for_pnrs(self.inventory, pnrs)

    def place_holds(self, pnrs: Keys, **options) -> DataFrame:
        return inventory.place_holds(self.inventory, pnrs, **options)

    def re_hold(self, pnrs: Keys, flights: str = "EK372,EK380") -> DataFrame:
        return inventory.re_hold(self.inventory, pnrs, flights)

    def confirm(self, choices: DataFrame) -> DataFrame:
        return inventory.confirm_and_release(self.inventory, choices)

    # --- whole jobs

    def push(self, event_prefix: str | None = None, as_of=None) -> tuple[DataFrame, DataFrame]:
        """Decide for every affected passenger: (audit rows to append, inventory after holds).

        The decisions are written to the shared folder first: both results start from them.
        """
        decided = decisions.push_routing(self.affected(event_prefix), self.uplift, self.shelf)
        routed = settle(decided, "push")
        asked = routed.filter(F.col("status") == STAGED)
        return au.to_audit(routed, as_of=as_of), inventory.place_holds(self.inventory, asked)

    def pull(self, messages: DataFrame, as_of=None, templates=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Resolve answered chat messages: (audit rows, chat rows, inventory afterwards).

        Per message a case is continued, held again or staged first (``decisions.concierge_steps``).
        The choices are written to the shared folder first, so that a few of them do not make the
        whole inventory move.
        """
        steps = decisions.concierge_steps(messages, self.audit, as_of, templates)
        resolved = decisions.resolutions(steps, as_of).unionByName(decisions.stagings(steps, as_of))
        said = messages.select("pnr", "customer_id", "message_text", "signal_id")
        choices = settle(decisions.latest_choices(steps), "choices")
        after = inventory.confirm_and_release(self.inventory, choices)
        return resolved, to_chat(said, row_key="signal_id", as_of=as_of), after

    def contrast(self) -> DataFrame:
        return decisions.rules_contrast(self.events, self.profiles, self.signals, self.inventory)
