"""Holds, confirmations and releases on the flight inventory, for all passengers at once.

Every function returns the whole table in its next state.  ``choices`` tables hold one row per
PNR: (pnr, chosen_flight) and, where releases are listed, release_flights as a comma list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.functions import wording
from layover.functions.text import flight_list
from layover.operators.keys import attach, rows_for
from layover.operators.mutate import is_true, update_where

# Hold states, and the inventory states that go with them.
HELD = {"hold_status": "HELD", "inventory_status": "AVAILABLE"}
CONFIRMED = {"hold_status": "CONFIRMED", "inventory_status": "CONFIRMED"}
RELEASED = {"hold_status": "RELEASED"}


def _set(values: dict[str, str]) -> dict[str, Column]:
    return {c: F.lit(v) for c, v in values.items()}


def for_pnrs(inventory: DataFrame, pnrs: str | Iterable[str] | DataFrame) -> DataFrame:
    """Inventory of one or many PNRs, by departure."""
    return rows_for(inventory, "pnr", pnrs).orderBy("pnr", "departure_time", "lookup_id")


def place_holds(
    inventory: DataFrame,
    pnrs: str | Iterable[str] | DataFrame,
    flights: Iterable[str] = tuple(wording.HELD_FLIGHTS),
    require_seats: bool = False,
) -> DataFrame:
    """Hold the named flights for the given PNRs.

    Seats are not checked unless asked, so a full or confirmed row is overwritten too.  With a
    table of PNRs only the rows of the named flights are shuffled; the rest pass straight through.
    """
    named = F.col("alternate_flight").isin(list(flights))
    if require_seats:
        named = named & (F.col("seats_available") > 0)
    if isinstance(pnrs, DataFrame):
        wanted = pnrs.select("pnr").distinct().withColumn("__wanted", F.lit(True))
        hits = attach(inventory.filter(named), wanted, "pnr")
        held = update_where(hits, F.col("__wanted"), _set(HELD)).select(*inventory.columns)
        return held.unionByName(inventory.filter(~is_true(named)))
    values = [pnrs] if isinstance(pnrs, str) else list(pnrs)
    return update_where(inventory, named & F.col("pnr").isin(values), _set(HELD))


def re_hold(
    inventory: DataFrame,
    pnrs: str | Iterable[str] | DataFrame,
    flights: str = ",".join(wording.HELD_FLIGHTS),
) -> DataFrame:
    """Hold the flights of a comma list again."""
    names = [f.strip() for f in flights.split(",") if f.strip()]
    return place_holds(inventory, pnrs, names)


def confirm(inventory: DataFrame, choices: DataFrame) -> DataFrame:
    """Confirm the chosen flight of each PNR; nothing else changes."""
    joined = attach(inventory, choices.select("pnr", "chosen_flight"), "pnr")
    chosen = F.col("alternate_flight") == F.col("chosen_flight")
    return update_where(joined, chosen, _set(CONFIRMED)).select(*inventory.columns)


def release(inventory: DataFrame, choices: DataFrame) -> DataFrame:
    """Release the listed flights of each PNR; the inventory state is kept."""
    lists = choices.select("pnr", flight_list(F.col("release_flights")).alias("__listed"))
    joined = attach(inventory, lists, "pnr")
    listed = F.array_contains("__listed", F.col("alternate_flight"))
    return update_where(joined, listed, _set(RELEASED)).select(*inventory.columns)


def confirm_and_release(
    inventory: DataFrame, choices: DataFrame, salts: int | None = None, bucketed: bool = False
) -> DataFrame:
    """Confirm the chosen flight and release others, in one pass.

    Flights to release are the listed ones, or every other flight when none is listed.  Release
    comes after confirmation: a flight in both ends released, with inventory confirmed.

    Where ``choices`` have a true ``hold_again``, the flights on offer are held anew first, which frees
    what an earlier choice had confirmed.

    ``bucketed`` says that both tables are stored in buckets of the PNR: they then meet without
    a shuffle, at the price that a hot PNR stays in its bucket.
    """
    lists = choices.columns
    listed = F.col("release_flights") if "release_flights" in lists else F.lit(None).cast("string")
    again = F.col("hold_again") if "hold_again" in lists else F.lit(False)
    lookup = choices.select("pnr", "chosen_flight", flight_list(listed).alias("__listed"), again.alias("__again"))
    if bucketed:
        joined = inventory.join(lookup, "pnr", "left")
    else:
        joined = attach(inventory, lookup, "pnr", salts=salts)
    flight = F.col("alternate_flight")
    chosen = is_true(flight == F.col("chosen_flight"))
    freed = is_true(
        F.when(F.size("__listed") > 0, F.array_contains("__listed", flight)).otherwise(
            (flight != "") & (flight != F.col("chosen_flight"))
        )
    )
    anew = is_true(F.col("__again")) & flight.isin(wording.HELD_FLIGHTS)
    held = (
        F.when(freed, RELEASED["hold_status"])
        .when(chosen, CONFIRMED["hold_status"])
        .when(anew, HELD["hold_status"])
        .otherwise(F.col("hold_status"))
    )
    state = (
        F.when(chosen, CONFIRMED["inventory_status"])
        .when(anew, HELD["inventory_status"])
        .otherwise(F.col("inventory_status"))
    )
    next_state = {"hold_status": held, "inventory_status": state}
    return joined.select(*[next_state.get(c, F.col(c)).alias(c) for c in inventory.columns])


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose hold or inventory state differs from ``before``, by lookup_id."""
    state = ["hold_status", "inventory_status"]
    old = before.select("lookup_id", *[F.col(c).alias(f"__{c}") for c in state])
    joined = attach(after, old, "lookup_id", "inner")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in state]
    return joined.filter(~(same[0] & same[1])).select(*after.columns)


def release_candidates(inventory: DataFrame, choices: DataFrame) -> DataFrame:
    """Flights of a PNR other than the chosen one."""
    joined = attach(inventory, choices.select("pnr", "chosen_flight"), "pnr", "inner")
    return joined.filter(
        (F.col("alternate_flight") != "") & (F.col("alternate_flight") != F.col("chosen_flight"))
    ).select("pnr", "lookup_id", "alternate_flight", "chosen_flight")
