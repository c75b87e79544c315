"""Seats given to all passengers at once: nobody is put on a full flight, nobody without need on a worse one.

A claim says that a passenger would take a flight, and how much they like it.  Passengers have one order of
standing (tier, spend, …).  ``settle_claims`` gives what taking them one by one in this order would give, each
the best flight that still has a seat, but in rounds over whole tables: everybody asks for the best flight
still open to them; a flight with more requests than seats keeps those of the highest standing, and from then
on is open only to a standing above the last one kept.  That bar can only rise, so all that goes from round to
round is one row per full flight, and a round in which no bar moves ends it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.functions.clock import arrival_hour_needed
from layover.operators.inventory import HELD
from layover.operators.keys import attach, match, rows_for
from layover.sources.tables import settle

#: Tiers from the highest standing to the lowest; others and unknown ones come last.  Fixed values.
TIERS = ("PLATINUM", "GOLD", "SILVER", "BLUE")
FLIGHT = ("alternate_flight", "departure_time")
#: A flight's requests are first cut to its seats in so many parts, so a wanted flight is not one task.
PARTS = 32


def standing(profiles: DataFrame) -> DataFrame:
    """Each customer's place in line: (customer_id, standing); a smaller standing comes first.

    By tier, then lifetime spend, then id.
    """
    tier = F.coalesce(*[F.when(F.col("loyalty_tier") == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))
    spend = F.coalesce(F.col("lifetime_spend_usd").cast("double"), F.lit(0.0))
    place = F.struct(tier.alias("tier"), (-spend).alias("spend"), F.col("customer_id").alias("id"))
    return profiles.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.min(place).alias("standing"))


def flight_seats(inventory: DataFrame, flight: Iterable[str] = FLIGHT) -> DataFrame:
    """Seats of each flight.  Rows of several PNRs may tell of one flight; the smallest number counts."""
    seats = F.greatest(F.coalesce("seats_available", F.lit(0)), F.lit(0))
    return inventory.groupBy(*flight).agg(F.min(seats).alias("seats"))


def claims(passengers: DataFrame, profiles: DataFrame, inventory: DataFrame, flight: Iterable[str] = FLIGHT) -> DataFrame:
    """What each passenger (customer_id, pnr) would take: one claim per flight on offer to their PNR.

    Returns (customer_id, pnr, *flight, lookup_id, standing, choice); a smaller ``choice`` is liked better: the
    earliest arrival, then the lower id.  A flight offered twice to a PNR is claimed once.  ``limit_hour``, if
    the passengers have one, leaves out flights that land later on their departure day.  A booking has few
    passengers and few flights, so claims grow with both tables and not with their product.
    """
    flight = list(flight)
    limited = "limit_hour" in passengers.columns
    people = passengers.select("customer_id", "pnr", *(["limit_hour"] if limited else [])).filter(
        "customer_id IS NOT NULL AND pnr IS NOT NULL"
    ).dropDuplicates(["customer_id", "pnr"])
    hour = arrival_hour_needed(F.col("departure_time"), F.col("arrival_time"))
    liking = F.struct("arrival_time", "lookup_id")
    offers = rows_for(inventory, "pnr", people).filter(F.col("seats_available") > 0)
    offers = offers.groupBy("pnr", *flight).agg(F.min(liking).alias("choice"), F.min_by(hour, liking).alias("__hour"))
    line = attach(people, standing(profiles), "customer_id")
    lowest = F.struct(F.lit(len(TIERS)).alias("tier"), F.lit(0.0).alias("spend"), F.col("customer_id").alias("id"))
    line = line.withColumn("standing", F.struct(F.coalesce("standing", lowest).alias("customer"), F.col("pnr")))
    met = offers.join(line, "pnr")
    if limited:
        met = met.filter(F.col("limit_hour").isNull() | (F.col("__hour") <= F.col("limit_hour")))
    return met.select("customer_id", "pnr", *flight, F.col("choice.lookup_id").alias("lookup_id"), "standing", "choice")


def kept(requests: DataFrame, flight: list[str]) -> DataFrame:
    """Requests ranked within their flight by standing, as far as there are seats (``nth``)."""
    part = F.pmod(F.xxhash64("standing"), F.lit(PARTS))
    some = requests.withColumn("__part", part).withColumn(
        "nth", F.row_number().over(W.partitionBy(*flight, "__part").orderBy("standing"))
    )
    some = some.filter(F.col("nth") <= F.col("seats")).drop("__part")
    ranked = some.withColumn("nth", F.row_number().over(W.partitionBy(*flight).orderBy("standing")))
    return ranked.filter(F.col("nth") <= F.col("seats"))


def settle_claims(claimed: DataFrame, seats: DataFrame, flight: Iterable[str] = FLIGHT, claimant: Iterable[str] = ("customer_id", "pnr")) -> DataFrame:
    """The flight each claimant gets: the claims that are met, one at most per claimant.

    ``claimed`` has the claimant's and the flight's columns, ``standing`` (unlike for any two claimants) and
    ``choice`` (unlike for any two claims of a claimant); both may be of any type that has an order, and a smaller
    one comes first.  ``seats`` has a row per flight.  Claims on flights it does not know, with null in a flight's
    columns, or on flights without seats are never met.
    """
    flight, claimant = list(flight), list(claimant)
    known = settle(match(claimed, seats.filter("seats > 0"), flight, "inner"), "claims")
    bars = known.sparkSession.createDataFrame([], known.select(*flight, F.col("standing").alias("bar")).schema)
    row = F.struct(*[c for c in known.columns if c not in claimant])
    while True:
        open_now = attach(known, bars, flight).filter(F.col("bar").isNull() | (F.col("standing") <= F.col("bar")))
        asked = open_now.groupBy(*claimant).agg(F.min_by(row, "choice").alias("__row")).select(*claimant, "__row.*")
        met = settle(kept(asked, flight), "seats")
        full = met.filter(F.col("nth") == F.col("seats")).select(*flight, F.col("standing").alias("bar"))
        moved = full.join(bars, [*flight, "bar"], "left_anti").limit(1).count()
        if not moved:
            return met.drop("nth", "seats")
        bars = full


def seat_choices(
    passengers: DataFrame, profiles: DataFrame, inventory: DataFrame, flight: Iterable[str] = FLIGHT
) -> DataFrame:
    """The flight with a seat for every passenger, null where none is left: (customer_id, pnr, *flight, lookup_id)."""
    flight = list(flight)
    claimed = claims(passengers, profiles, inventory, flight)
    met = settle_claims(claimed, flight_seats(inventory, flight), flight).select("customer_id", "pnr", *flight, "lookup_id")
    people = passengers.select("customer_id", "pnr").filter("customer_id IS NOT NULL AND pnr IS NOT NULL").distinct()
    return people.join(met, ["customer_id", "pnr"], "left")


def take_seats(inventory: DataFrame, chosen: DataFrame, flight: Iterable[str] = FLIGHT) -> DataFrame:
    """The inventory after seats are given: chosen rows held, and every row of a flight with as many seats fewer.

    ``chosen`` is what ``seat_choices`` gives.  Only rows of the flights that lose seats are looked up.
    """
    flight, columns = list(flight), inventory.columns
    given = chosen.filter("lookup_id IS NOT NULL")
    taken = given.groupBy(*flight).agg(F.count(F.lit(1)).cast("int").alias("__taken"))
    held = given.select("pnr", "lookup_id").distinct().withColumn("__held", F.lit(True))
    rows = attach(attach(inventory, taken, flight), held, ["pnr", "lookup_id"])
    mine = F.coalesce("__held", F.lit(False))
    seats: Column = F.when(F.col("__taken").isNull(), F.col("seats_available")).otherwise(
        F.greatest(F.col("seats_available") - F.col("__taken"), F.lit(0))
    )
    after = {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in HELD.items()} | {"seats_available": seats.cast("int")}
    return rows.select(*[after.get(c, F.col(c)).alias(c) for c in columns])
