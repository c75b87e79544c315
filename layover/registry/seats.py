"""Seats for all passengers at risk, by flight and month."""

from pyspark.sql import functions as F

from layover.operators import seats
from layover.registry import part, query

MONTH = ["alternate_flight", "flight_month"]


def by_month(t):
    return t.inventory.withColumn("flight_month", F.to_date(F.date_trunc("month", "departure_time")))


def at_risk(t):
    return t.flight_events.filter("misconnect_risk").select("customer_id", "pnr")


# Rounds as in the operator; twenty are more than any of the test tables needs.
part(
    "d_line",
    """SELECT DISTINCT e.customer_id, e.pnr, row_number() OVER (ORDER BY
  CASE p.loyalty_tier WHEN 'PLATINUM' THEN 0 WHEN 'GOLD' THEN 1 WHEN 'SILVER' THEN 2 WHEN 'BLUE' THEN 3 ELSE 4 END,
  -coalesce(p.lifetime_spend_usd, 0), e.customer_id, e.pnr) AS standing
FROM (SELECT DISTINCT customer_id, pnr FROM v_flight_events WHERE misconnect_risk) e LEFT JOIN v_profile p ON p.customer_id = e.customer_id""",
)
part("d_months", "SELECT *, CAST(date_trunc('month', departure_time) AS DATE) AS flight_month FROM v_inventory")
part("d_seats", "SELECT alternate_flight, flight_month, min(greatest(coalesce(seats_available, 0), 0)) AS seats FROM d_months GROUP BY 1, 2")
part(
    "d_claims",
    """SELECT l.*, o.alternate_flight, o.flight_month, s.seats, o.lookup_id, row_number() OVER (PARTITION BY l.standing ORDER BY o.arrival_time, o.lookup_id) AS choice
FROM d_line l JOIN (SELECT pnr, alternate_flight, flight_month, arrival_time, lookup_id FROM d_months WHERE seats_available > 0
  QUALIFY row_number() OVER (PARTITION BY pnr, alternate_flight, flight_month ORDER BY arrival_time, lookup_id) = 1) o ON o.pnr = l.pnr
JOIN d_seats s ON s.alternate_flight = o.alternate_flight AND s.flight_month = o.flight_month AND s.seats > 0""",
)
ROUNDS = """SELECT 0 AS round, CAST('' AS VARCHAR) AS alternate_flight, DATE '1970-01-01' AS flight_month, CAST(0 AS BIGINT) AS bar
UNION ALL
SELECT round, alternate_flight, flight_month, standing FROM (
 SELECT *, row_number() OVER (PARTITION BY alternate_flight, flight_month ORDER BY standing) AS nth FROM (
  SELECT c.*, r.round + 1 AS round, row_number() OVER (PARTITION BY c.standing ORDER BY choice) AS pick
  FROM d_claims c JOIN (SELECT DISTINCT round FROM bars WHERE round < 20) r ON true
  LEFT JOIN bars b ON b.alternate_flight = c.alternate_flight AND b.flight_month = c.flight_month
  WHERE b.bar IS NULL OR c.standing <= b.bar) WHERE pick = 1) WHERE nth = seats"""
MET = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alternate_flight, flight_month ORDER BY standing) AS nth FROM (
 SELECT c.*, row_number() OVER (PARTITION BY c.standing ORDER BY choice) AS pick FROM d_claims c
 LEFT JOIN (SELECT * FROM bars WHERE round = (SELECT max(round) FROM bars)) b ON b.alternate_flight = c.alternate_flight AND b.flight_month = c.flight_month
 WHERE b.bar IS NULL OR c.standing <= b.bar) WHERE pick = 1) WHERE nth <= seats"""

query(
    "seat_assignment",
    f"""SELECT l.customer_id, l.pnr, m.alternate_flight, m.flight_month, m.lookup_id
FROM d_line l LEFT JOIN (WITH RECURSIVE bars AS ({ROUNDS}) {MET}) m ON m.standing = l.standing""",
)(lambda t: seats.seat_choices(at_risk(t), t.profile, by_month(t), MONTH))

query(
    "hold_within_seats",
    f"""SELECT i.lookup_id, i.pnr, i.alternate_flight, CASE WHEN m.lookup_id IS NOT NULL THEN 'HELD' ELSE i.hold_status END AS hold_status,
 CASE WHEN m.lookup_id IS NOT NULL THEN 'AVAILABLE' ELSE i.inventory_status END AS inventory_status,
 CAST(CASE WHEN g.n IS NULL THEN i.seats_available ELSE greatest(i.seats_available - g.n, 0) END AS INTEGER) AS seats_available
FROM d_months i LEFT JOIN (SELECT DISTINCT pnr, lookup_id FROM (WITH RECURSIVE bars AS ({ROUNDS}) {MET})) m ON m.pnr = i.pnr AND m.lookup_id = i.lookup_id
LEFT JOIN (SELECT alternate_flight, flight_month, count(*) AS n FROM (WITH RECURSIVE bars AS ({ROUNDS}) {MET}) GROUP BY 1, 2) g
 ON g.alternate_flight = i.alternate_flight AND g.flight_month = i.flight_month""",
)(
    lambda t: seats.take_seats(by_month(t), seats.seat_choices(at_risk(t), t.profile, by_month(t), MONTH), MONTH).select(
        "lookup_id", "pnr", "alternate_flight", "hold_status", "inventory_status", "seats_available"
    )
)
