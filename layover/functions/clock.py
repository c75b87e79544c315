"""Wall-clock rules.  All times are zone-free (TIMESTAMP_NTZ); no rule depends on the session zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from layover.functions.outcome import stripped

# Window names and their length in hours, and the length for an unknown name.
WINDOW_HOURS = {"1h": 1, "4h": 4, "1d": 24, "1w": 168}
DEFAULT_WINDOW_HOURS = 24

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

MAIL_DATE = r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{1,2}:\d{1,2}) [A-Za-z]+$"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}(:\d{1,2}.*)?)?$"
#: ISO without separators: a date, and a time of two, four or six digits after it.
COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})(?=$|[ T])"
COMPACT_TIME = r"([ T]\d{2})(\d{2})(\d{2})?(?=$|\.)"
HOUR_ONLY = r"([ T]\d{1,2})$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"


def moment(as_of: str | datetime | Column | None = None) -> Column:
    """The instant a rule is evaluated at: a fixed one when given, else the local clock."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def window_start(window: str, as_of=None) -> Column:
    """Lower bound of a trailing window; an unknown name means 24 hours."""
    hours = WINDOW_HOURS.get(window, DEFAULT_WINDOW_HOURS)
    return moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))


def in_window(at: Column, window: str, as_of=None) -> Column:
    """Trailing window: lower bound inclusive, no upper bound, unknown times kept.

    The time column stays bare on the left so the predicate reaches the file statistics.
    """
    return at.isNull() | (at >= window_start(window, as_of))


def since(at: Column, text: str | None) -> Column:
    """At or after ``text``; empty or unreadable text switches the filter off."""
    if not text:
        return F.lit(True)
    bound = parse_moment(F.lit(text))
    return bound.isNull() | at.isNull() | (at >= bound)


def parse_moment(text: Column) -> Column:
    """Read a time in ``yyyy-MM-dd HH:mm:ss``, mail-date or ISO form; anything else is NULL.

    The wall time is kept and any zone is dropped, so the answer does not depend on a zone.
    """
    trimmed = stripped(text)
    month = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(trimmed, MAIL_DATE, 2))
    )
    mail = F.concat_ws(
        " ",
        F.concat_ws(
            "-",
            F.regexp_extract(trimmed, MAIL_DATE, 3),
            month.cast("string"),
            F.regexp_extract(trimmed, MAIL_DATE, 1),
        ),
        F.regexp_extract(trimmed, MAIL_DATE, 4),
    )
    day_first = F.regexp_replace(trimmed, COMPACT_DATE, "$1-$2-$3")
    # A zone can only follow a time; "-01" at the end of a date is its day.
    timed = day_first.rlike(r"[ T]\d")
    bare = F.when(timed, F.regexp_replace(day_first, ZONE_SUFFIX, "")).otherwise(day_first)
    spread = F.regexp_replace(F.regexp_replace(bare, COMPACT_TIME, "$1:$2:$3"), r":(?=$|\.)", ":00")
    iso = F.regexp_replace(spread, HOUR_ONLY, "$1:00")
    return (
        F.when(trimmed.rlike(MAIL_DATE), mail.try_cast("timestamp_ntz"))
        .when(iso.rlike(ISO_DATE), iso.try_cast("timestamp_ntz"))
    )


def stamp(at: Column, pattern: str) -> Column:
    return F.date_format(at, pattern)


def arrival_hour_needed(departure: Column, arrival: Column) -> Column:
    """Smallest whole hour ``h`` with ``arrival <= midnight of the departure day + h hours``."""
    part = (F.minute(arrival) > 0) | (F.extract(F.lit("SECOND"), arrival) > 0)
    return F.datediff(arrival, departure) * 24 + F.hour(arrival) + part.cast("int")
