"""Date and time functions over columns. "Now" is always an ``as_of`` column; days are UTC days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import bound

# Date formats that feeds use, tried in order, each with a pattern that any value of the format has. A value
# that a format does not fit costs far more than one that it fits.
FORMATS = {"MMM d, yyyy": ",", "MMMM d, yyyy": ",", "d MMM yyyy": "^[^,]* [^,]*$", "M/d/yyyy": "/", "yyyy-MM-dd HH:mm:ss": "-[^-]*-.* .*:", "yyyy-M-d": "-[^- ]+-[^- ]+$"}


def as_utc(c: Column) -> Column:
    """A timestamp, from a timestamp without zone too, read as UTC under the session's zone."""
    return c.cast("timestamp")


def posted_since(c: Column, as_of: Column) -> Column:
    """Time of "Posted 8 Days Ago" and its like; "30+ Days" is 31 days; null where it names no age."""
    low = F.lower(c)
    n = F.regexp_extract(low, r"(\d+)\s*\+?\s*(?:hour|day|week|month)", 1)
    amount = F.when(n != "", n.cast("int") + low.rlike(r"\d\s*\+").cast("int"))
    unit = F.regexp_extract(low, r"\d+\s*\+?\s*(hour|day|week|month)", 1)
    ago = lambda **k: as_of - F.make_interval(**k)
    return (
        F.when(low.rlike(r"\btoday\b|just posted"), as_of)
        .when(low.rlike(r"\byesterday\b"), ago(days=F.lit(1)))
        .when(unit == "hour", ago(hours=amount))
        .when(unit == "day", ago(days=amount))
        .when(unit == "week", ago(weeks=amount))
        .when((unit == "month") & (amount >= 2), ago(months=amount))
    )


def parse_date(c: Column) -> Column:
    """Timestamp of a date in any known format, or ISO; null where it is none."""

    def parsed(v: Column) -> Column:
        known = [F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(f))) for f, shape in FORMATS.items()]
        return F.coalesce(*known, F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(v)))

    # "28-SEP-2026" has the month in capitals, which the format does not take.
    spaced = lambda v: F.when(v.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.initcap(F.replace(v, F.lit("-"), F.lit(" ")))).otherwise(v)
    return bound(bound(F.trim(c), spaced), parsed)


def end_of_day(day: Column, offset: str = "+00:00") -> Column:
    """The last second of a local day at a fixed offset."""
    return F.to_utc_timestamp(F.date_trunc("day", day) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), offset)


def believable(posted: Column, modified: Column, as_of: Column, days: int = 365) -> Column:
    """The posted date where its age is from 0 to under ``days`` days, else the last modification."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(posted)
    return F.when((age >= 0) & (age < days * 86400), posted).otherwise(modified)


def utc_day(c: Column) -> Column:
    return F.to_date(c)


def posted_ago(c: Column, as_of: Column) -> Column:
    """Age in whole days, in words; the future counts as today."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(c)) / 86400)
    return F.when(days <= 0, "Posted today").when(days == 1, "Posted 1 day ago").otherwise(F.concat(F.lit("Posted "), days.cast("string"), F.lit(" days ago")))
