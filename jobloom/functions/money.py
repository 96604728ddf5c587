"""Pay out of prose, pay periods and plausible bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible pay by period, and the amount below which an unlabelled amount is by the hour.
HOUR_LOW, HOUR_HIGH, YEAR_LOW, YEAR_HIGH, HOURLY_BELOW = 10, 500, 15_000, 1_000_000, 1000
AMOUNT = r"(?:\$|CAD)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
RANGE_TAIL = r"(?:\$|CAD)\s*[0-9][0-9,.]*\s*(?:-|–|to)\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"


#: Two amounts with a dash or "to" between them, each with or without its currency.
BETWEEN = r"(?:CAD\s*)?\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:to|[-–])\s*(?:CAD\s*)?\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"


def stated_range(text: Column, before: str = "", after: str = "()") -> Column:
    """(low, high, unit) of the first two amounts that stand between the given words, in any case; nulls without any.

    ``after`` has one group, the unit.
    """
    part = lambda i: F.nullif(F.regexp_extract(text, rf"(?im){before}\s*{BETWEEN}{after}", i), F.lit(""))
    number = lambda i: F.replace(part(i), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(number(1).alias("low"), number(2).alias("high"), F.lower(part(3)).alias("unit"))


def pay_range(text: Column) -> Column:
    """(low, high, period) of all amounts in a text; null where there is none, or where they make no range."""
    number = lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")
    found = F.concat(F.regexp_extract_all(text, F.lit(AMOUNT), 1), F.regexp_extract_all(text, F.lit(RANGE_TAIL), 1))
    amounts = F.filter(F.transform(found, number), lambda a: a.isNotNull())
    low, high = F.array_min(amounts), F.array_max(amounts)
    good = (F.size(amounts) > 0) & (low > 0) & (low <= high)
    return F.when(good, F.struct(low.alias("low"), high.alias("high"), pay_period(text, high).alias("period")))


def pay_period(label: Column, high: Column) -> Column:
    """The period that a label names, else by the hour below a limit and by the year from it."""
    words = F.lower(label)
    return F.when(words.rlike(r"per hour|/ ?hr\b|/ ?hour|hourly|an hour"), "hour").when(words.rlike(r"per year|per annum|/ ?yr\b|/ ?year|annual|yearly|salary"), "year").when(high < HOURLY_BELOW, "hour").otherwise("year")


def is_plausible_band(low: Column, high: Column, period: Column) -> Column:
    """True where both bounds are given, ordered and of a believable size for the period."""
    fits = F.when(period == "hour", (low >= HOUR_LOW) & (high <= HOUR_HIGH)).when(period == "year", (low >= YEAR_LOW) & (high <= YEAR_HIGH))
    return F.coalesce((low > 0) & (high >= low) & fits, F.lit(False))


def format_pay(amount: Column, period: Column) -> Column:
    return F.when(period == "hour", F.concat(F.lit("$"), F.format_string("%.2f", amount.cast("double")), F.lit("/hr"))).otherwise(F.concat(F.lit("$"), F.format_number(F.floor(amount + 0.5), 0), F.lit("/yr")))
