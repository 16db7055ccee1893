"""Date and time functions with PostgreSQL's semantics as Spark columns. Keep the session in UTC.

Intervals of months, days and time are structs (months int, days int, micros long).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.string import date_format

now = current_timestamp = F.current_timestamp
current_date, local_timestamp, current_time, make_date = F.current_date, F.localtimestamp, F.current_time, F.make_date
local_time = F.current_time
DAY = 86_400_000_000


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """SQL OVERLAPS: ends in any order, half open, equal ends are an instant; three-valued with NULLs."""
    a, b, c, d = _low(s1, e1), _high(s1, e1), _low(s2, e2), _high(s2, e2)
    return (a == c) | ((a < c) & (c < b)) | ((c < a) & (a < d))


def _low(s: Column, e: Column) -> Column:
    """The earlier end; with one NULL the other end, as if it came first."""
    return F.coalesce(F.least(s, e), s, e)


def _high(s: Column, e: Column) -> Column:
    return F.when(s.isNotNull() & e.isNotNull(), F.greatest(s, e))


def extract(field: str, e: Column) -> Column:
    """A field as a decimal or integer; ``dow`` counts from Sunday = 0, ``epoch`` has fractions."""
    name = field.lower()
    year = F.year(e)
    micros = F.unix_micros(e.cast("timestamp"))
    seconds = F.pmod(micros, F.lit(60_000_000))
    own = {
        "epoch": lambda: (micros.cast("decimal(30,6)") / 1_000_000).cast("decimal(30,6)"),
        "dow": lambda: F.dayofweek(e) - 1,
        "isodow": lambda: F.pmod(F.dayofweek(e) + 5, F.lit(7)) + 1,
        "doy": lambda: F.dayofyear(e),
        "century": lambda: F.ceil(year / 100).cast("int"),
        "decade": lambda: F.floor(year / 10).cast("int"),
        "millennium": lambda: F.ceil(year / 1000).cast("int"),
        "second": lambda: (seconds.cast("decimal(20,6)") / 1_000_000).cast("decimal(8,6)"),
        "milliseconds": lambda: (seconds.cast("decimal(20,3)") / 1000).cast("decimal(20,3)"),
        "microseconds": lambda: seconds,
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), e),
    }
    return own[name]() if name in own else F.extract(F.lit(name.upper()), e)


def date_trunc(field: str, e: Column, of: str = "timestamp_ntz") -> Column:
    """Truncated in the argument's type (Spark gives a zoned timestamp for each)."""
    return F.date_trunc(field, e).cast(of)


def interval(months, days, micros) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def age(a: Column, b: Column) -> Column:
    """Symbolic a - b: field by field, borrowing days from the length of the month of the earlier one."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    late, early, sign = F.greatest(a, b), F.least(a, b), F.when(a < b, -1).otherwise(1)
    of_day = lambda t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp"))
    micros = of_day(late) - of_day(early)
    short_day = F.when(micros < 0, 1).otherwise(0)
    days = F.dayofmonth(late) - F.dayofmonth(early) - short_day
    # the month that lends its days is the earlier operand's, or the one before the later operand's where the sign is negative
    lender = F.when(a < b, F.dayofmonth(F.last_day(early))).otherwise(F.dayofmonth(F.last_day(early)))
    short_month = F.when(days < 0, 1).otherwise(0)
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - short_month
    return interval(sign * months, sign * (days + short_month * lender), sign * (micros + short_day * F.lit(DAY)))


def age_today(e: Column) -> Column:
    """Age against midnight today."""
    return age(F.current_date(), e)


def _whole(a: Column, n: int) -> Column:
    """Quotient toward zero."""
    return F.when(a < 0, F.ceil(a / n)).otherwise(F.floor(a / n)).cast("long")


def justify_days(i: Column) -> Column:
    """Thirty days become a month; signs then agree."""
    months, days = _agree(i["months"] + _whole(i["days"], 30), i["days"] - _whole(i["days"], 30) * 30, 30)
    return interval(months, days, i["micros"])


def justify_hours(i: Column) -> Column:
    """24 hours become a day; signs then agree."""
    whole = _whole(i["micros"], DAY)
    days, micros = _agree(i["days"] + whole, i["micros"] - whole * DAY, DAY)
    return interval(i["months"], days, micros)


def _agree(high: Column, low: Column, unit: int) -> tuple[Column, Column]:
    """Move one unit where the two signs differ."""
    move = F.when((high > 0) & (low < 0), 1).when((high < 0) & (low > 0), -1).otherwise(0)
    return high - move, low + move * F.lit(unit)


def justify_interval(i: Column) -> Column:
    """Days from hours, months from days, and one sign for all fields."""
    total = i["days"].cast("long") * F.lit(DAY) + i["micros"]
    month = 30 * DAY
    months = i["months"] + _whole(total, month)
    rest = total - _whole(total, month) * F.lit(month)
    months, rest = _agree(months, rest, month)
    days = _whole(rest, DAY)
    return interval(months, days, rest - days * F.lit(DAY))


def make_time(h: Column, m: Column, s: Column) -> Column:
    return F.make_time(h, m, s)


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(y, mo, d, h, mi, s)


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_date(s: Column, picture: str) -> Column:
    return F.to_date(s, date_format(picture))
