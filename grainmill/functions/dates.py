"""Dates, money and units: the calculator's functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

#: Factors to the first unit of each group.
UNITS = {"g": ("mass", "1"), "kg": ("mass", "1000"), "lb": ("mass", "453.59237"), "minutes": ("time", "1"), "hours": ("time", "60"), "fraction": ("share", "1"), "percent": ("share", "0.01")}


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(text: Col) -> Column:
    """ISO dates and date-times, ``Month D, YYYY`` and ``D Month YYYY``, with full or short months; else null."""
    t = F.trim(_c(text))
    return F.coalesce(F.try_to_date(F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}(?=$|[T ])", 0), "yyyy-MM-dd"), *[F.try_to_date(t, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")])


def add_months(day: Col, months: Col | int) -> Column:
    """Clamped to the month's end; null beyond 1,200 months."""
    m = F.lit(months) if isinstance(months, int) else _c(months)
    return F.when(F.abs(m) <= 1200, F.add_months(_c(day), m))


def business_days(start: Col, end: Col) -> Column:
    """Weekdays after the start up to the end, negative if the end is earlier; in closed form."""
    a, b = _c(start), _c(end)

    def upto(d: Column) -> Column:
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
        weeks = F.floor(n / 7)
        return weeks * 5 + F.least(n - weeks * 7 + 1, F.lit(5))

    return F.when(b >= a, upto(b) - upto(a)).otherwise(-(upto(a) - upto(b))).cast("int")


def nth_workday(start: Col, n: Col | int, holidays: Column | None = None, weekend: tuple[int, ...] = (1, 7), inclusive: bool = False) -> Column:
    """The n-th day from the start that is no weekend day (1 is Sunday) and no holiday."""
    s, k = _c(start), F.lit(n) if isinstance(n, int) else _c(n)
    days = F.sequence(s if inclusive else F.date_add(s, 1), F.date_add(s, (k * 3 + 30).cast("int")))
    open_ = F.filter(days, lambda d: ~F.dayofweek(d).isin(*weekend) & (F.lit(True) if holidays is None else ~F.array_contains(holidays, d)))
    return F.get(open_, k - 1)


def is_leap(year: Col) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def to_utc(local: Col, offset_minutes: Col) -> Column:
    return _c(local) - F.make_dt_interval(mins=_c(offset_minutes))


def minutes_between(start: Col, end: Col) -> Column:
    return F.timestamp_diff("MINUTE", _c(start), _c(end))


def cents(value: Col) -> Column:
    """Two decimals, half up."""
    return F.round(_c(value), 2)


def convert(value: Col, source: str, target: str) -> Column:
    if UNITS[source][0] != UNITS[target][0]:
        raise ValueError("units of different kinds")
    return _c(value).cast("decimal(30,10)") * F.lit(UNITS[source][1]).cast("decimal(18,8)") / F.lit(UNITS[target][1]).cast("decimal(18,8)")


def combinations(n: Col, k: Col) -> Column:
    """n over k, exact while products stay below 2^53; null outside 0 <= k <= n <= 10000."""
    a, b = _c(n), _c(k)
    low = F.least(b, a - b)
    steps = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when((b >= 0) & (b <= a) & (a <= 10000), F.aggregate(steps, F.lit(1.0), lambda acc, i: F.round(acc * (a - low + i) / i)))


def effective(day: Col, since: Col, new: Column, old: Column) -> Column:
    """The new rule from its effective date on."""
    return F.when(_c(day) >= _c(since), new).otherwise(old)
