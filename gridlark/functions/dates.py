"""Dates as day counts with week masks and holidays, as Column expressions.

A date beyond the calendar is null where arrays would hold not-a-time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Working days from Monday to Sunday.
WEEK = "1111100"


def is_busday(d: Column, week: str = WEEK, holidays: list[str] = []) -> Column:  # noqa: B006
    works = F.substring(F.lit(week), F.weekday(d) + 1, F.lit(1)) == "1"
    return works & ~F.coalesce(d.cast("date").isin([F.lit(h).cast("date") for h in holidays]), F.lit(False)) if holidays else works


def busday_count(begin: Column, end: Column, week: str = WEEK, holidays: list[str] = []) -> Column:  # noqa: B006
    """Working days from begin on and before end; negative where end is before begin. By whole weeks and at most six days
    more, without listing the days."""
    def upto(d: Column) -> Column:
        days = F.datediff(d, F.lit("1969-12-29").cast("date"))  # a Monday
        weeks, rest = F.floor(days / 7), F.pmod(days, F.lit(7))
        inner = F.element_at(F.array(*(F.lit(sum(c == "1" for c in week[:k])) for k in range(7))), (rest + 1).cast("int"))
        out = weeks * sum(c == "1" for c in week) + inner
        for h in sorted(set(holidays)):
            day = F.lit(h).cast("date")
            out = out - F.when((day < d) & is_busday(day, week), 1).otherwise(0)
        return out

    backward = end < begin
    one = F.lit(1)
    forward = upto(end) - upto(begin)
    return F.when(backward, -(upto(F.date_add(begin, one)) - upto(F.date_add(end, one)))).otherwise(forward).cast("long")


def busday_offset(d: Column, n: Column | int, week: str = WEEK, roll: str = "raise") -> Column:
    """The n-th working day after d (before, for negative n); a d that isn't one is first moved: forward or backward."""
    n = n if isinstance(n, Column) else F.lit(n)
    per = sum(c == "1" for c in week)
    day = F.weekday(d)
    ahead = F.element_at(F.array(*(F.lit(next(k for k in range(7) if week[(w + k) % 7] == "1")) for w in range(7))), day + 1)
    back = F.element_at(F.array(*(F.lit(next(k for k in range(7) if week[(w - k) % 7] == "1")) for w in range(7))), day + 1)
    start = {"forward": F.date_add(d, ahead), "backward": F.date_sub(d, back), "raise": F.when(ahead == 0, d.cast("date")).otherwise(F.raise_error(F.lit("not a working day")).cast("date"))}[roll]
    # Working days before the start's weekday, then to the place in the week where the n-th after it lies.
    before = F.element_at(F.array(*(F.lit(sum(c == "1" for c in week[:w])) for w in range(7))), F.weekday(start) + 1)
    to = before + n
    weeks, rest = F.floor(to / per), F.pmod(to, F.lit(per))
    at = F.element_at(F.array(*(F.lit(k) for k, c in enumerate(week) if c == "1")), (rest + 1).cast("int"))
    return F.date_add(start, (weeks * 7 + at - F.weekday(start)).cast("int"))


def days(d: Column) -> Column:
    """Day count from 1970."""
    return F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long")


def months(d: Column) -> Column:
    """Calendar months from 1970."""
    return ((F.year(d) - 1970) * 12 + F.month(d) - 1).cast("long")


def date_range(spark, start: str, stop: str, step: int = 1):
    """i0, v: dates from start, before stop."""
    return spark.sql(f"SELECT explode(sequence(0, greatest(0, ceil(datediff(date'{stop}', date'{start}') / {step})) - 1)) AS k").where("k >= 0").select(F.col("k").cast("long").alias("i0"), F.expr(f"date_add(date'{start}', cast(k * {step} as int))").alias("v"))
