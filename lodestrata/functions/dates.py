"""Dates in questions and texts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.fixed import DAY_FIRST, ISO_INSTANT, LAST_WEEKDAY, MONTH_ALONE, MONTH_FIRST, MONTHS, NUMBER_AGO, ONE_AGO, THIRD_OF_MONTH, WEEK_OF_MONTH, WEEKDAYS, YEAR_ALONE


def _month(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)]), c)


def _number(c: Column) -> Column:
    return F.expr("NULL").cast("int") if c is None else F.nullif(c, F.lit("")).try_cast("int")


def _window(found: Column, since: Column, until: Column) -> Column:
    return F.when(found, F.struct(since.cast("string").alias("since"), until.cast("string").alias("until")))


def date_window(text: Column) -> Column:
    """since and until (days, inclusive) that a question asks for, else null.

    In order: a week of a month, a third of a month, a day and two around it, a
    month, a year after "in" or "during".
    """
    t = F.lower(text)
    day = lambda y, m, d: F.make_date(y, m, d)
    part = lambda p, i: F.regexp_extract(t, p, i)

    week = WEEK_OF_MONTH
    first = day(_number(part(week, 3)), _month(part(week, 2)), F.lit(1))
    last = F.last_day(first)
    nth = F.element_at(F.create_map(*[F.lit(x) for x in ("first", 0, "second", 7, "third", 14, "fourth", 21)]), part(week, 1))
    w1 = _window(t.rlike(week), F.when(part(week, 1) == "last", F.date_sub(last, 6)).otherwise(F.date_add(first, nth)), F.when(part(week, 1) == "last", last).otherwise(F.least(F.date_add(first, nth + 6), last)))

    third = THIRD_OF_MONTH
    begin = day(_number(part(third, 3)), _month(part(third, 2)), F.lit(1))
    shift = F.element_at(F.create_map(*[F.lit(x) for x in ("early", 0, "mid", 10, "late", 20)]), part(third, 1))
    w2 = _window(t.rlike(third), F.date_add(begin, shift), F.when(part(third, 1) == "late", F.last_day(begin)).otherwise(F.date_add(begin, shift + 9)))

    day_first, month_first = DAY_FIRST, MONTH_FIRST
    is_day = t.rlike(day_first)
    d = _number(F.when(is_day, part(day_first, 1)).otherwise(part(month_first, 2)))
    start = day(_number(F.when(is_day, part(day_first, 3)).otherwise(part(month_first, 3))), _month(F.when(is_day, part(day_first, 2)).otherwise(part(month_first, 1))), F.lit(1))
    center = F.date_add(start, d - 1)
    w3 = _window((is_day | t.rlike(month_first)) & d.between(1, 31), F.date_sub(center, 2), F.date_add(center, 2))

    month = MONTH_ALONE
    of = day(_number(part(month, 2)), _month(part(month, 1)), F.lit(1))
    w4 = _window(t.rlike(month), of, F.last_day(of))

    year = YEAR_ALONE
    y = part(year, 1)
    w5 = F.when(t.rlike(year), F.struct(F.concat(y, F.lit("-01-01")).alias("since"), F.concat(y, F.lit("-12-31")).alias("until")))
    return F.coalesce(w1, w2, w3, w4, w5)


def _years(ref: Column, n: Column) -> Column:
    """``n`` years before; the 29th of February becomes the 1st of March where there is none."""
    back = F.add_months(ref, -12 * n)
    return F.when((F.month(ref) == 2) & (F.dayofmonth(ref) == 29) & (F.dayofmonth(back) == 28), F.date_add(back, 1)).otherwise(back)


def relative_date(text: Column, ref: Column) -> Column:
    """The day (as text) that the first relative cue in a text means, seen from ``ref``; null without a cue."""
    t, day = F.lower(text), ref.cast("date")
    ago, one, weekday = NUMBER_AGO, ONE_AGO, LAST_WEEKDAY
    n, unit = _number(F.regexp_extract(t, ago, 1)), F.regexp_extract(t, ago, 2)

    def back(unit: Column, n: Column) -> Column:
        return F.when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, 7 * n)).when(unit == "month", F.add_months(day, -n)).when(unit == "year", _years(day, n))

    number = F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w, i)]), F.regexp_extract(t, weekday, 1))
    delta = F.pmod(F.dayofweek(day) - 1 - number, F.lit(7))
    found = (
        F.when(t.rlike(r"\bday before yesterday\b"), F.date_sub(day, 2))
        .when(t.rlike(r"\byesterday\b"), F.date_sub(day, 1))
        .when(t.rlike(ago), back(unit, n))
        .when(t.rlike(one), back(F.regexp_extract(t, one, 1), F.lit(1)))
        .when(t.rlike(weekday), F.date_sub(day, F.when(delta == 0, 7).otherwise(delta)))
        .when(t.rlike(r"\blast\s+week\b"), F.date_sub(day, 7))
        .when(t.rlike(r"\blast\s+month\b"), F.add_months(day, -1))
        .when(t.rlike(r"\blast\s+year\b"), _years(day, F.lit(1)))
    )
    return found.cast("string")


def is_iso(c: Column) -> Column:
    """A full ISO-8601 instant with a T and a zone, and a real one."""
    return F.coalesce(c.rlike(ISO_INSTANT) & F.substring(c, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def dated_snippet(at: Column, text: Column) -> Column:
    return F.when(at.isNull(), text).otherwise(F.concat(F.lit("["), F.substring(at.cast("string"), 1, 10), F.lit("] "), text))


def iso_week(c: Column) -> Column:
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
