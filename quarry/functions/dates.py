"""Dates and times by the ISO grammar, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO = "[0-9]{2}"
_DIGITS = rf"(?:{_TWO}(?::{_TWO}(?::{_TWO})?)?|{_TWO}{_TWO}(?:{_TWO})?)"
#: Hours, minutes and seconds, with colons or without, and a fraction of a second behind any of them.
_CLOCK = rf"(?:{_DIGITS}(?:[.,][0-9]+)?)"
_OFFSET = rf"(?:Z|[+-]{_CLOCK})"
#: Any one character parts date and time. Before an offset the reader that is followed here lets one more ASCII character
#: pass behind the clock, and anything behind six digits of a fraction.
_ODD = rf"(?:{_DIGITS}(?:[.,][0-9]{{1,5}}|[.,][0-9]{{6}}[^+\-Z]*|[\x00-\x7F&&[^+\-Z]])?)"
_TIME = rf"(?:.(?:({_CLOCK})|({_ODD})({_OFFSET})))?\z"
_CALENDAR = rf"(?s)^([0-9]{{4}})(?:-({_TWO})-({_TWO})|({_TWO})({_TWO})){_TIME}"
# the weekday is left out where a digit begins or parts what follows: after a dash if two digits come, and in a run of
# digits behind the week if their number is odd and over one
_WEEK = rf"(?s)^([0-9]{{4}})(?:-W({_TWO})(?:-([0-9])(?![0-9]))?+|W({_TWO})(?:([0-9])(?:(?![0-9])|(?=[0-9](?:[0-9]{{2}})*(?![0-9]))))?+){_TIME}"


def _number(c: Column, pattern: str, *groups: int) -> Column:
    """The first of a pattern's groups that is there, as a number; null if none is."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, g), F.lit("")) for g in groups])
    return found.try_cast("int")


def _parts(text: Column) -> list[Column]:
    """Hours, minutes and seconds of a clock time (digits, maybe with colons and a fraction); 0 for those it lacks."""
    digits = F.regexp_replace(F.regexp_replace(text, "(?s)[.,].*", ""), "[^0-9]", "")
    return [F.coalesce(F.nullif(F.substring(digits, i, 2), F.lit("")).try_cast("int"), F.lit(0)) for i in (1, 3, 5)]


def _timely(text: Column, pattern: str) -> Column:
    """Whether the clock of a matched text is within a day, and its offset under one."""
    hours, minutes, seconds = _parts(F.concat(F.regexp_extract(text, pattern, 6), F.regexp_extract(text, pattern, 7)))
    h, m, s = _parts(F.regexp_extract(text, pattern, 8))
    return (hours < 24) & (minutes < 60) & (seconds < 60) & (h * 3600 + m * 60 + s < 86400)


def is_iso(text: Column) -> Column:
    """Whether text is a date, or a date and time, of the ISO grammar: `YYYY-MM-DD`, `YYYYMMDD`, `YYYY-Www[-D]` or `YYYYWww[D]`,
    then any one character and `HH[:MM[:SS]][.fff]` or the same without colons, then `Z` or an offset of under a day.

    Years run from 1 to 9999, days are those of their month, weeks those of their year. Null is false. No reduced or
    ordinal dates, no hour 24, no second 60.
    """
    year, month, day = _number(text, _CALENDAR, 1), _number(text, _CALENDAR, 2, 4), _number(text, _CALENDAR, 3, 5)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    calendar = text.rlike(_CALENDAR) & (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= days)

    y, week, weekday = _number(text, _WEEK, 1), _number(text, _WEEK, 2, 4), F.coalesce(_number(text, _WEEK, 3, 5), F.lit(1))
    before = lambda n: (n + F.floor(n / 4) - F.floor(n / 100) + F.floor(n / 400)) % 7  # noqa: E731  the weekday of a year's last day
    long = (before(y) == 4) | (before(y - 1) == 3)
    # the last week may end in a year that there is not
    within = F.when(y == 9999, (week < 52) | ((week == 52) & (weekday <= 5))).otherwise(F.lit(True))
    weeks = text.rlike(_WEEK) & (y >= 1) & (week >= 1) & (week <= F.when(long, 53).otherwise(52)) & weekday.between(1, 7) & within

    return F.coalesce((calendar & _timely(text, _CALENDAR)) | (weeks & _timely(text, _WEEK)), F.lit(False))
