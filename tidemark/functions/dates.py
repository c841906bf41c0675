"""Calendar dates in text. The day of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _groups(c: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), _date(part(1), part(2), part(3)))


def calendar_date(c: Column) -> Column:
    """A date at the beginning, as 20yy-m-d; null for none or an impossible one."""
    return _groups(F.trim(c), r"^(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})")


def any_calendar_date(c: Column) -> Column:
    """The first date anywhere, as 20yy.m.d, 20yy/m/d, 20yy-m-d or with CJK marks."""
    return _groups(c, r"(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})")


# Months of RFC 2822 dates.
_MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13)))


def rfc_date(c: Column) -> Column:
    """The UTC date of an RFC 2822 time; null if it is none."""
    p = r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) (?:([+-]\d{2})(\d{2})|GMT|UT|UTC)$"
    part = lambda i: F.regexp_extract(c, p, i)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv]), F.lower(part(2)))
    at = F.try_make_timestamp(part(3).try_cast("int"), month, part(1).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("int"), part(6).try_cast("decimal(8,6)"))
    off = F.when(part(7) == "", 0).otherwise(part(7).try_cast("int") * 60 + F.when(part(7).startswith("-"), -1).otherwise(1) * part(8).try_cast("int"))
    return F.when(c.rlike(p), F.to_date(F.timestamp_seconds(F.unix_seconds(at) - off * 60)))


def source_date(c: Column) -> Column:
    """ISO text of eight digits, a leading y-m-d or y/m/d, or an RFC 2822 time; other text unchanged."""
    t = F.trim(c)
    eight = _groups(t, r"^(\d{4})(\d{2})(\d{2})$")
    ymd = _groups(t, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})")
    return F.coalesce(F.coalesce(eight, ymd, rfc_date(t)).cast("string"), t)


# Days of the units of relative dates.
UNIT_DAYS = {"second": 0, "minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365, "秒": 0, "分": 0, "時間": 0, "日": 1, "週間": 7, "か月": 30, "ヶ月": 30, "月": 30, "年": 365}


def relative_date(c: Column, as_of: Column) -> Column:
    """The date that lies a number of units before as_of; null for other text. A month has 30 days, a year 365."""
    en, ja = r"(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", r"(\d+)\s*(秒|分|時間|日|週間|か月|ヶ月|月|年)前"
    low = F.lower(c)
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    back = lambda p: F.date_sub(as_of, F.regexp_extract(low, p, 1).try_cast("int") * F.element_at(table, F.regexp_extract(low, p, 2)))
    return F.when(low.rlike(en), back(en)).when(low.rlike(ja), back(ja))


def age_days(d: Column, as_of: Column) -> Column:
    return F.datediff(as_of, d)


def in_range(d: Column, as_of: Column, days: int, is_event: Column | None = None) -> Column:
    """Dated within the last days, events within days to either side; no date passes."""
    age = age_days(d, as_of)
    plain = (age >= 0) & (age < days)
    if is_event is not None:
        plain = F.when(is_event, (-age >= -days) & (-age < days)).otherwise(plain)
    return F.coalesce(plain, F.lit(True))
