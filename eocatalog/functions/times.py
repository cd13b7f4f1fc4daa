"""Calendar periods, search times and durations, on the driver; time columns for plans."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = dt.timezone.utc


def local_time(ts: Column, tz: str) -> Column:
    """A UTC time without zone as wall time in tz, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def midpoint(begin: Column, end: Column) -> Column:
    """The middle of two times in whole microseconds, rounded down."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    half = F.floor((micros(end) - micros(begin)) / 2)
    return F.timestamp_micros(micros(begin) + half).cast("timestamp_ntz")


def period_bounds(year: int | None = None, month: int | None = None, day: int | None = None, tz: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """Half-open bounds, in UTC, of a calendar year, month or day of tz; all time without a year."""
    zone = ZoneInfo(tz)
    if year is None:
        begin, end = dt.datetime(1971, 1, 1), dt.datetime(2071, 1, 1)
    elif month is None:
        begin, end = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    elif day is None:
        begin, end = dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1)
    else:
        begin = dt.datetime(year, month, day)
        end = begin + dt.timedelta(days=1)
    return tuple(t.replace(tzinfo=zone).astimezone(UTC) for t in (begin, end))


def encode_period(year: int | None, month: int | None = None, day: int | None = None) -> tuple[str, dt.date]:
    """Period kind and first day as stored; all time starts in 1900."""
    kind = "all" if year is None else "year" if month is None else "month" if day is None else "day"
    return kind, dt.date(year or 1900, month or 1, day or 1)


def decode_period(kind: str, start: dt.date) -> tuple[int | None, int | None, int | None]:
    parts = {"all": 0, "year": 1, "month": 2, "day": 3}[kind]
    found = (start.year, start.month, start.day)
    return tuple(found[i] if i < parts else None for i in range(3))


def months_between(first: dt.date, last: dt.date) -> list[tuple[int, int]]:
    """Calendar months from first to last, both included; swapped when in the wrong order."""
    if last < first:
        raise ValueError("the last month is before the first")
    start, stop = first.year * 12 + first.month - 1, last.year * 12 + last.month - 1
    return [(m // 12, m % 12 + 1) for m in range(start, stop + 1)]


def _instant(text: str) -> dt.datetime:
    found = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00").replace("z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def parse_search_time(text: str, now: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """An instant (to the second after), a date (to the day after), or begin/end with open ends ``..``."""
    now = now or dt.datetime.now(UTC)
    if "/" in text:
        begin, end = (x.strip() for x in text.split("/", 1))
        if begin in ("", "..") and end in ("", ".."):
            return None
        first = dt.datetime(1971, 1, 1, tzinfo=UTC) if begin in ("", "..") else _instant(begin)
        return first, now + dt.timedelta(days=2) if end in ("", "..") else _instant(end)
    begin = _instant(text)
    whole_day = re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip())
    return begin, begin + (dt.timedelta(days=1) if whole_day else dt.timedelta(seconds=1))


_UNITS = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds"}


def parse_duration(text: str) -> dt.timedelta:
    """``1d2h``-like durations of weeks, days, hours, minutes and seconds, each at most once, in order."""
    m = re.fullmatch("".join(rf"(?:(?P<{u}>\d+){u})?" for u in _UNITS), text.strip())
    if not text.strip() or not m:
        raise ValueError(f"not a duration: {text!r}")
    return dt.timedelta(**{_UNITS[u]: int(v) for u, v in m.groupdict().items() if v})


def add_default_zone(ts: Column, tz: str) -> Column:
    """A time without zone taken as wall time of tz, in UTC."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), ts.cast("timestamp_ntz"))


def shift_open_range(begin, end, earliest, latest):
    """Open ends filled from a product's bounds (the day after its latest), a reversed range swapped."""
    begin = earliest if begin is None else begin
    end = latest + dt.timedelta(days=1) if end is None else end
    return (end, begin) if end < begin else (begin, end)


def month_name(day: Column) -> Column:
    """``January 2024``"""
    return F.date_format(day, "MMMM yyyy")


def since(ts: Column, now: Column) -> Column:
    """How long ago a time is, in its largest unit: ``3 hours ago``; ``in`` the future before it, ``just now`` within a minute."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    past = seconds >= 0
    seconds = F.floor(F.abs(seconds) / 1_000_000)
    out = F.lit("just now")
    for name, size in (("minute", 60), ("hour", 3600), ("day", 86_400), ("month", 30 * 86_400), ("year", 365 * 86_400)):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(seconds >= size, F.when(past, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))).otherwise(out)
    return F.when(ts.isNotNull() & now.isNotNull(), out)


def iso_duration(seconds: Column) -> Column:
    """``P1DT2H3M4S``; ``PT0S`` for none, a minus before a negative one."""
    whole = F.floor(F.abs(seconds)).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    days, clock = F.floor(whole / 86_400), whole % 86_400
    time = F.concat(part(F.floor(clock / 3600), "H"), part(F.floor(clock % 3600 / 60), "M"), part(clock % 60, "S"))
    text = F.concat(F.lit("P"), part(days, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(whole == 0, "PT0S").otherwise(text))
