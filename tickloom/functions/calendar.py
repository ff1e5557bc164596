"""Weekly closure, modelled entry gate and schedule windows, as column arithmetic.

All of it is computed from the row's own instants, so no calendar table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.columns import C, col

NEW_YORK = "America/New_York"
# A gap is at most this long; six Fridays cover it with one to spare.
MAX_SPAN_DAYS = 32
_WEEKS = 6


def local_time(t: C, zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(col(t), zone)


def _at_local(day: Column, hour: float, zone: str = NEW_YORK) -> Column:
    wall = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.lit(int(hour * 3600 * 1_000_000)))
    return F.to_utc_timestamp(wall, zone)


def _last_friday(t: C) -> Column:
    """Local date of the last Friday at or before ``t``."""
    day = F.to_date(local_time(t))
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(4), F.lit(7)).cast("int"))


def closed_seconds(start: C, end: C) -> Column:
    """Seconds of [start, end) inside weekly closures, Friday 17:00 to Sunday 17:00 New York."""
    s, e = F.unix_micros(col(start)), F.unix_micros(col(end))
    friday = _last_friday(end)
    total = F.lit(0).cast("bigint")
    for back in range(_WEEKS):
        day = F.date_sub(friday, 7 * back)
        cs, ce = F.unix_micros(_at_local(day, 17)), F.unix_micros(_at_local(F.date_add(day, 2), 17))
        total = total + F.greatest(F.least(e, ce) - F.greatest(s, cs), F.lit(0))
    return total / F.lit(1_000_000)


def open_seconds(start: C, end: C) -> Column:
    """Trading seconds between two instants; NULL beyond the supported span."""
    span = (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1_000_000)
    return F.when(F.abs(span) <= MAX_SPAN_DAYS * 86400, span - closed_seconds(start, end))


def covers_closed(start: C, end: C) -> Column:
    return (col(end) > col(start)) & (open_seconds(start, end) == 0)


# Modelled daily and weekly times, in seconds of the New York day.
FRIDAY_CLOSE = 16 * 3600 + 55 * 60
SUNDAY_OPEN = 17 * 3600 + 60
FINANCING = 17 * 3600
BREAK_START = 16 * 3600 + 59 * 60
BREAK_END = 17 * 3600 + 60


def entry_gate(t: C, *, minutes: float = 30, daily: bool = True) -> Column:
    """Reason why an entry at ``t`` is blocked by the modelled calendar, or NULL."""
    local = local_time(t)
    dow = F.weekday(local)  # Monday is 0
    sec = F.pmod(F.unix_micros(local), F.lit(86_400_000_000)) / F.lit(1_000_000)
    window = minutes * 60

    def ahead(at: int, days: Column) -> Column:
        """Seconds from now to the wall time ``at`` on the day ``days`` from now, over DST."""
        target = F.unix_micros(_at_local(F.date_add(F.to_date(local), days.cast("int")), at / 3600))
        return (target - F.unix_micros(col(t))) / F.lit(1_000_000)

    to_friday = F.pmod(F.lit(4) - dow, F.lit(7))
    weekly = ahead(FRIDAY_CLOSE, F.when((to_friday == 0) & (sec >= FRIDAY_CLOSE), F.lit(7)).otherwise(to_friday))
    next_day = F.when(sec >= FINANCING, F.lit(1)).otherwise(F.lit(0))
    landing = F.pmod(dow + next_day, F.lit(7))
    skip = F.when(landing == 5, F.lit(2)).when(landing == 6, F.lit(1)).otherwise(F.lit(0))
    financing = ahead(FINANCING, next_day + skip)
    daily_break = ahead(BREAK_START, F.when(sec >= BREAK_START, F.lit(1)).otherwise(F.lit(0)))

    weekend = (dow == 5) | ((dow == 6) & (sec < SUNDAY_OPEN)) | ((dow == 4) & (sec >= FRIDAY_CLOSE))
    out = F.when(weekend, "WEEKEND_CLOSED")
    out = out.when((sec >= BREAK_START) & (sec < BREAK_END), "DAILY_BREAK")
    out = out.when(weekly.between(0, window), "PRE_WEEKLY_CLOSE")
    if daily:
        out = out.when(financing.between(0, window), "PRE_FINANCING")
        out = out.when(daily_break.between(0, window), "PRE_DAILY_BREAK")
    return out


def next_weekly_close(t: C) -> Column:
    """First modelled Friday close strictly after ``t``, as a UTC instant."""
    local = local_time(t)
    sec = F.pmod(F.unix_micros(local), F.lit(86_400_000_000)) / F.lit(1_000_000)
    days = F.pmod(F.lit(4) - F.weekday(local), F.lit(7))
    days = F.when((days == 0) & (sec >= FRIDAY_CLOSE), F.lit(7)).otherwise(days)
    return _at_local(F.date_add(F.to_date(local), days.cast("int")), FRIDAY_CLOSE / 3600)


def schedule_state(
    start: C, end: C, weekly: list[tuple[int, int]], holidays: list[tuple[str, str]], zone: str = NEW_YORK
) -> Column:
    """OPEN, CLOSED_SCHEDULED or UNKNOWN for a window of at most one hour.

    ``weekly`` holds half-open intervals in seconds since Sunday 00:00 local time;
    ``holidays`` holds half-open UTC intervals as ISO text. Both lists are configuration,
    a few entries long. The window is OPEN when its covered seconds equal its length.
    """
    s, e = F.unix_micros(col(start)), F.unix_micros(col(end))
    second = 1_000_000
    week = 7 * 86400 * second
    local = local_time(start, zone)
    day = F.pmod(F.dayofweek(local) - 1, F.lit(7)).cast("bigint") * F.lit(86400 * second)
    since_sunday = day + F.pmod(F.unix_micros(local), F.lit(86400 * second))
    length = e - s
    covered = F.lit(0).cast("bigint")
    for lo, hi in weekly:
        for shift in (0, week):
            covered = covered + F.greatest(
                F.least(since_sunday + length, F.lit(hi * second + shift))
                - F.greatest(since_sunday, F.lit(lo * second + shift)),
                F.lit(0),
            )
    on_holiday = F.lit(False)
    for lo, hi in holidays:
        on_holiday = on_holiday | ((col(start) < F.lit(hi).cast("timestamp")) & (col(end) > F.lit(lo).cast("timestamp")))
    usable = (length > 0) & (length <= 3600 * second)
    return (
        F.when(~usable | usable.isNull(), "UNKNOWN")
        .when(on_holiday | (covered < length), "CLOSED_SCHEDULED")
        .otherwise("OPEN")
    )
