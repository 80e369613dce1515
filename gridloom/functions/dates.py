"""Business days and date formatting. A missing date is NULL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from .core import col

#: Formats that print a date or time down to a unit.
FORMATS = {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss"}


@dataclass(frozen=True)
class BusDayCalendar:
    """Working days of a week (Monday first) and holidays (ISO dates)."""

    weekmask: Sequence[bool] = (True, True, True, True, True, False, False)
    holidays: Sequence[str] = ()

    @property
    def days(self) -> list[str]:
        """Holidays that fall on working days, in order."""
        import datetime

        return sorted({h for h in self.holidays if self.weekmask[datetime.date.fromisoformat(h).weekday()]})


busdaycalendar = BusDayCalendar
_DEFAULT = BusDayCalendar()


def isnat(x: Any) -> Column:
    return col(x).isNull()


def datetime_as_string(x: Any, unit: str = "s") -> Column:
    return F.date_format(col(x), FORMATS[unit])


def datetime_data(dtype: str) -> tuple[str, int]:
    """(unit, 1) of a type such as ``datetime64[D]``."""
    unit = dtype.partition("[")[2].rstrip("]")
    if not dtype.startswith(("datetime64", "timedelta64")):
        raise TypeError(f"not a date or time type: {dtype}")
    return unit or "generic", 1


def is_busday(dates: Any, calendar: BusDayCalendar = _DEFAULT) -> Column:
    day = col(dates).cast("date")
    works = F.element_at(F.array(*(F.lit(bool(b)) for b in calendar.weekmask)), F.weekday(day) + 1)
    if calendar.days:
        works = works & ~day.isin([F.lit(h).cast("date") for h in calendar.days])
    return F.coalesce(works, F.lit(False))


def _passed(day: Column, calendar: BusDayCalendar) -> Column:
    """Working days before ``day``, counted from a fixed Monday: a closed form without enumeration."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    weeks, rest = F.floor(n / 7), F.pmod(n, F.lit(7))
    before = [sum(bool(b) for b in calendar.weekmask[:k]) for k in range(7)]
    out = weeks * (before[6] + int(bool(calendar.weekmask[6]))) + F.element_at(F.array(*(F.lit(b) for b in before)), rest + 1)
    for h in calendar.days:
        out = out - (F.lit(h).cast("date") < day).cast("int")
    return out.cast("bigint")


def busday_count(begindates: Any, enddates: Any, calendar: BusDayCalendar = _DEFAULT) -> Column:
    """Working days in [begin, end); 0 where end is not after begin."""
    a, b = col(begindates).cast("date"), col(enddates).cast("date")
    return F.greatest(F.lit(0).cast("bigint"), _passed(b, calendar) - _passed(a, calendar))


def busday_offset(dates: Any, offsets: Any, calendar: BusDayCalendar = _DEFAULT) -> Column:
    """Move by working days; an offset of 0 leaves the date as it is."""
    day, n = col(dates).cast("date"), col(offsets).cast("int")
    per_week = sum(map(bool, calendar.weekmask))
    if not per_week:
        raise ValueError("the calendar has no working day")
    # enough calendar days to hold the working days asked for, whatever holidays lie there
    reach = F.ceil(F.abs(n) / per_week).cast("int") * 7 + 7 + len(calendar.days)
    ahead = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, reach)), lambda d: is_busday(d, calendar))
    behind = F.filter(F.sequence(F.date_sub(day, 1), F.date_sub(day, reach)), lambda d: is_busday(d, calendar))
    return F.when(n == 0, day).when(n > 0, F.get(ahead, n - 1)).otherwise(F.get(behind, -n - 1))
