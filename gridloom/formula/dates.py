"""Serial dates: days since the end of 1899, with the 29 February 1900 that never was as day 60."""

from __future__ import annotations

import calendar
import datetime as dt
import math

from gridloom.formula.values import fail

_EPOCH = dt.date(1899, 12, 30)
_OFFSET_1904 = 1462
LAST = 2_958_465


def ymd(serial: float, date1904: bool = False) -> tuple[int, int, int]:
    n = math.floor(serial) + (_OFFSET_1904 if date1904 else 0)
    if not 0 <= n <= LAST:
        fail("#NUM!")
    if n == 60:
        return 1900, 2, 29
    if n == 0:
        return 1900, 1, 0
    d = _EPOCH + dt.timedelta(days=n if n > 60 else n + 1)
    return d.year, d.month, d.day


def serial(y: int, m: int, d: int, date1904: bool = False) -> float:
    """Months and days run over; years before 1900 count from 1900."""
    if 0 <= y < 1900:
        y += 1900
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    if not 1900 <= y <= 9999:
        fail("#NUM!")
    n = (dt.date(y, m, 1) - _EPOCH).days
    n = (n if n > 60 else n - 1) + d - 1
    n -= _OFFSET_1904 if date1904 else 0
    return float(n) if 0 <= n <= LAST else fail("#NUM!")


def month_days(y: int, m: int) -> int:
    return 29 if (y, m) == (1900, 2) else calendar.monthrange(y, m)[1]


def add_months(s: float, months: int, end: bool, date1904: bool = False) -> float:
    y, m, d = ymd(s, date1904)
    y, m = y + (m - 1 + months) // 12, (m - 1 + months) % 12 + 1
    y += 1900 if 0 <= y < 1900 else 0
    if not 1900 <= y <= 9999:
        fail("#NUM!")
    last = month_days(y, m)
    return serial(y, m, last if end else min(d, last), date1904)


def weekday(s: float, date1904: bool = False) -> int:
    """0 for Sunday to 6 for Saturday, as day 1 was called a Sunday."""
    return (math.floor(s) + (_OFFSET_1904 if date1904 else 0) - 1) % 7


def iso_week(s: float, date1904: bool = False) -> int:
    n = math.floor(s) + (_OFFSET_1904 if date1904 else 0)
    thursday = n - (n - 2) % 7 + 3
    y = ymd(thursday)[0]
    return int(thursday - serial(y, 1, 1)) // 7 + 1


def from_ms(ms: float, date1904: bool = False) -> float:
    """Epoch milliseconds to a serial."""
    days = ms / 86_400_000 + 25_569
    days = days if days > 60 else days - 1
    return days - (_OFFSET_1904 if date1904 else 0)


def to_ms(s: float, date1904: bool = False) -> int | None:
    """A serial to epoch milliseconds, rounded; none before the epoch of the sheet."""
    s += _OFFSET_1904 if date1904 else 0
    if s < 0:
        return None
    return round(((s if s >= 61 else s + 1) - 25_569) * 86_400_000)
