"""Opening hours and duration labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
SUNDAY, SATURDAY = 1, 7


def _local(at_utc: Column) -> tuple[Column, Column]:
    local = F.from_utc_timestamp(at_utc, ZONE)
    return F.dayofweek(local), F.hour(local) * 60 + F.minute(local)


def _open(at_utc: Column, sunday: bool, weekday_close: int) -> Column:
    day, minute = _local(at_utc)
    return (F.when(day == SUNDAY, F.lit(sunday))
            .when(day == SATURDAY, minute.between(9 * 60, 13 * 60))
            .otherwise((minute >= 9 * 60) & (minute < weekday_close * 60)))


def pharmacy_open(at_utc: Column) -> Column:
    """Closed on Sunday; Saturday 09:00 to 13:00, the last minute included; weekdays to 19:00."""
    return _open(at_utc, False, 19)


def hospital_open(at_utc: Column) -> Column:
    """Open on Sunday (emergency rooms); Saturday as pharmacies; weekdays to 18:00."""
    return _open(at_utc, True, 18)


def duration_label(millis: Column) -> Column:
    """``850ms``, ``12초``, ``3분``; null and zero give ``-``."""
    def rounded(divisor):
        return F.floor(millis / divisor + 0.5).cast("string")
    return (F.when(millis.isNull() | (millis == 0), "-")
            .when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms")))
            .when(millis < 60000, F.concat(rounded(1000), F.lit("초")))
            .otherwise(F.concat(rounded(60000), F.lit("분"))))
