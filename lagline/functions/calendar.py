"""Calendar features of an order, computed on wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Wall-clock microseconds from ``start`` to ``end``.

    Both sides become TIMESTAMP_NTZ and are subtracted as such. ``timestampdiff``
    would go through the session zone and lose or gain an hour at a
    daylight-saving change. An 18-digit decimal is a long underneath; the double
    it becomes holds every microsecond count below 2^53, some 285 years.
    """
    gap = _column(end).cast("timestamp_ntz") - _column(start).cast("timestamp_ntz")
    seconds = gap.cast("interval second").cast("decimal(18,6)").cast("double")
    return F.rint(seconds * F.lit(1e6)).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def monday_first_weekday(moment: Column | str) -> Column:
    """0 for Monday up to 6 for Sunday."""
    return F.weekday(_column(moment))
