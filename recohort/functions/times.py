"""Half-open windows and UTC instants as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, functions as F


def instant(value: datetime) -> Column:
    """A zone-free UTC literal; folds into pushed-down scan filters."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def within(ts: Column, low: datetime, high: datetime) -> Column:
    """``low <= ts < high``."""
    return (ts >= instant(low)) & (ts < instant(high))


def utc_instant(text: Column) -> Column:
    """ISO text with a zone to a zone-free UTC timestamp; null when the zone or value is missing."""
    zoned = text.rlike("[Tt ].*([Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.try_to_timestamp(text)).cast("timestamp_ntz")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    """UTC text with a Z; a fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
                    F.lit("Z"))


def post_anchor(end: Column) -> Column:
    """First full UTC midnight at or after an instant."""
    day = F.date_trunc("day", end).cast("timestamp_ntz")
    return F.when(day == end, day).otherwise(day + F.expr("INTERVAL '1' DAY"))


def entry_week(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def fractional_days(later: Column, earlier: Column) -> Column:
    """Days between two instants, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(86_400_000_000.0)


WORD_DAYS = 64


def distinct_days(inside: Column, day: Column, low: datetime, high: datetime) -> Column:
    """Aggregate: how many distinct UTC dates of ``[low, high)`` have a row that is inside.

    One bit per date, in as many 64-bit words as the window needs; each word merges map-side by a
    bitwise OR, so the count is exact without the second shuffle of a distinct count. A row touches
    one word. ``inside`` must already be false outside the window.
    """
    offset = F.datediff(day, F.lit(low.date()))
    words = []
    for first in range(0, days_long(low, high), WORD_DAYS):
        here = inside & (offset >= first) & (offset < first + WORD_DAYS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (offset - first).cast("int"))
        words.append(F.bit_count(F.coalesce(F.bit_or(F.when(here, bit)), F.lit(0).cast("long"))))
    return reduce(lambda a, b: a + b, words, F.lit(0).cast("int")).cast("long")


def days_long(low: datetime, high: datetime) -> int:
    """Number of calendar days touched by ``[low, high)``; none if it is empty."""
    return max(0, ((high - timedelta(microseconds=1)).date() - low.date()).days + 1)
