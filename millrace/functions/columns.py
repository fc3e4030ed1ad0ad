"""Scalar expressions: guards, normalisation, classification, keys.

All of them are compositions of built-in functions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import schemas as S


def bounded(col: Column | str, lo: float, hi: float, default: float) -> Column:
    """``col`` where ``lo < col < hi``, else ``default`` (also for NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when((c > F.lit(lo)) & (c < F.lit(hi)), c).otherwise(F.lit(default))


def normalise(col: Column | str) -> Column:
    """Lower-case with surrounding spaces removed; tabs and newlines are kept."""
    return F.lower(F.trim(col))


def scrub(col: Column | str, junk: str = S.ORDER_ID_JUNK) -> Column:
    """Drop every character that matches ``junk``."""
    return F.regexp_replace(F.trim(col), junk, "")


def classify(col: Column | str) -> Column:
    """Name of the service that emits an event type."""
    c = F.col(col) if isinstance(col, str) else col
    service = F
    for name, kinds in S.SERVICE_EVENTS.items():
        service = service.when(c.isin(*kinds), name)
    return service.otherwise(S.UNKNOWN_SERVICE)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double, NULL where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def labels_key(labels: Column | str = "labels") -> Column:
    """Canonical text of a label map.

    Maps cannot be sorted, joined or used as window keys; this string can, and
    it does not depend on the order in which labels were inserted.
    """
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


_DAY_US = 86_400_000_000


def _utc_date(ts: Column | str) -> Column:
    # Counted from the epoch: the session's time zone has no part in it, so that rows
    # written under one zone are found under another.
    us = F.unix_micros(ts)
    day = ((us - F.pmod(us, F.lit(_DAY_US))) / _DAY_US).cast("int")
    return F.date_from_unix_date(day)


def month_of(ts: Column | str) -> Column:
    """Partition key ``yyyyMM`` of a timestamp, by the calendar of UTC."""
    return F.date_format(_utc_date(ts), "yyyyMM")


def day_of(ts: Column | str) -> Column:
    """Partition key ``yyyyMMdd`` of a timestamp, by the calendar of UTC."""
    return F.date_format(_utc_date(ts), "yyyyMMdd")
