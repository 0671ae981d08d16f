"""Timestamps: mandatory offsets on the way in, millisecond UTC text on the way out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_SUFFIX = r"[Tt ].*([Zz]|[+-][0-9]{2}:?[0-9]{2})$"


def offset_timestamp(col: Column) -> Column:
    """Instant of an ISO text; null for text without an offset, which Spark alone would accept."""
    return F.when(col.rlike(OFFSET_SUFFIX), F.try_to_timestamp(col))


def utc_millis_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def overlaps(first: Column, last: Column, date_from=None, date_to=None) -> Column:
    """Interval overlap where a null bound is open, and an absent window end constrains nothing."""
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (last.isNull() | (last >= F.lit(date_from)))
    if date_to is not None:
        cond = cond & (first.isNull() | (first <= F.lit(date_to)))
    return cond


def within(col: Column, date_from=None, date_to=None) -> Column:
    """Inclusive range with optional ends."""
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (col >= F.lit(date_from))
    if date_to is not None:
        cond = cond & (col <= F.lit(date_to))
    return cond


def retry_delay_seconds(attempts: Column, base_seconds: int, ceiling: int = 3600) -> Column:
    """Doubling back-off after ``attempts`` tries."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30))
    return F.least(
        F.lit(base_seconds).cast("bigint") * F.pow(F.lit(2), doublings).cast("bigint"),
        F.lit(ceiling).cast("bigint"),
    )
