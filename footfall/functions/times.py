"""Instants and UTC buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.params import MICROSECOND, TimeRange, as_micros

STRIDES = {
    "hour": timedelta(hours=1),
    "day": timedelta(days=1),
    "week": timedelta(weeks=1),
}
BUCKETS_PER_TASK = 100_000


def instant(value: datetime | int) -> Column:
    """A datetime or microseconds as a literal that Catalyst folds, so that
    comparisons with it reach the scan."""
    micros = value if isinstance(value, int) else as_micros(value)
    return F.timestamp_micros(F.lit(micros).cast("long"))


def bucket(unit: str, at: Column) -> Column:
    """Start of the UTC hour, day, Monday week or month; needs a UTC session."""
    return F.date_trunc(unit, at)


def floor_to(unit: str, at: datetime) -> datetime:
    at = at.replace(minute=0, second=0, microsecond=0)
    if unit == "hour":
        return at
    at = at.replace(hour=0)
    if unit == "week":
        return at - timedelta(days=at.weekday())
    return at.replace(day=1) if unit == "month" else at


def buckets(spark: SparkSession, unit: str, span: TimeRange) -> DataFrame:
    """Every bucket that can hold an event of ``span``, generated on the executors.

    The last one is the bucket of the last instant *inside* the half-open range, so
    a range ending on a boundary has no empty bucket behind it.
    """
    first, last = floor_to(unit, span.start), floor_to(unit, span.end - MICROSECOND)
    if unit == "month":
        steps = (last.year - first.year) * 12 + last.month - first.month
        start = instant(first) + F.make_ym_interval(F.lit(0), F.col("id").cast("int"))
    else:
        steps = (last - first) // STRIDES[unit]
        stride = STRIDES[unit] // MICROSECOND
        start = F.timestamp_micros(F.lit(as_micros(first)) + F.col("id") * F.lit(stride))
    tasks = 1 + steps // BUCKETS_PER_TASK
    return spark.range(0, steps + 1, 1, tasks).select(start.alias("bucket"))
