"""Counts per UTC bucket, empty buckets included."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import bucket, buckets
from footfall.params import Instant, TimeRange, parse_filters, parse_interval
from footfall.sources.events import scope


def time_series(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    interval: str | None = None,
    event_type: str | None = None,
    filters: Iterable[str] | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """``(bucket, count)`` in time order.

    The gaps are filled by counting a zero for every bucket of the range along with a
    one for every event: one aggregation, combined before its shuffle, and no join.
    """
    span = TimeRange.resolve(start, end, now)
    unit = parse_interval(interval)
    hits = scope(events, organization_id, span, event_type, parse_filters(filters))
    ones = hits.select(
        bucket(unit, F.col("occurred_at")).alias("bucket"), F.lit(1).cast("long").alias("hit")
    )
    return with_gaps(ones, span, unit)


def with_gaps(hits: DataFrame, span: TimeRange, unit: str) -> DataFrame:
    """The sum of ``hit`` for every bucket of the range, also for those without any."""
    zeros = buckets(hits.sparkSession, unit, span).select(
        "bucket", F.lit(0).cast("long").alias("hit")
    )
    return (
        hits.unionByName(zeros)
        .groupBy("bucket")
        .agg(F.sum("hit").alias("count"))
        .orderBy("bucket")
    )


def total(entries: DataFrame) -> DataFrame:
    """Sum of the counts of a time series or breakdown, over the entries it returned."""
    return entries.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("total"))
