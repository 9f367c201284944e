"""What events add up to by day, as deltas of batches that merge when they are read.

A batch adds one row for each key and day it touches, under its own name. Counts of several
batches add up; a batch that ran again says the same or more of itself, so the larger counts.
Last times are maxima and links minima, which merge however often they are given. Late rows
are deltas of an old day like any others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import bucket, instant
from footfall.operators.identity import both_ids
from footfall.operators.timeseries import with_gaps
from footfall.params import Instant, TimeRange, parse_interval
from footfall.schema import DAILY, LINKS
from footfall.session import check_session
from footfall.sources.events import scope, with_event_date

KEY = ["organization_id", "event_type", "event_date"]


def _dated(events: DataFrame) -> DataFrame:
    """With the date as a column; a stored table has it, and prunes folders by it."""
    return events if "event_date" in events.columns else with_event_date(events)


def daily_counts(events: DataFrame) -> DataFrame:
    """``count`` and ``last_at`` of every tenant, type and day, by ``ingest_batch``."""
    check_session(events.sparkSession)
    return _dated(events).groupBy(*KEY, "ingest_batch").agg(
        F.count(F.lit(1)).alias("count"), F.max("occurred_at").alias("last_at")).select(DAILY.names)


def daily_links(events: DataFrame) -> DataFrame:
    """The earliest ``(since, user_id)`` of every tenant, day and anonymous id."""
    check_session(events.sparkSession)
    # Rows without both ids matter only where they stand in for a date.
    stands_in = F.col("event_id") == ""
    rows = _dated(events).where(both_ids() | stands_in)
    pairs = rows.groupBy("organization_id", "event_date", "anonymous_id", "user_id").agg(F.min("occurred_at").alias("since"))
    return pairs.groupBy("organization_id", "event_date", "anonymous_id").agg(F.min(F.struct("since", "user_id")).alias("first")).select(
        "organization_id", "anonymous_id", "first.since", "first.user_id", "event_date").select(LINKS.names)


def merged(daily: DataFrame, *by: str | Column) -> DataFrame:
    """``count`` and ``last_at`` over all batches and days."""
    once = daily.groupBy(*KEY, "ingest_batch").agg(F.max("count").alias("count"), F.max("last_at").alias("last_at"))
    return once.groupBy(*by).agg(F.sum("count").alias("count"), F.max("last_at").alias("last_at"))


def event_types_of_days(daily: DataFrame, organization_id: int) -> DataFrame:
    """:func:`footfall.operators.events.event_types` from the days, without an event row."""
    own = daily.where(F.col("organization_id") == F.lit(organization_id).cast("long"))
    return (
        merged(own, "event_type")
        .withColumnRenamed("last_at", "last_seen_at")
        .orderBy(F.col("count").desc(), F.col("event_type").asc())
    )


def audit_of_days(daily: DataFrame) -> DataFrame:
    """:func:`footfall.operators.maintenance.audit` from the days, without an event row."""
    return (
        merged(daily, "organization_id", "event_type")
        .drop("last_at")
        .orderBy(F.col("count").desc(), "organization_id", "event_type")
    )


def _whole_days(span: TimeRange) -> tuple[Column, Column]:
    """Whether a day lies in the range as a whole, and whether a time lies in it but in no such
    day."""
    start, end = instant(span.start), instant(span.end)
    first = F.when(start == F.date_trunc("day", start), F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
    day = F.col("event_date")
    whole = (day >= first) & (day < F.to_date(end))
    return whole, ~whole


def time_series_of_days(
    daily: DataFrame,
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    interval: str = "day",
    event_type: str | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """:func:`footfall.operators.timeseries.time_series` by day or longer, without filters.

    Whole days come from ``daily``; ``events`` are read for the days at both ends, where the
    range cuts them.
    """
    unit = parse_interval(interval)
    if unit == "hour":
        raise ValueError("interval must be day, week or month: days are the smallest part that is kept")
    span = TimeRange.resolve(start, end, now)
    whole, cut = _whole_days(span)
    own = daily.where((F.col("organization_id") == F.lit(organization_id).cast("long")) & whole)
    if event_type:
        own = own.where(F.col("event_type") == event_type)
    starts = bucket(unit, F.col("event_date").cast("timestamp")).alias("bucket")
    of_days = merged(own, starts).select("bucket", F.col("count").alias("hit"))
    edges = _dated(scope(events, organization_id, span, event_type)).where(cut)
    of_edges = edges.select(bucket(unit, F.col("occurred_at")).alias("bucket"), F.lit(1).cast("long").alias("hit"))
    return with_gaps(of_days.unionByName(of_edges), span, unit)


def identities_of_days(
    links: DataFrame,
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """:func:`footfall.operators.identity.identities`: whole days from ``links``, the cut days at
    both ends from the rows themselves."""
    span = TimeRange.resolve(start, end, now)
    whole, cut = _whole_days(span)
    own = links.where((F.col("organization_id") == F.lit(organization_id).cast("long")) & whole)
    edges = _dated(scope(events, organization_id, span)).where(cut)
    parts = [own.select("anonymous_id", "since", "user_id"), daily_links(edges).select("anonymous_id", "since", "user_id")]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("anonymous_id")
        .agg(F.min(F.struct("since", "user_id")).alias("first"))
        .select("anonymous_id", F.col("first.user_id").alias("user_id"))
    )
