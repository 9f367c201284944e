"""Raw events, newest first, and the catalogue of event types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.params import (
    EPOCH,
    MAX_PAGE_LIMIT,
    MICROSECOND,
    PAGE_LIMIT,
    Instant,
    TimeRange,
    clamp,
    parse_filters,
)
from footfall.plans.selection import SHALLOW, around_page, newest_with
from footfall.sources.events import scope

PAGE_COLUMNS = ["event_id", "event_type", "occurred_at", "received_at", "metadata"]
ORDER_COLUMNS = ["occurred_at", "received_at", "event_id"]


def events_page(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    event_type: str | None = None,
    filters: Iterable[str] | None = None,
    limit: int | None = None,
    offset: int | None = None,
    now: Instant | None = None,
    shallow: int = SHALLOW,
) -> DataFrame:
    """One page, with the offset of the next in ``next_offset`` (NULL on the last).

    One row more than the page is fetched to learn whether there is a next page. Where
    the page lies is found by counting first, see ``around_page``.
    """
    span = TimeRange.resolve(start, end, now)
    size = clamp(limit, PAGE_LIMIT, MAX_PAGE_LIMIT)
    first = max(0, offset or 0)
    hits = scope(events, organization_id, span, event_type, parse_filters(filters))
    near, skip = around_page(hits, span, first, size + 1, shallow)
    newest = [F.desc(name) for name in ORDER_COLUMNS]
    fetched = near.orderBy(*newest).offset(skip).limit(size + 1).select(PAGE_COLUMNS)
    # At most `size + 1` rows from here on.
    everything = Window.partitionBy(F.lit(0))
    has_more = F.count(F.lit(1)).over(everything) > size
    return (
        fetched.withColumn("_place", F.row_number().over(everything.orderBy(*newest)))
        .withColumn("next_offset", F.when(has_more, F.lit(first + size).cast("long")))
        .where(F.col("_place") <= size)
        .orderBy("_place")
        .drop("_place")
    )


def events_page_after(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    event_type: str | None = None,
    filters: Iterable[str] | None = None,
    limit: int | None = None,
    after: str | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """One page by position: the rows that follow the one ``after`` names, with the token of the
    page's last row in ``next_after`` (NULL on the last page).

    The position becomes a predicate that reaches the scan, so nothing is counted or skipped, and rows
    that arrive meanwhile move no page. Only the short time before the position that holds a
    page is ordered.
    """
    span = TimeRange.resolve(start, end, now)
    size = clamp(limit, PAGE_LIMIT, MAX_PAGE_LIMIT)
    at = _position(after)
    if at is not None:
        # Up to the position's microsecond, in which rows may be left.
        span = TimeRange(span.start, max(span.start + MICROSECOND, min(span.end, EPOCH + (at[0] + 1) * MICROSECOND)))
    hits = scope(events, organization_id, span, event_type, parse_filters(filters))
    if at is not None:
        micros, received, event_id = at
        occurred, arrived = F.unix_micros("occurred_at"), F.unix_micros("received_at")
        later = (arrived < received) | ((arrived == received) & (F.col("event_id") < event_id))
        hits = hits.where((occurred < micros) | ((occurred == micros) & later))
    near = newest_with(hits, span, size + 1)
    newest = [F.desc(name) for name in ORDER_COLUMNS]
    fetched = near.orderBy(*newest).limit(size + 1).select(PAGE_COLUMNS)
    # At most `size + 1` rows from here on.
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(*newest))
    token = F.concat_ws(":", F.unix_micros("occurred_at"), F.unix_micros("received_at"), "event_id")
    last = F.max(F.when(F.col("_place") == size, token)).over(everything)
    more = F.count(F.lit(1)).over(everything) > size
    return (
        fetched.withColumn("_place", place)
        .withColumn("next_after", F.when(more, last))
        .where(F.col("_place") <= size)
        .orderBy("_place")
        .drop("_place")
    )


def _position(after: str | None) -> tuple[int, int, str] | None:
    if after is None:
        return None
    micros, _, rest = after.partition(":")
    received, _, event_id = rest.partition(":")
    try:
        return int(micros), int(received), event_id
    except ValueError:
        raise ValueError(f"{after!r} is not the next_after of a page") from None


def event_types(events: DataFrame, organization_id: int) -> DataFrame:
    """``(event_type, count, last_seen_at)`` for everything the tenant ever sent."""
    return (
        scope(events, organization_id)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("count"), F.max("occurred_at").alias("last_seen_at"))
        .orderBy(F.col("count").desc(), F.col("event_type").asc())
    )
