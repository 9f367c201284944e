"""Largest groups by event type or by a metadata key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.metadata import text_at
from footfall.params import (
    BREAKDOWN_LIMIT,
    MAX_BREAKDOWN_LIMIT,
    Instant,
    TimeRange,
    clamp,
    parse_dimension,
    parse_filters,
)
from footfall.sources.events import scope


def breakdown(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    group_by: str | None = None,
    event_type: str | None = None,
    filters: Iterable[str] | None = None,
    limit: int | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """``(value, count)``, most frequent first, then by value with NULL last.

    Events without the key are a group of their own, with value NULL.
    """
    span = TimeRange.resolve(start, end, now)
    key = parse_dimension(group_by)
    most = clamp(limit, BREAKDOWN_LIMIT, MAX_BREAKDOWN_LIMIT)
    hits = scope(events, organization_id, span, event_type, parse_filters(filters))
    value = F.col("event_type") if key is None else text_at(F.col("metadata"), key)
    return (
        hits.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
        .limit(most)
    )
