"""Totals and unique people."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.params import Instant, TimeRange, parse_filters
from footfall.sources.events import scope, wanted

def summary(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    event_type: str | None = None,
    filters: Iterable[str] | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """One row: ``total_events, unique_actors, distinct_event_types, first_event_at,
    last_event_at``.

    The table is read once: rows become one per user, anonymous id and event type, combined
    before they are sent, with the numbers of the rows that match and the first time of all.
    Each of those counts towards its anonymous id, its user and its type, and everything after
    that is sums per key, in partial sums first: an anonymous id learns its earliest user and
    whether it has matching rows without one, which makes that user, or else itself, a person.
    So no key is gathered, however many rows one id has.
    """
    span = TimeRange.resolve(start, end, now)
    hit = wanted(event_type, parse_filters(filters))
    ids = scope(events, organization_id, span).groupBy("user_id", "anonymous_id", "event_type").agg(
        F.count_if(hit).alias("events"),
        F.min(F.when(hit, F.col("occurred_at"))).alias("first_at"),
        F.max(F.when(hit, F.col("occurred_at"))).alias("last_at"),
        F.min("occurred_at").alias("since"),
    )
    named = F.col("user_id").isNotNull()
    # What a row says of its type, its user and its anonymous id.
    of_type = F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("key"), F.col("events").alias("hits"))
    of_user = F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("key"), F.col("events").alias("hits"))
    of_visitor = F.struct(
        F.lit("visitor").alias("kind"), F.col("anonymous_id").alias("key"),
        F.when(named, F.lit(0).cast("long")).otherwise(F.col("events")).alias("hits"))
    said = ids.withColumn("facet", F.explode(F.array(of_type, of_user, of_visitor))).where("facet.key is not null")
    visitor = F.col("facet.kind") == "visitor"
    keys = said.groupBy("facet.kind", "facet.key").agg(
        F.sum("facet.hits").alias("hits"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.min(F.when(visitor & named, F.struct("since", "user_id"))).alias("owner"),
    )
    is_type = F.col("kind") == "type"
    people = (
        keys.where("hits > 0")
        .select(
            is_type.alias("is_type"),
            F.coalesce("owner.user_id", "key").alias("key"),
            "hits", "first_at", "last_at",
        )
        .groupBy("is_type", "key")
        .agg(F.sum("hits").alias("hits"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    )
    of_types = lambda column: F.when(F.col("is_type"), F.col(column))
    return people.agg(
        F.coalesce(F.sum(of_types("hits")), F.lit(0).cast("long")).alias("total_events"),
        F.count_if(~F.col("is_type")).alias("unique_actors"),
        F.count_if(F.col("is_type")).alias("distinct_event_types"),
        F.min(of_types("first_at")).alias("first_event_at"),
        F.max(of_types("last_at")).alias("last_event_at"),
    )
