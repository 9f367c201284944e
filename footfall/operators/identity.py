"""Which person an event belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.params import Instant, TimeRange
from footfall.plans.skew import spread_left_join
from footfall.sources.events import scope


def identities(
    events: DataFrame,
    organization_id: int,
    start: Instant | None = None,
    end: Instant | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """``(anonymous_id, user_id)``: whose anonymous id it turned out to be.

    Learnt from the events that carry both ids; the earliest of them decides, and of
    several at the same instant the one with the lowest user id. Only the tenant and
    the time range narrow it, never an event type or a metadata filter.
    """
    return linked(scope(events, organization_id, TimeRange.resolve(start, end, now)))


def both_ids() -> Column:
    return F.col("anonymous_id").isNotNull() & F.col("user_id").isNotNull()


def linked(scoped: DataFrame) -> DataFrame:
    # Reducing to pairs first takes a hash aggregation; choosing among the few pairs of
    # an anonymous id compares texts, for which Spark has to sort.
    pairs = scoped.where(both_ids()).groupBy("anonymous_id", "user_id")
    first = F.min(F.struct("since", "user_id"))
    return (
        pairs.agg(F.min("occurred_at").alias("since"))
        .groupBy("anonymous_id")
        .agg(first.alias("first"))
        .select("anonymous_id", F.col("first.user_id").alias("user_id"))
    )


def unnamed() -> Column:
    """The anonymous id of a row that does not name its user."""
    return F.when(F.col("user_id").isNull(), F.col("anonymous_id"))


def with_actor(
    rows: DataFrame, links: DataFrame, spread_by: list[str], heavy: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``actor``: its user, else the user its anonymous id led to, else
    the anonymous id itself, else NULL.

    A row that names its user needs no lookup and takes part without a key. ``heavy``
    are anonymous ids with very many such rows, see ``plans.skew.survey``.
    """
    found = spread_left_join(
        rows.withColumn("_unnamed", unnamed()),
        links.toDF("_unnamed", "_linked_user"),
        "_unnamed",
        spread_by,
        heavy,
    )
    actor = F.coalesce("user_id", "_linked_user", "anonymous_id")
    return found.select(*rows.columns, actor.alias("actor"))
