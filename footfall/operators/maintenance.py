"""Looking over stored data and taking parts of it out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.identity import linked


def audit(events: DataFrame) -> DataFrame:
    """``(organization_id, event_type, count)``, largest first: look before deleting."""
    return (
        events.groupBy("organization_id", "event_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "organization_id", "event_type")
    )


def of_types(event_types: Sequence[str]) -> Column:
    return F.col("event_type").isin(list(event_types))


def of_tenant(organization_id: int) -> Column:
    return F.col("organization_id") == F.lit(organization_id).cast("long")


def of_user(organization_id: int, user_id: str) -> Column:
    """Rows that name the user. Anonymous rows of the same person are not among them."""
    return of_tenant(organization_id) & F.col("user_id").eqNullSafe(F.lit(user_id))


def without(events: DataFrame, doomed: Column) -> DataFrame:
    """What a deletion leaves; rows for which the condition is unknown stay."""
    return events.where(~F.coalesce(doomed, F.lit(False)))


def purge_event_types(events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    return without(events, of_types(event_types))


def erase_person(events: DataFrame, organization_id: int, user_id: str) -> DataFrame:
    return without(events, of_user(organization_id, user_id))


def erase_person_resolved(events: DataFrame, organization_id: int, user_id: str) -> DataFrame:
    """Also without the rows of the person's anonymous ids that name no user.

    Those are the ids whose earliest link, over everything the tenant ever sent, is to this
    user; as in every question, an id that led to somebody else first is not theirs.
    """
    theirs = (
        linked(events.where(of_tenant(organization_id)))
        .where(F.col("user_id") == user_id)
        .select(F.lit(organization_id).cast("long").alias("_tenant"), F.col("anonymous_id").alias("_anonymous_id"))
    )
    left = erase_person(events, organization_id, user_id)
    # Only rows of the tenant with an anonymous id and no user can be the person's; the others,
    # which share no key worth shuffling by, stay out of the join.
    nameless = of_tenant(organization_id) & F.col("anonymous_id").isNotNull() & F.col("user_id").isNull()
    same = (F.col("organization_id") == F.col("_tenant")) & (F.col("anonymous_id") == F.col("_anonymous_id"))
    return without(left, nameless).unionByName(left.where(nameless).join(theirs, same, "left_anti"))


def remove_tenant(
    organizations: DataFrame, events: DataFrame, organization_id: int
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tenant: its events go with it."""
    return (
        organizations.where(F.col("id") != organization_id),
        without(events, of_tenant(organization_id)),
    )
