"""Events of known selectivity for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 85, 10 and 5 of a hundred events; eight countries; forty builds.
PLAN_SHARES = [("free", 85), ("pro", 10), ("enterprise", 5)]
COUNTRIES = ["SE", "NO", "DK", "FI", "DE", "NL", "GB", "US"]
BUILDS = 40


def load_metadata(index: Column) -> Column:
    """Metadata of load-test event number ``index``, as canonical JSON."""
    place, below, plan = index % sum(share for _, share in PLAN_SHARES), 0, None
    for name, share in PLAN_SHARES:
        below += share
        case = place < below
        plan = F.when(case, name) if plan is None else plan.when(case, name)
    country = F.element_at(
        F.array(*map(F.lit, COUNTRIES)), (index % len(COUNTRIES) + 1).cast("int")
    )
    build = F.concat(F.lit("v"), (index % BUILDS).cast("string"))
    return F.to_json(F.struct(build.alias("build"), country.alias("country"), plan.alias("plan")))


def load_events(indexed: DataFrame, index: str, event_type: str = "load_test") -> DataFrame:
    """``(index, event_type, metadata)`` for every number in column ``index``."""
    number = F.col(index).cast("long")
    return indexed.select(
        number.alias("index"),
        F.lit(event_type).alias("event_type"),
        load_metadata(number).alias("metadata"),
    )
