"""The event table: Parquet, partitioned by UTC date, sorted by tenant and time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.metadata import contains
from footfall.functions.text import is_blank
from footfall.functions.times import instant
from footfall.params import MICROSECOND, TimeRange
from footfall.schema import STORED_EVENTS
from footfall.session import check_session

# A reader prunes row groups by tenant and time, so a file should hold long runs of
# one tenant; a file that outgrows this is cut.
ROWS_PER_FILE = 20_000_000
ORDER = ["event_date", "organization_id", "occurred_at"]


def scope(
    events: DataFrame,
    organization_id: int,
    span: TimeRange | None = None,
    event_type: str | None = None,
    filters: dict[str, str] | None = None,
) -> DataFrame:
    """Rows of one tenant, narrowed as asked. The tenant is never optional."""
    check_session(events.sparkSession)
    inside = F.col("organization_id") == F.lit(organization_id).cast("long")
    if span is not None:
        inside &= F.col("occurred_at") >= instant(span.start)
        inside &= F.col("occurred_at") < instant(span.end)
        if "event_date" in events.columns:
            inside &= dates_of(span)
    if not is_blank(event_type) or filters:
        inside &= wanted(event_type, filters)
    return events.where(inside)


def wanted(event_type: str | None, filters: dict[str, str] | None) -> Column:
    """What a question narrows a tenant's rows by; true where it does not."""
    found = F.lit(True) if is_blank(event_type) else F.col("event_type") == event_type
    return found & contains(F.col("metadata"), filters) if filters else found


def dates_of(span: TimeRange) -> Column:
    """The same range in terms of the partition column, to skip whole folders."""
    first, last = span.start.date(), (span.end - MICROSECOND).date()
    return F.col("event_date").between(F.lit(first), F.lit(last))


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("occurred_at"))


def append_events(events: DataFrame, path: str, ingest_batch: str | None = None) -> None:
    """Add rows to the table.

    The rebalance gathers the rows of a date, and adaptive execution cuts a date that
    is much larger than the rest into several writers, so that a busy day does not
    wait for one task.
    """
    rows = with_event_date(events)
    if ingest_batch is not None:
        rows = rows.withColumn("ingest_batch", F.lit(ingest_batch))
    elif "ingest_batch" not in rows.columns:
        rows = rows.withColumn("ingest_batch", F.lit(None).cast("string"))
    _write(rows.select(STORED_EVENTS.names).hint("rebalance", "event_date"), path, "append")


def write_dates(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of all that the table has of their dates.

    Rows are dealt out by date, tenant and time, so that files hold few tenants each, at the
    price of a pass that looks where to cut.
    """
    _write(rows.select(STORED_EVENTS.names).repartitionByRange(*ORDER), path, "overwrite")


def _write(dealt: DataFrame, path: str, mode: str) -> None:
    (
        dealt.sortWithinPartitions(*ORDER)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("event_date")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; one that was never written to is empty."""
    check_session(spark)
    try:
        return spark.read.schema(STORED_EVENTS).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_EVENTS)
