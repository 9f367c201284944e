"""What an answer is about: the range that was asked for, resolved, and the total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import is_blank
from footfall.functions.times import instant
from footfall.operators.timeseries import total
from footfall.params import Instant, TimeRange, parse_dimension, parse_interval


def series_header(
    series: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
    interval: str | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """One row about a time series: ``range_start, range_end, interval, total``."""
    return _ranged(total(series), start, end, now).select(
        "range_start", "range_end", F.lit(parse_interval(interval)).alias("interval"), "total"
    )


def breakdown_header(
    entries: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
    group_by: str | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """One row about a breakdown: ``range_start, range_end, group_by, total``.

    ``group_by`` is what was asked for, as it was written, or ``eventType``.
    """
    parse_dimension(group_by)
    label = "eventType" if is_blank(group_by) else group_by
    return _ranged(total(entries), start, end, now).select(
        "range_start", "range_end", F.lit(label).alias("group_by"), "total"
    )


def funnel_header(
    totals: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
    now: Instant | None = None,
) -> DataFrame:
    """The row of ``funnel_totals`` with ``range_start`` and ``range_end`` in front."""
    return _ranged(totals, start, end, now).select("range_start", "range_end", *totals.columns)


def _ranged(row: DataFrame, start, end, now) -> DataFrame:
    span = TimeRange.resolve(start, end, now)
    return row.withColumns({"range_start": instant(span.start), "range_end": instant(span.end)})
