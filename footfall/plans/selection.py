"""Finding the k-th of very many rows without gathering them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from footfall.functions.times import instant
from footfall.params import TimeRange

# Rows a page may skip by sorting; a task keeps no more than this and the page.
SHALLOW = 10_000
# Slices of time per counting pass, and so the rows the driver sees of each.
SLICES = 4096
DAY_MICROS = 86_400_000_000
# The first look back for a few rows.
FIRST_LOOK = DAY_MICROS // 24
# By how much more each further look back reaches, and characters of an id looked at a time.
FURTHER, PREFIX_STEP = 4, 2
# Bands per e-fold of duration: a band spans a ten-thousandth of its values.
BANDS = 10_000


def around_page(
    rows: DataFrame, span: TimeRange, skip: int, take: int, shallow: int = SHALLOW
) -> tuple[DataFrame, int]:
    """Only those rows, newest first, among which a page lies, and how many of them to
    skip still: ``shallow`` at most, unless rows are equal in the whole order.

    A page near the newest row lies in a short time that holds it, and is not counted for.
    For others:
    Sorting reads every column of every row and keeps all that is skipped in memory.
    Counting reads one column. Days are counted from the newest back until they hold the
    page, then slices of time within them, at most SLICES counts a pass, down to a single
    microsecond; if rows of that instant are still too many they are cut in turn by the time
    they were received, and then by their ids, from prefix to prefix.
    """
    if skip + take <= shallow:
        return newest_with(rows, span, skip + take), skip
    low = _far_enough(rows, span, skip + take)
    at = F.unix_micros("occurred_at")
    inside = since(rows, low, span)
    newest, skip, found = _newest_slice(inside, at, low, span.end_micros, skip, shallow)
    if not found:
        # The page lies behind the last row.
        return rows.where(F.lit(False)), 0
    first, width = newest
    page = F.col("occurred_at") <= instant(first)
    if width == 1 and skip > shallow:
        ties = inside.where(F.col("occurred_at") == instant(first))
        tie, skip = _within_an_instant(ties, skip, shallow)
        page = (F.col("occurred_at") < instant(first)) | (F.col("occurred_at") == instant(first)) & tie
    return inside.where(page), skip


def since(rows: DataFrame, low: int, span: TimeRange) -> DataFrame:
    """The rows from ``low`` microseconds to the end of the range."""
    inside = rows.where(F.col("occurred_at").between(instant(low), instant(span.end_micros - 1)))
    if "event_date" in rows.columns:
        inside = inside.where(F.col("event_date").between(F.to_date(instant(low)), F.to_date(instant(span.end_micros - 1))))
    return inside


def newest_with(rows: DataFrame, span: TimeRange, wanted: int) -> DataFrame:
    """The newest part of the range that holds so many rows, or all of it.

    A look stops at the last row that is wanted; the next one reaches further back.
    """
    step = FIRST_LOOK
    while (low := span.end_micros - step) > span.start_micros:
        part = since(rows, low, span)
        if part.limit(wanted).count() == wanted:
            return part
        step *= FURTHER
    return rows


def _far_enough(rows: DataFrame, span: TimeRange, wanted: int) -> int:
    """The start of the newest part of the range that holds so many rows, or of the range.

    Each count reads only what the ones before it have not.
    """
    high, step = span.end_micros, DAY_MICROS
    while high > span.start_micros and wanted > 0:
        low = max(span.start_micros, high - step)
        if low == span.start_micros:
            return low
        part = rows.where(F.col("occurred_at").between(instant(low), instant(high - 1)))
        if "event_date" in rows.columns:
            part = part.where(F.col("event_date").between(F.to_date(instant(low)), F.to_date(instant(high - 1))))
        wanted -= part.count()
        high, step = low, step * FURTHER
    return high


def _newest_slice(
    rows: DataFrame, key: Column, low: int, high: int, skip: int, shallow: int
) -> tuple[tuple[int, int], int, bool]:
    """The slice of ``key``, largest first, in which the row after ``skip`` others lies: its
    highest value and its width; what is to be skipped inside; whether there is such a row."""
    width = high - low
    while high > low:
        width = -(-(high - low) // SLICES)
        age = F.floor((F.lit(high - 1) - key) / F.lit(width)) if width > 1 else F.lit(high - 1) - key
        counts = rows.where(key.between(low, high - 1)).groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("rows"))
        counts = sorted((int(age), held) for age, held in counts.collect())
        up_to = list(accumulate(held for _, held in counts))
        starts = next((n for n, newer in enumerate(up_to) if newer > skip), None)
        if starts is None:
            return (low, width), 0, False
        skip -= up_to[starts] - counts[starts][1]
        high -= counts[starts][0] * width
        low = max(low, high - width)
        if skip <= shallow or width == 1:
            return (high - 1, width), skip, True
    return (low, width), 0, False


def _within_an_instant(ties: DataFrame, skip: int, shallow: int) -> tuple[Column, int]:
    """Which of the rows of one instant do not come before the page, and what to skip."""
    received = F.unix_micros("received_at")
    low, high = ties.agg(F.min(received), F.max(received)).first()
    (last, width), skip, _ = _newest_slice(ties, received, low, high + 1, skip, shallow)
    here = received <= last
    if width > 1 or skip <= shallow:
        return here, skip
    ties = ties.where(received == last)
    prefix, more = "", True
    while skip > shallow and more:
        length = len(prefix) + PREFIX_STEP
        cut = F.substring("event_id", 1, length)
        counts = ties.where(F.col("event_id").startswith(prefix)).groupBy(cut.alias("cut")).agg(F.count(F.lit(1)).alias("rows"))
        for name, held in sorted(map(tuple, counts.collect()), reverse=True):
            if held > skip:
                more, prefix = len(name) == length, name
                break
            skip -= held
    # Ids that begin with the prefix, and those below it.
    return (received < last) | (received == last) & (
        F.col("event_id").startswith(prefix) | (F.col("event_id") < prefix)), skip


def middle_values(tally: DataFrame, group: str) -> DataFrame:
    """``(group, total, value)``: the one or two middle values of every group.

    ``tally`` has columns ``group, value, rows``, one row per distinct positive value;
    ``total`` is the number of rows it stands for. A first count over bands of nearly
    equal values, of which there are some hundred thousand at most, tells in which
    band the middle lies. Only the values of that band are then put in order, so no
    task sees the whole distribution.
    """
    # Not nullable, so that both uses of the tally plan the same and share its shuffle.
    band = F.coalesce(F.floor(F.ln("value") * BANDS), F.lit(0).cast("long"))
    banded = tally.withColumn("band", band)
    by_group = Window.partitionBy(group)
    counted = (
        banded.groupBy(group, "band")
        .agg(F.sum("rows").alias("rows"))
        .withColumns(
            {
                "total": F.sum("rows").over(by_group),
                "below": _running(by_group.orderBy("band")),
            }
        )
    )
    middle = counted.where(_holds_middle()).select(group, "band", "below", "total")
    # Two bands per group at most.
    inside = banded.join(F.broadcast(middle), [group, "band"])
    below = F.col("below") + _running(Window.partitionBy(group, "band").orderBy("value"))
    return (
        inside.withColumn("below", below).where(_holds_middle()).select(group, "total", "value")
    )


def _running(window: WindowSpec) -> Column:
    """Rows counted before this one."""
    so_far = F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return so_far - F.col("rows")


def _holds_middle() -> Column:
    """Whether rank (total - 1) div 2 or total div 2, from 0, falls on this row."""
    return F.expr(
        "(total - 1) div 2 between below and below + rows - 1"
        " or total div 2 between below and below + rows - 1"
    )
