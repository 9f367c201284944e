"""Ordered conversion over people."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.identity import linked, unnamed, with_actor
from footfall.params import FunnelSpec, Instant, TimeRange, parse_filters
from footfall.plans.selection import middle_values
from footfall.plans.skew import BROADCAST_ROWS, survey
from footfall.sources.events import scope

# Slices the time range is cut into when a person's events are thinned out; and each of
# those, before.
SLICES = 4096
# With no more events than this taking part, one person may as well have all of them.
SMALL_ROWS = 1_000_000


def funnel(
    events: DataFrame,
    organization_id: int,
    steps: Sequence[str],
    window: str | None = None,
    start: Instant | None = None,
    end: Instant | None = None,
    filters: Iterable[str] | None = None,
    now: Instant | None = None,
    small_rows: int | None = None,
    heavy_rows: int | None = None,
) -> DataFrame:
    """One row per step: ``step, event_type, actors, conversion_from_previous,
    conversion_from_first, median_seconds_from_previous``.

    A person enters with the first event of step one. Each later step is the earliest
    event of its type strictly after the step before it, and counts if it happened no
    later than ``window`` after entry. A job counts the events taking part; of more than
    ``small_rows`` (SMALL_ROWS by default) a second one counts each person's, those with more
    than that are thinned out, and medians are found in bands. An anonymous id with
    ``heavy_rows`` or more is split for the identity join.
    """
    spec = FunnelSpec.parse(steps, window)
    span = TimeRange.resolve(start, end, now)
    identified = F.coalesce("user_id", "anonymous_id").isNotNull()
    taking_part = (
        scope(events, organization_id, span, None, parse_filters(filters))
        .where(F.col("event_type").isin(*sorted(set(spec.steps))) & identified)
        .select("event_type", "occurred_at", "user_id", "anonymous_id", "event_id")
    )
    count, heavy = survey(taking_part, unnamed(), heavy_rows)
    rows = with_actor(
        taking_part,
        linked(scope(events, organization_id, span)),
        spread_by=["occurred_at", "event_type", "user_id", "event_id"],
        heavy=heavy,
    ).select("actor", "event_type", F.unix_micros("occurred_at").alias("at"))
    most = SMALL_ROWS if small_rows is None else small_rows
    if count <= most:
        return report(measured(walks(rows, spec), spec), spec)
    return report(measured_apart(walks(eased(rows, spec, span, count, most), spec), spec), spec)


def eased(rows: DataFrame, spec: FunnelSpec, span: TimeRange, count: int, most: int) -> DataFrame:
    """``rows``, ``count`` in number, with those of a person who has more than ``most`` thinned out.

    Others may as well be gathered as they are. Such persons are few, ``count / most`` at best, and
    their list is broadcast; were it too long, everybody's rows are thinned out.
    """
    def thin(part: DataFrame) -> DataFrame:
        for slices in (SLICES * SLICES, SLICES):
            part = thinned(part, spec, span, slices)
        return part

    if count > most * BROADCAST_ROWS:
        return thin(rows)
    _, crowded = survey(rows, F.col("actor"), most + 1)
    if crowded is None:
        return rows
    named = F.broadcast(crowded.select(F.col("heavy_key").alias("actor")))
    return rows.join(named, "actor", "left_anti").unionByName(thin(rows.join(named, "actor", "left_semi")))


def thinned(
    rows: DataFrame, spec: FunnelSpec, span: TimeRange, slices: int = SLICES
) -> DataFrame:
    """The rows that can be a step of somebody's walk, at most 36 per person and slice.

    However a walk stands when a slice of time begins, it goes on with the earliest
    event of the step it waits for, then with the earliest of the next step after
    that. There is one such run for each step it may be waiting for, and events
    outside all of those runs are never chosen. A person with a great share of all
    events is thereby spread over the slices, and only a bounded number of rows is
    gathered per person afterwards. Thinning is exact for slices of any width, so very
    narrow ones come first: a burst of one person is not gathered either. Slices that
    hold no more rows than there are runs stay as they are; a count tells them, and both
    kinds read the same shuffle.
    """
    width = -(-(span.end_micros - span.start_micros) // slices)
    held = F.expr("count(1) over (partition by actor, slice)")
    counted = rows.select("actor", "event_type", "at").withColumn(
        "slice", F.expr(f"(at - {span.start_micros}) div {width}")
    ).withColumn("held", held)
    bound = len(spec.steps) * (len(spec.steps) + 1) // 2
    few = counted.where(F.col("held") <= bound).select("actor", "event_type", "at")
    sliced = _with_step_times(counted.where(F.col("held") > bound), spec)
    runs = []
    for step in range(len(spec.steps)):
        entering = {(step, step): f"min(at_{step})"}
        going_on = {
            (entry, step): f"min(if(at_{step} > run_{entry}_{step - 1}, at_{step}, null))"
            for entry in range(step)
        }
        together = "over (partition by actor, slice)"
        runs += [*entering, *going_on]
        sliced = sliced.withColumns(
            {
                f"run_{entry}_{step}": F.expr(f"{earliest} {together}")
                for (entry, _), earliest in (entering | going_on).items()
            }
        )
    picks = F.array(
        *(
            F.struct(F.lit(spec.steps[step]).alias("event_type"), F.first(f"run_{entry}_{step}").alias("at"))
            for entry, step in runs
        )
    )
    picked = (
        sliced.groupBy("actor", "slice")
        .agg(F.array_distinct(picks).alias("picks"))
        .select("actor", F.inline("picks"))
        .where("at is not null")
    )
    return few.unionByName(picked)


def _with_step_times(rows: DataFrame, spec: FunnelSpec) -> DataFrame:
    """``at_n``: the time of a row that is of step n's type."""
    times = {
        f"at_{n}": F.when(F.col("event_type") == name, F.col("at"))
        for n, name in enumerate(spec.steps)
    }
    return rows.withColumns(times)


def walks(rows: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row per person who entered: microseconds ``t_0 .. t_n``, NULL if not reached.

    All steps share one shuffle and one sort by person.
    """
    rows = _with_step_times(rows, spec).withColumn(
        "t_0", F.expr("min(at_0) over (partition by actor)")
    )
    for n in range(1, len(spec.steps)):
        in_time = f"at_{n} > t_{n - 1} and at_{n} <= t_0 + {spec.window_micros}"
        earliest = f"min(if({in_time}, at_{n}, null)) over (partition by actor)"
        rows = rows.withColumn(f"t_{n}", F.expr(earliest))
    times = [F.first(f"t_{n}").alias(f"t_{n}") for n in range(len(spec.steps))]
    return rows.groupBy("actor").agg(*times).where("t_0 is not null")


def measured(walked: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row: ``actors_n`` and ``median_n``, in microseconds, for every step n."""
    numbers = range(len(spec.steps))
    return walked.agg(
        *(F.count(f"t_{n}").alias(f"actors_{n}") for n in numbers),
        *(
            F.expr(f"percentile(t_{n} - t_{n - 1}, 0.5)").alias(f"median_{n}")
            for n in numbers[1:]
        ),
    )


def measured_apart(walked: DataFrame, spec: FunnelSpec) -> DataFrame:
    """The same for any number of people: no task gathers all durations of a step."""
    numbers = range(len(spec.steps))
    # Entering takes no time; the 1 stands for it so that entries are counted along
    # with the other steps, whose durations are at least 1.
    taken = ["bigint(1)", *(f"t_{n} - t_{n - 1}" for n in numbers[1:])]
    # The only shuffle of per-person rows; both passes over the durations read it.
    tally = (
        walked.select(F.expr(f"posexplode(array({', '.join(taken)})) as (step, value)"))
        .where("value is not null")
        .groupBy("step", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # One or two rows per step, made one row in all.
    return middle_values(tally, "step").agg(
        *(F.expr(f"coalesce(max(if(step = {n}, total, null)), 0)").alias(f"actors_{n}") for n in numbers),
        *(
            F.expr(
                f"(min(if(step = {n}, value, null)) + max(if(step = {n}, value, null))) / 2"
            ).alias(f"median_{n}")
            for n in numbers[1:]
        ),
    )


def report(totals: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row per step out of one row of numbers."""
    steps = []
    for n, name in enumerate(spec.steps):
        previous = f"if(actors_{n - 1} = 0, 0D, actors_{n} / actors_{n - 1})" if n else "1D"
        steps.append(
            F.struct(
                F.lit(n + 1).alias("step"),
                F.lit(name).alias("event_type"),
                F.col(f"actors_{n}").alias("actors"),
                F.expr(previous).alias("conversion_from_previous"),
                # No entrants is a conversion of zero.
                F.expr(f"if(actors_0 = 0, 0D, actors_{n} / actors_0)").alias("conversion_from_first"),
                F.expr(f"median_{n} / 1e6D" if n else "double(null)").alias("median_seconds_from_previous"),
            )
        )
    return totals.select(F.inline(F.array(*steps)))


def funnel_totals(
    reported: DataFrame, steps: Sequence[str], window: str | None = None
) -> DataFrame:
    """One row over a funnel's report: ``conversion_window, entered, completed,
    overall_conversion``."""
    spec = FunnelSpec.parse(steps, window)
    totals = reported.agg(
        F.max(F.when(F.col("step") == 1, F.col("actors"))).alias("entered"),
        F.max(F.when(F.col("step") == len(spec.steps), F.col("actors"))).alias("completed"),
    )
    return totals.select(
        F.lit(spec.window_text).alias("conversion_window"),
        "entered",
        "completed",
        F.expr("if(entered = 0, 0D, completed / entered)").alias("overall_conversion"),
    )
