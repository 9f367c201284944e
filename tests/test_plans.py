"""What the physical plans look like, and the skew helpers against brute force."""

import random
import re
from statistics import median

import pytest
from conftest import SPAN
from pyspark.sql import functions as F

from footfall import operators as op
from footfall.operators import funnels, ingest
from footfall.plans.selection import middle_values
from footfall.plans.skew import spread_left_join, survey
from footfall.sources.load import COUNTRIES, load_events
from footfall.sources.sample_tables import sample_events

FOLDER = "/root/testdata/sf0.001"
MONTH = ("2024-01-01", "2024-02-01")


@pytest.fixture(scope="module")
def events(spark):
    return sample_events(spark, FOLDER)


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    text = initial_plan(df)
    return text[: text.index("Initial Plan")]


def exchanges(text):
    return len(re.findall(r"[-+] Exchange ", text))


def test_no_python_on_any_row(events):
    for question in (
        op.time_series(events, 1, *MONTH),
        op.breakdown(events, 1, *MONTH, group_by="metadata.plan", filters=["k:1", "plan:pro"]),
        op.summary(events, 1, *MONTH),
        op.funnel(events, 1, ["view", "click"], None, *MONTH),
        op.events_page(events, 1, *MONTH),
    ):
        text = initial_plan(question)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_series_needs_one_shuffle_and_a_sort(events):
    text = initial_plan(op.time_series(events, 1, *MONTH))
    assert exchanges(text) == 2 and "Join" not in text and "partial_sum" in text
    assert "props" not in text and "value#" not in text


def test_top_entries_are_not_sorted_as_a_whole(events):
    text = initial_plan(op.breakdown(events, 1, *MONTH))
    assert "TakeOrderedAndProject(limit=50" in text and "partial_count" in text
    assert "TakeOrderedAndProject(limit=101" in initial_plan(op.events_page(events, 1, *MONTH))


def test_pages_over_equal_times_stay_shallow(events):
    month = F.date_trunc("month", "occurred_at")
    tied = events.withColumns({"occurred_at": month, "received_at": month})
    for offset in (0, 15, 200, 300):
        text = initial_plan(op.events_page(tied, 1, *MONTH, limit=10, offset=offset, shallow=20))
        limits = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", text)]
        assert limits and max(limits) <= 20 + 11


@pytest.mark.parametrize("filters", [None, ["plan:pro"]])
def test_summary_reads_once_and_reduces_first(events, filters):
    text = final_plan(op.summary(events, 1, *MONTH, filters=filters))
    assert text.count("FileScan") == 1 and "Join" not in text and "Expand" not in text
    # The scan's rows are combined before anything is sent.
    scan = text.index("FileScan")
    assert "HashAggregate(keys=[user_id" in text[text.rindex("Exchange", 0, scan):scan]


def test_summary_gathers_no_busy_id(spark):
    """One anonymous id with as many users as there are rows, and one user with as many ids."""
    rows = spark.range(0, 20_000, 1, 8).selectExpr(
        "cast(id as string) as event_id", "1L as organization_id", "'e' as event_type", "timestamp'2024-01-05' as occurred_at",
        "timestamp'2024-01-05' as received_at", "'{}' as metadata", "if(id % 2 = 0, concat('u-', id), 'busy') as user_id",
        "if(id % 2 = 0, 'undefined', concat('a-', id)) as anonymous_id", "cast(null as string) as actor_id")
    asked = op.summary(rows, 1, *MONTH)
    assert asked.first().unique_actors == 10_001
    text = final_plan(asked)
    assert "Window" not in text and "Join" not in text
    # Whatever is sent by a key was added up for the key before.
    for sent in re.findall(r"Exchange hashpartitioning.*\n(.*)", text):
        assert "Aggregate" in sent, sent


def test_small_funnel_shuffles_people_once(events):
    text = initial_plan(op.funnel(events, 1, ["view", "click", "signup", "purchase"], None, *MONTH))
    # People, the links (pairs, then ids), and the single row at the end.
    assert exchanges(text) == 4


def test_large_funnel_shares_the_tally(events, monkeypatch):
    monkeypatch.setattr(funnels, "SMALL_ROWS", -1)
    text = final_plan(op.funnel(events, 1, ["view", "click", "signup"], None, *MONTH))
    assert "ReusedExchange" in text and "percentile" not in text
    assert text.count("FileScan") == 2


def test_duplicates_are_dropped_before_the_shuffle(spark):
    rows = spark.range(9).selectExpr("id % 2 as organization_id", "'e' as event_id", "1 as partition", "id as offset")
    text = initial_plan(ingest.first_deliveries(rows))
    assert text.index("row_number(), 1, Final") < text.index("Exchange") < text.index("row_number(), 1, Partial")


def test_survey_names_the_busy_keys(spark):
    rows = spark.range(3_000_000).selectExpr("if(id % 3 = 0, 'busy', if(id % 3 = 1, null, cast(id as string))) as k")
    total, heavy = survey(rows, F.col("k"))
    assert total == 3_000_000 and [tuple(r) for r in heavy.collect()] == [("busy", 1)]
    total, heavy = survey(rows, F.col("k"), 300_000)
    assert [tuple(r) for r in heavy.collect()] == [("busy", 4)]
    assert survey(rows.limit(0), F.col("k")) == (0, None)


@pytest.mark.parametrize("parts", [{}, {"busy": 7}, {"busy": 3, "absent": 2, "k3": 1}])
def test_spread_join_equals_a_plain_one(spark, parts):
    heavy = spark.createDataFrame(list(parts.items()), "heavy_key string, parts int") if parts else None
    left = spark.range(2_000).selectExpr(
        "id", "case id % 3 when 0 then 'busy' when 1 then null else concat('k', id % 50) end as k")
    right = spark.range(30).selectExpr("if(id = 0, 'busy', concat('k', id)) as k", "id as found")
    got = spread_left_join(left, right, "k", ["id"], heavy).select("id", "k", "found")
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(
        left.join(right, "k", "left").select("id", "k", "found").collect(), key=lambda r: r.id)


def test_busy_and_missing_keys_are_spread(spark, monkeypatch):
    left = spark.range(30_000).selectExpr("id", "case id % 3 when 0 then 'busy' when 1 then null else concat('k', id) end as k")
    right = spark.range(9).selectExpr("if(id = 0, 'busy', concat('k', id)) as k", "id as found")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        heavy = spark.createDataFrame([("busy", 64)], "heavy_key string, parts int")
        joined = spread_left_join(left, right, "k", ["id"], heavy)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 30_000 and max(sizes) < 1.3 * 30_000 / 8


@pytest.mark.parametrize("seed", range(4))
def test_middle_values_are_exact(spark, seed):
    rng = random.Random(seed)
    values = {
        "even": [rng.randrange(1, 10**13) for _ in range(500)],
        "odd": [rng.randrange(1, 9) for _ in range(501)],
        "one": [rng.randrange(1, 10**6)],
        "pair": [1, 3 * 10**13],
        "near": [10**12 + rng.randrange(5) for _ in range(300)],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, value long")
    tally = rows.groupBy("g", "value").agg(F.count("*").alias("rows"))
    found = middle_values(tally, "g").groupBy("g").agg(
        ((F.min("value") + F.max("value")) / 2).alias("m"), F.max("total").alias("n"))
    assert {r.g: (r.m, r.n) for r in found.collect()} == {g: (median(vs), len(vs)) for g, vs in values.items()}


def test_thinning_keeps_few_rows_of_a_busy_person(spark, make):
    from footfall.params import FunnelSpec, TimeRange

    spec, span = FunnelSpec.parse(["a", "b", "c"]), TimeRange.resolve(**SPAN)
    rows = spark.range(100_000).selectExpr(
        "'busy' as actor", "element_at(array('a', 'b', 'c'), cast(id % 3 + 1 as int)) as event_type",
        f"{span.start_micros} + id * 1000 as at")
    # All within a hundred seconds, which is one slice.
    assert funnels.thinned(rows, spec, span).count() <= 6


def test_rows_of_one_instant_are_spread(spark):
    from footfall.operators.identity import with_actor

    rows = spark.range(80_000).selectExpr(
        "'view' as event_type", "timestamp'2026-05-01' as occurred_at", "concat('u-', id % 997) as user_id",
        "cast(null as string) as anonymous_id", "cast(id as string) as event_id")
    links = spark.createDataFrame([("a", "u-1")], "anonymous_id string, user_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = with_actor(rows, links, ["occurred_at", "event_type", "user_id", "event_id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 80_000 and max(sizes) < 1.2 * 80_000 / 8


def test_load_events_have_known_shares(spark):
    rows = load_events(spark.range(200), "id").collect()
    plans = [r.metadata.split('"plan":"')[1].split('"')[0] for r in rows]
    assert (plans.count("free"), plans.count("pro"), plans.count("enterprise")) == (170, 20, 10)
    assert rows[9].metadata == f'{{"build":"v9","country":"{COUNTRIES[1]}","plan":"free"}}'
    assert {r.event_type for r in rows} == {"load_test"}
