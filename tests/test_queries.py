import random
from datetime import timedelta

import pytest
from conftest import SPAN, T0, utc

from footfall import operators as op

MINUTE, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)


def pairs(df):
    return [tuple(row) for row in df.collect()]


def test_series_has_empty_buckets(make):
    events = make.add(at=T0 + 150 * MINUTE).table()
    points = pairs(op.time_series(events, 1, T0, T0 + 6 * HOUR, "hour"))
    assert [count for _, count in points] == [0, 0, 1, 0, 0, 0]


def test_series_of_nothing_still_lists_buckets(make):
    events = make.add(org=2).table()
    assert [n for _, n in pairs(op.time_series(events, 1, T0, T0 + 3 * DAY))] == [0, 0, 0]


def test_day_buckets_are_utc_days(spark, make):
    assert spark._jvm.java.util.TimeZone.getDefault().getID() == "Asia/Kolkata"
    events = make.add(at=utc(2026, 3, 4, 23, 30)).table()
    points = op.time_series(events, 1, utc(2026, 3, 1), utc(2026, 3, 8))
    texts = points.selectExpr("cast(bucket as string)", "count").collect()
    assert [tuple(r) for r in texts] == [(f"2026-03-0{d} 00:00:00", int(d == 4)) for d in range(1, 8)]


def test_range_is_half_open_and_first_bucket_reaches_back(make):
    start, end = utc(2026, 3, 1, 12), utc(2026, 3, 3)
    for at in (start - MINUTE, start, end - timedelta(microseconds=1), end):
        make.add(at=at)
    texts = op.time_series(make.table(), 1, start, end).selectExpr("cast(bucket as string)", "count")
    assert pairs(texts) == [("2026-03-01 00:00:00", 1), ("2026-03-02 00:00:00", 1)]


def test_weeks_start_on_monday_and_months_differ_in_length(make):
    make.add(at=utc(2026, 3, 1, 23)).add(at=utc(2026, 3, 2)).add(at=utc(2024, 2, 29))
    weeks = op.time_series(make.table(), 1, utc(2026, 2, 25), utc(2026, 3, 9), "week")
    assert pairs(weeks.selectExpr("cast(bucket as string)", "count")) == [
        ("2026-02-23 00:00:00", 1), ("2026-03-02 00:00:00", 1)]
    months = op.time_series(make.table(), 1, utc(2024, 1, 31), utc(2024, 4, 1), "month")
    assert pairs(months.selectExpr("cast(bucket as string)", "count")) == [
        ("2024-01-01 00:00:00", 0), ("2024-02-01 00:00:00", 1), ("2024-03-01 00:00:00", 0)]


def test_default_range_is_the_last_thirty_days(make):
    make.add(at=T0 - 31 * DAY).add(at=T0 - 29 * DAY).add(at=T0)
    assert op.total(op.time_series(make.table(), 1, now=T0)).first()[0] == 1


def test_breakdown_by_type_and_key(make):
    for plan in ("pro", "pro", "free"):
        make.add(metadata=f'{{"plan":"{plan}"}}')
    make.add("signup")
    events = make.table()
    assert pairs(op.breakdown(events, 1, **SPAN)) == [("page_view", 3), ("signup", 1)]
    assert pairs(op.breakdown(events, 1, group_by="metadata.plan", **SPAN)) == [
        ("pro", 2), ("free", 1), (None, 1)]


def test_missing_key_is_a_group_that_may_rank_first(make):
    make.add().add().add(metadata='{"plan":"pro"}')
    assert pairs(op.breakdown(make.table(), 1, group_by="metadata.plan", **SPAN)) == [(None, 2), ("pro", 1)]


def test_breakdown_limit_and_total(make):
    for n in range(4):
        for _ in range(n + 1):
            make.add(f"type_{n}")
    events = make.table()
    top = op.breakdown(events, 1, limit=2, **SPAN)
    assert pairs(top) == [("type_3", 4), ("type_2", 3)]
    assert op.total(top).first()[0] == 7
    assert op.breakdown(events, 1, limit=0, **SPAN).count() == 1
    assert op.total(op.breakdown(events, 9, **SPAN)).first()[0] == 0


def test_filters_are_combined(make):
    for plan, country in (("pro", "SE"), ("free", "SE"), ("pro", "NO")):
        make.add(metadata=f'{{"country":"{country}","plan":"{plan}"}}')
    events = make.table()
    one = op.summary(events, 1, filters=["plan:pro"], **SPAN).first()
    both = op.summary(events, 1, filters=["plan:pro", "country:SE"], **SPAN).first()
    assert (one.total_events, both.total_events) == (2, 1)


def test_summary_counts_people_and_not_ids(make):
    make.add(actor="a").add("signup", HOUR, "a", "u").add(after=2 * HOUR, user="u")
    make.add(after=3 * HOUR, actor="b").add("cron", 4 * HOUR)
    row = op.summary(make.table(), 1, **SPAN).first()
    assert (row.total_events, row.unique_actors, row.distinct_event_types) == (5, 2, 3)
    narrow = op.summary(make.table(), 1, event_type="page_view", **SPAN).first()
    # The signup that links the two ids is outside the filter and still links them.
    assert (narrow.total_events, narrow.unique_actors) == (3, 2)


def test_summary_of_nothing(make):
    row = op.summary(make.add(org=2).table(), 1, **SPAN).first()
    assert tuple(row) == (0, 0, 0, None, None)


def test_earliest_link_wins_within_the_range_only(make):
    make.add(after=2 * HOUR, actor="a", user="late").add(after=HOUR, actor="a", user="early")
    make.add(at=utc(2026, 1, 1), actor="a", user="before").add(actor="a", user="elsewhere", org=2)
    make.add(actor="tie", user="y").add(actor="tie", user="x")
    assert sorted(pairs(op.identities(make.table(), 1, **SPAN))) == [("a", "early"), ("tie", "x")]


def test_pages(make):
    for n in range(5):
        make.add(after=n * MINUTE, metadata=f'{{"n":{n}}}')
    events = make.table()
    first = op.events_page(events, 1, limit=2, **SPAN).collect()
    assert [r.metadata for r in first] == ['{"n":4}', '{"n":3}']
    assert [r.next_offset for r in first] == [2, 2]
    last = op.events_page(events, 1, limit=2, offset=4, **SPAN).collect()
    assert [(r.metadata, r.next_offset) for r in last] == [('{"n":0}', None)]
    exact = op.events_page(events, 1, limit=5, **SPAN).collect()
    assert len(exact) == 5 and exact[0].next_offset is None
    assert op.events_page(events, 1, limit=2, offset=-7, **SPAN).count() == 2
    assert op.events_page(events, 1, limit=0, **SPAN).count() == 1
    assert op.events_page(events, 1, offset=99, **SPAN).count() == 0
    assert first[0].__fields__[:5] == ["event_id", "event_type", "occurred_at", "received_at", "metadata"]


@pytest.mark.parametrize("offset", [0, 3, 7, 49, 50, 59, 60, 400])
def test_deep_offsets_find_the_same_page(make, offset):
    for n in range(60):
        # Ten of them at one instant, the rest far and near.
        after = timedelta(0) if n < 10 else timedelta(microseconds=n) if n < 30 else n * HOUR
        make.add(after=after)
    events = make.table()
    plain = op.events_page(events, 1, limit=5, offset=offset, **SPAN)
    deep = op.events_page(events, 1, limit=5, offset=offset, shallow=2, **SPAN)
    assert pairs(deep) == pairs(plain)


def test_event_types_cover_all_time(make):
    make.add("user_signup", at=utc(2001, 1, 1)).add("user_signedup").add("page_view").add("page_view", org=2)
    make.add("page_view", DAY)
    got = op.event_types(make.table(), 1).selectExpr("event_type", "count", "cast(last_seen_at as string)")
    assert pairs(got) == [
        ("page_view", 2, "2026-05-02 00:00:00"),
        ("user_signedup", 1, "2026-05-01 00:00:00"),
        ("user_signup", 1, "2001-01-01 00:00:00"),
    ]


def test_bad_parameters_fail_before_a_job(make):
    events = make.add().table()
    for call in (
        lambda: op.time_series(events, 1, interval="century"),
        lambda: op.breakdown(events, 1, group_by="metadata.bad key"),
        lambda: op.summary(events, 1, filters=["novalue"]),
        lambda: op.events_page(events, 1, start=T0, end=T0),
        lambda: op.funnel(events, 1, ["a"]),
        lambda: op.funnel(events, 1, ["a", "b"], "fortnight"),
    ):
        with pytest.raises(ValueError):
            call()


def test_another_session_zone_is_refused(spark, make):
    events = make.add().table()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            op.time_series(events, 1, **SPAN)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pages_by_position_are_those_by_offset(make):
    """Chained to the end, ties in time and in receipt included; rows that come later move none."""
    rng = random.Random(4)
    for _ in range(60):
        make.add(after=timedelta(minutes=rng.choice([0, 0, 0, 7, 60 * 24 * 3, -60 * 24 * 10])), actor="a")
    events = make.table()
    whole = [r.event_id for r in op.events_page(events, 1, **SPAN, limit=1000).collect()]
    seen, token = [], None
    while True:
        page = op.events_page_after(events, 1, **SPAN, limit=13, after=token).collect()
        seen += [r.event_id for r in page]
        token = page[0].next_after
        if token is None:
            break
        events = make.add(at=utc(2026, 5, 20)).table()  # newer than all
    assert seen == whole and len(seen) == 60
    assert op.events_page_after(events, 1, **SPAN, filters=["no:such"]).collect() == []
    with pytest.raises(ValueError):
        op.events_page_after(events, 1, **SPAN, after="yesterday")
