from datetime import timedelta
from pathlib import Path

import pytest
from conftest import SPAN, T0, utc
from pyspark.sql import functions as F

from footfall import operators as op
from footfall.operators import maintenance
from footfall.operators.partials import audit_of_days, event_types_of_days, identities_of_days, time_series_of_days
from footfall.schema import NOBODY
from footfall.sources.events import append_events, read_events
from footfall.sources.store import Store, compact_events, delete_events, finish_rewrite, fold_dead_letters

DAY = timedelta(days=1)


@pytest.fixture
def filled(make, spark, tmp_path):
    make.add("page_view", user="u").add("page_view", actor="a").add("load_test", DAY)
    make.add("page_view", 2 * DAY, "a", "u").add("page_view", 2 * DAY, "b", "v").add("page_view", 2 * DAY, user="u", org=2)
    make.add("load_test", 3 * DAY, org=2)
    store = Store(str(tmp_path / "store"))
    store.append(make.table(), "b0")
    return store


def left(spark, store):
    return sorted(int(r.event_id[-2:]) for r in store.read(spark).select("event_id").collect())


def test_audit(spark, filled):
    assert [tuple(r) for r in maintenance.audit(filled.read(spark)).collect()] == [
        (1, "page_view", 4), (1, "load_test", 1), (2, "load_test", 1), (2, "page_view", 1)]


def test_purge(spark, filled):
    kept = maintenance.purge_event_types(filled.read(spark), ["load_test", "warmup"])
    assert kept.count() == 5
    # Two dates hold such rows, and nothing else.
    assert delete_events(spark, filled, maintenance.of_types(["load_test", "warmup"])) == 2
    assert left(spark, filled) == [0, 1, 3, 4, 5]
    assert delete_events(spark, filled, maintenance.of_types(["load_test"])) == 0


def test_erasing_a_person_keeps_rows_without_a_user(spark, filled):
    assert maintenance.erase_person(filled.read(spark), 1, "u").count() == 5
    delete_events(spark, filled, maintenance.of_user(1, "u"))
    assert left(spark, filled) == [1, 2, 4, 5, 6]


def test_removing_a_tenant_takes_its_events(spark, filled):
    organizations = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    tenants, events = maintenance.remove_tenant(organizations, filled.read(spark), 1)
    assert [r.id for r in tenants.collect()] == [2] and events.count() == 2
    delete_events(spark, filled, maintenance.of_tenant(1))
    assert left(spark, filled) == [5, 6]


def test_untouched_dates_are_not_rewritten(spark, filled):
    def files(day):
        return set(Path(filled.events).glob(f"event_date={day}/*.parquet"))

    before = files("2026-05-03"), files("2026-05-01")
    delete_events(spark, filled, maintenance.of_user(2, "u"))
    assert files("2026-05-01") == before[1] and files("2026-05-03") != before[0]
    assert {r.ingest_batch for r in filled.read(spark).collect()} == {"b0"}


@pytest.mark.parametrize("stop_at", (1, 2, 3, 5, 7))
def test_a_rewrite_that_stops_loses_nothing(spark, filled, monkeypatch, stop_at):
    """Stopped before any of its writes, a reader sees the old rows or the new ones, it may be
    called again, and the days' counts follow the rows."""
    from pyspark.sql.readwriter import DataFrameWriter

    real, calls, seen = DataFrameWriter.parquet, [], []
    old, new = list(range(7)), [1, 2, 4, 5, 6]

    def write(self, *args, **more):
        seen.append(left(spark, filled))
        if len(calls) == stop_at:
            raise OSError("gone")
        calls.append(args)
        return real(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    if stop_at < 7:
        with pytest.raises(OSError):
            delete_events(spark, filled, maintenance.of_user(1, "u"))
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        # What counts from the third write on is what the dates will be.
        assert left(spark, filled) == (old if stop_at < 3 else new)
    assert delete_events(spark, filled, maintenance.of_user(1, "u")) == (0 if 3 <= stop_at < 7 else 2)
    assert all(rows in (old, new) for rows in seen) and left(spark, filled) == new
    events, daily = filled.read(spark), filled.read_daily(spark)
    assert audit_of_days(daily).collect() == maintenance.audit(events).collect()


def test_a_date_that_was_lost_half_way_is_put_back(spark, filled, monkeypatch):
    """An overwrite removes a date before it puts the new one in its place."""
    monkeypatch.setattr("footfall.sources.store.write_dates", lambda rows, path: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        delete_events(spark, filled, maintenance.of_user(1, "u"))
    for file in Path(filled.events).glob("event_date=2026-05-01/*"):
        file.unlink()
    assert left(spark, filled) == [1, 2, 4, 5, 6]
    monkeypatch.undo()
    finish_rewrite(spark, filled)
    assert left(spark, filled) == [1, 2, 4, 5, 6]
    same_days(spark, filled)
    assert filled.pending(spark) is None


def test_rows_added_after_a_rewrite_count(spark, filled, make):
    delete_events(spark, filled, maintenance.of_user(1, "u"))
    make.rows.clear()
    filled.append(make.add(event_id="00000000-0000-0000-0000-000000000009", user="w").table(), "b1")
    assert left(spark, filled) == [1, 2, 4, 5, 6, 9]
    delete_events(spark, filled, maintenance.of_user(1, "w"))
    assert left(spark, filled) == [1, 2, 4, 5, 6]


def test_a_date_without_rows_left(spark, filled, make):
    assert delete_events(spark, filled, F.lit(True)) == 4
    assert left(spark, filled) == [] and filled.read_daily(spark).count() == filled.read_links(spark).count() == 0
    assert maintenance.audit(filled.read(spark)).count() == 0
    # One row stands in for each date, where the files are, and no question sees it.
    assert [r[0] for r in read_events(spark, filled.events).select("organization_id").collect()] == [NOBODY] * 4
    filled.append(make.table(), "b0 again")
    assert left(spark, filled) == list(range(7))
    same_days(spark, filled)


CUT = {"start": T0 + timedelta(hours=7), "end": T0 + 2 * DAY + timedelta(minutes=1)}


def same_days(spark, store):
    """What the days add up to is what the rows say."""
    events, daily, links = store.read(spark), store.read_daily(spark), store.read_links(spark)
    assert audit_of_days(daily).collect() == maintenance.audit(events).collect()
    assert event_types_of_days(daily, 1).collect() == op.event_types(events, 1).collect()
    assert sorted(identities_of_days(links, events, 1, **CUT).collect()) == sorted(op.identities(events, 1, **CUT).collect())


@pytest.mark.parametrize("span, interval, kind", [
    (SPAN, "day", None), (CUT, "week", "page_view"), (CUT, "day", None), ({"start": T0 + timedelta(hours=1), "end": T0 + timedelta(hours=3)}, "month", None),
    ({"start": T0 - DAY, "end": T0 + DAY}, "day", "page_view"), ({"start": T0 - timedelta(hours=5), "end": T0}, "day", None)], ids=range(6))
def test_ranges_by_days(spark, filled, span, interval, kind):
    events, daily, links = filled.read(spark), filled.read_daily(spark), filled.read_links(spark)
    series = time_series_of_days(daily, events, 1, **span, interval=interval, event_type=kind)
    assert series.collect() == op.time_series(events, 1, **span, interval=interval, event_type=kind).collect()
    assert sorted(identities_of_days(links, events, 1, **span).collect()) == sorted(op.identities(events, 1, **span).collect())


def test_days_add_up(spark, filled, make):
    same_days(spark, filled)
    make.rows.clear()
    late = make.add("load_test", -400 * DAY, "b", "z", event_id="late").add("page_view", timedelta(hours=6), "a", "x", event_id="more").table()
    filled.append(late, "b1")
    same_days(spark, filled)
    # A batch that stored a part of its rows before says the larger numbers of itself when it runs again.
    rest = make.add("page_view", timedelta(hours=2), "a", "w", event_id="rest").table()
    filled.append(rest.where("event_id = 'rest'"), "b1", rest)
    assert filled.read_daily(spark).count() > 7
    same_days(spark, filled)
    with pytest.raises(ValueError):
        time_series_of_days(filled.read_daily(spark), filled.read(spark), 1, **SPAN, interval="hour")
    compact_events(spark, filled, F.lit(True))
    same_days(spark, filled)
    # Folded: one row for each key.
    assert filled.read_daily(spark).count() == filled.read_daily(spark).select("organization_id", "event_type", "event_date").distinct().count()


def test_catalogue_reads_no_event_row(spark, filled):
    for question in (event_types_of_days(filled.read_daily(spark), 1), audit_of_days(filled.read_daily(spark))):
        assert all("/daily/" in path for path in question.inputFiles())


def test_whole_days_come_from_the_days(spark, filled):
    """Events are read for the cut days at both ends only."""
    events = filled.read(spark).where("event_date in ('2026-05-01', '2026-05-03')")
    span = {"start": T0 + timedelta(seconds=1), "end": T0 + 2 * DAY + timedelta(hours=1)}
    found = time_series_of_days(filled.read_daily(spark), events, 1, **span)
    assert found.collect() == op.time_series(filled.read(spark), 1, **span).collect()


def test_dead_letters_fold(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    letters = spark.range(0, 20, 1, 4).selectExpr("'t' as topic", "0 as partition", "id as offset", "'1' as key", "'{' as value",
                                                  "timestamp'2026-05-01' + make_dt_interval(cast(id % 2 as int)) as timestamp", "'r' as reason")
    assert store.read_dead_letters(spark).count() == 0
    for batch in ("b0", "b1", "b1"):
        store.add_dead_letters(letters, batch)
    assert store.read_dead_letters(spark).count() == 40
    assert len(list(Path(store.dead_letters).glob("day=*"))) == 2
    fold_dead_letters(spark, store, F.col("day") < "2026-05-02")
    assert store.read_dead_letters(spark).count() == 40
    assert len(list(Path(store.dead_letters).glob("day=2026-05-01/*.parquet"))) == 1


def test_compacted_files_hold_few_tenants(spark, make, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = spark.range(0, 50_000, 1, 8).selectExpr(
        "cast(id as string) as event_id", "id % 50 as organization_id", "'e' as event_type",
        "timestamp'2026-05-01' + make_dt_interval(0, 0, 0, id % 80000) as occurred_at",
        "timestamp'2026-05-01' as received_at", "'{}' as metadata", "cast(null as string) as user_id",
        "cast(null as string) as anonymous_id", "cast(null as string) as actor_id")
    store.append(rows, "b0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compact_events(spark, store, F.lit(True))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = read_events(spark, store.events).groupBy(F.input_file_name()).agg(F.count_distinct("organization_id").alias("n")).collect()
    assert store.read(spark).count() == 50_000 and len(held) > 4
    assert max(r.n for r in held) <= 50 / len(held) + 2


def test_queries_read_only_the_dates_they_need(spark, filled):
    events = filled.read(spark)
    plan = op.time_series(events, 1, T0 + DAY, T0 + 2 * DAY)
    assert [n for _, n in plan.collect()] == [1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = op.time_series(events, 1, T0 + DAY, T0 + 2 * DAY)
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "event_date" in scan.split("PartitionFilters")[1] and "2026-05-02" in scan
    assert "EqualTo(organization_id,1), GreaterThanOrEqu" in scan
    assert "metadata" not in scan.split("ReadSchema")[1]


def test_stored_answers_equal_those_of_the_source(spark, filled, make):
    for question in (
        lambda e: op.summary(e, 1, **SPAN),
        lambda e: op.breakdown(e, 1, **SPAN),
        lambda e: op.events_page(e, 1, **SPAN),
        lambda e: op.funnel(e, 1, ["page_view", "page_view"], **SPAN),
    ):
        assert question(filled.read(spark)).collect() == question(make.table()).collect()


def test_backdated_rows_find_their_date(spark, make, tmp_path):
    path = str(tmp_path / "events")
    append_events(make.add(at=utc(1999, 12, 31, 23, 59)).add(at=utc(2000, 1, 1)).table(), path)
    dates = read_events(spark, path).selectExpr("cast(event_date as string)").collect()
    assert sorted(r[0] for r in dates) == ["1999-12-31", "2000-01-01"]


def test_compaction_changes_files_and_not_rows(spark, make, tmp_path):
    store = Store(str(tmp_path / "store"))
    for n in range(4):
        make.rows.clear()
        append_events(make.add(event_id=f"00000000-0000-0000-0000-{n:012d}").table(), store.events, f"b{n}")
    before = store.read(spark).orderBy("event_id").collect()
    assert len(list(Path(store.events).rglob("*.parquet"))) == 4
    assert compact_events(spark, store, F.col("event_date") == before[0].event_date) == 1
    after = store.read(spark).orderBy("event_id").collect()
    assert after == before
    assert len(list(Path(store.events).rglob("*.parquet"))) == 1
