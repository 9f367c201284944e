import json
from types import SimpleNamespace

import pytest
from conftest import T0
from pyspark.sql import functions as F

from footfall.functions.text import api_key_hash, api_key_prefix
from footfall.operators import ingest
from footfall.plans import skew
from footfall.schema import ORGANIZATIONS, REQUEST
from footfall.session import checkpoint_location
from footfall.sources.messages import MESSAGES, backlog, file_messages, write_files
from footfall.sources.sample_tables import ODD_TIMES
from footfall.sources.store import Outbox, Store, delete_events
from footfall.streaming.ingest import accept, classify, consume, publish, store_batch
from footfall.streaming.retry import BackOff
from footfall.streaming.watch import Watch, lag_of

UUID = "11111111-2222-3333-4444-{:012d}"


@pytest.fixture
def organizations(spark):
    rows = [(n, f"org {n}", f"key-{n}") for n in (1, 2)]
    return spark.createDataFrame(rows, "id long, name string, key string").select(
        "id", "name", api_key_hash(F.col("key")).alias("api_key_hash"),
        api_key_prefix(F.col("key")).alias("api_key_prefix"), F.lit(T0).alias("created_at"),
    ).select(ORGANIZATIONS.names)


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


def message(number, org=1, event_type="page_view", **more):
    body = {"eventId": UUID.format(number), "organizationId": org, "eventType": event_type,
            "occurredAt": "2026-05-01T00:00:00Z", "metadata": {"n": number}, **more}
    return json.dumps({k: v for k, v in body.items() if v is not ...})


def messages(spark, values, first_offset=0):
    rows = [("1", value, "topic", 0, first_offset + n, T0) for n, value in enumerate(values)]
    return spark.createDataFrame(rows, MESSAGES)


def requests(spark, *values, key="key-1"):
    rows = [(key, value, "topic", 0, n, T0) for n, value in enumerate(values)]
    return spark.createDataFrame(rows, f"api_key string, {MESSAGES.split(', ', 1)[1]}")


def audit(spark, store):
    row = ingest.reconcile(store.read_audit(spark)).first()
    assert row.balanced
    return tuple(row)[:5]


def test_keys(spark):
    rows = spark.createDataFrame([(" key \t",), ("key",)], "k string")
    first, second = rows.select(api_key_hash(F.col("k"))).collect()
    assert first[0] == second[0] == "2c70e12b7a0646f92279f427c7b38e7334d8e5389cff167a1dc30e73f826b683"
    shown = spark.createDataFrame([("st_0123456789",), ("st_1",)], "k string")
    assert [r[0] for r in shown.select(api_key_prefix(F.col("k"))).collect()] == ["st_01234567", "st_1"]


@pytest.mark.parametrize("body, field", [
    ('{"metadata":{"a":"b"}}', "eventType"),
    ('{"eventType":" "}', "eventType"),
    ('{"eventType":["a"]}', "eventType"),
    (json.dumps({"eventType": "x" * 201}), "eventType"),
    ('{"eventType":"a","eventId":"7"}', "eventId"),
    ('{"eventType":"a","occurredAt":"2026-05-01"}', "occurredAt"),
    ('{"eventType":"a","occurredAt":"2026-05-01T00:00:00"}', "occurredAt"),
    ('{"eventType":"a","metadata":"{}"}', "metadata"),
    ('{"eventType":"a","metadata":[]}', "metadata"),
    (json.dumps({"eventType": "a", "userId": "😀" * 101}), "userId"),
    ('{"eventType":"a","anonymousId":{"a":1}}', "anonymousId"),
    ('{"eventType":"a"', "body"),
    ("", "body"), ("[]", "body"), ("null", "body"), ('"text"', "body"), ("{'eventType':'a'}", "body"),
])
def test_field_errors(spark, body, field):
    checked = ingest.validate(ingest.decode(requests(spark, body), REQUEST))
    assert [e.field for e in checked.first().errors] == [field]


@pytest.mark.parametrize("body", [
    '{"eventType":"a"}',
    json.dumps({"eventType": "x" * 200, "userId": "😀" * 100}),
    '{"eventType":"{not json","unknown":1,"userId":"[x"}',
    '{"eventType":"a","eventId":null,"occurredAt":null,"metadata":null,"userId":null}',
    '{"eventType":"a","occurredAt":"2026-05-01T02:00:00.123+02:00"}',
])
def test_acceptable(spark, body):
    assert ingest.validate(ingest.decode(requests(spark, body), REQUEST)).first().errors == []


def test_accept_fills_in_and_attributes(spark, organizations):
    body = '{"eventType":"a","organizationId":2,"userId":5}'
    once, again = (accept(requests(spark, body), organizations).first() for _ in range(2))
    # The tenant comes from the key, whatever the body says, and a retry draws the same id.
    assert (once.organization_id, once.metadata, once.user_id) == (1, "{}", "5")
    assert once.event_id == again.event_id and len(once.event_id) == 36
    assert once.occurred_at == T0.replace(tzinfo=None) or once.occurred_at.astimezone(T0.tzinfo) == T0
    for key in (None, "", "  ", "key-3"):
        row = accept(requests(spark, body, key=key), organizations).first()
        assert row.organization_id is None and [e.field for e in row.errors] == ["api_key"]
    assert accept(requests(spark, body, key=" key-2 "), organizations).first().organization_id == 2


def test_lists_are_taken_whole(spark):
    good, bad = {"eventType": "a"}, {"eventType": ""}
    values = [json.dumps({"events": e}) for e in ([good, good, good], [good, bad], [], None)] + ["{}", "x"]
    rows = ingest.validate(ingest.decode_batches(requests(spark, *values))).collect()
    errors = {}
    for row in rows:
        errors.setdefault(row.offset, []).append([e.field for e in row.errors])
    assert errors == {
        0: [[], [], []], 1: [["events"], ["events", "eventType"]], 2: [["events"]], 3: [["events"]],
        4: [["events"]], 5: [["body"]],
    }


def test_unreadable_neighbour_costs_only_itself(spark, organizations, store):
    store_batch(messages(spark, [message(1), "{not json", message(2)]), organizations, store, "b0")
    assert store.read(spark).count() == 2
    assert audit(spark, store) == (3, 1, 0, 2, 0)
    store_batch(messages(spark, ["{", "[]"]), organizations, store, "b1")
    store_batch(messages(spark, []), organizations, store, "b2")
    assert audit(spark, store) == (5, 3, 0, 2, 0)


def test_unknown_tenant_and_missing_fields_go_to_dead_letters(spark, organizations, store):
    values = [message(1), message(2, org=9), message(3, event_type=...), message(4, organizationId=...),
              message(5, occurredAt=..., eventId=None), message(6)]
    store_batch(messages(spark, values), organizations, store, "b0")
    assert store.read(spark).count() == 2
    assert audit(spark, store) == (6, 0, 4, 2, 0)
    letters = store.read_dead_letters(spark).orderBy("offset").collect()
    assert [(r.offset, r.reason) for r in letters] == [
        (1, "unknown organization"), (2, "no event_type"), (3, "no organization_id"), (4, "no event_id, occurred_at")]
    assert letters[0].value == values[1]


def test_wrong_types_are_unreadable(spark, organizations):
    values = [message(1, metadata=7), message(2, occurredAt="soon"), message(3, eventId="x"),
              message(4, organizationId="one"), message(5, userId=[1]), message(6, metadata=None, userId=" ")]
    rows = classify(messages(spark, values), organizations).orderBy("offset").collect()
    assert [r.outcome for r in rows] == ["invalid"] * 5 + ["valid"]
    assert (rows[5].metadata, rows[5].user_id) == ("{}", None)


def test_duplicates(spark, organizations, store):
    retried = [message(1, event_type=f"try {n}") for n in range(3)]
    store_batch(messages(spark, [*retried, message(1, org=2)]), organizations, store, "b0")
    # Sent again much later, and said to have happened at another time.
    late = [message(1, occurredAt="2001-01-01T00:00:00Z"), message(2)]
    store_batch(messages(spark, late, 100), organizations, store, "b1")
    stored = store.read(spark).orderBy("organization_id", "event_id").collect()
    assert [(r.organization_id, r.event_id[-1], r.event_type) for r in stored] == [
        (1, "1", "try 0"), (1, "2", "page_view"), (2, "1", "page_view")]
    assert audit(spark, store) == (6, 0, 0, 3, 3)


def test_a_batch_may_run_again(spark, organizations, store):
    batch = messages(spark, [message(n % 7) for n in range(20)] + ["{", message(8, org=9)])
    for _ in range(2):
        store_batch(batch, organizations, store, "b0")
        assert store.read(spark).count() == 7
        assert audit(spark, store) == (22, 1, 1, 7, 13)
        assert store.read_dead_letters(spark).count() == 1


def test_a_batch_resumes_after_a_crash_half_way(spark, organizations, store):
    first_half = messages(spark, [message(n) for n in range(5)])
    store_batch(first_half, organizations, store, "b0")
    whole = messages(spark, [message(n) for n in range(10)])
    store_batch(whole, organizations, store, "b0")
    assert audit(spark, store) == (10, 0, 0, 10, 0)


def test_large_batches_and_dimensions_take_the_other_way(spark, organizations, store, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HEAVY_ROWS", 2)
    monkeypatch.setattr("footfall.streaming.ingest.BROADCAST_ROWS", 0)
    values = [message(n % 6, org=n % 3 + 1) for n in range(30)]
    for name in ("b0", "b1"):
        store_batch(messages(spark, values), organizations, store, name)
    assert store.read(spark).count() == 4
    assert audit(spark, store) == (60, 0, 20, 4, 36)


def test_stored_row(spark, organizations, store):
    value = message(1, userId="auth0|abc123", anonymousId="anon-77")
    store_batch(messages(spark, [value, message(2, userId="", anonymousId="a")]), organizations, store, "b0")
    one, two = store.read(spark).orderBy("event_id").collect()
    assert (one.user_id, one.anonymous_id, one.actor_id) == ("auth0|abc123", "anon-77", "auth0|abc123")
    assert (two.user_id, two.anonymous_id, two.actor_id) == (None, "a", "a")
    assert one.received_at is not None and str(one.event_date) == "2026-05-01"


def test_streams_end_to_end(spark, organizations, store, tmp_path):
    inbox, topic, outbox = str(tmp_path / "inbox"), str(tmp_path / "topic"), Outbox(str(tmp_path / "outbox"))
    schema = f"api_key string, {MESSAGES}"
    numbered = spark.range(0, 400, 1, 4).selectExpr(
        "if(id % 100 = 99, 'wrong', concat('key-', id % 2 + 1)) as api_key",
        "cast(null as string) as key",
        """if(id % 50 = 7, '{"eventType":""}',
            concat('{"eventType":"e","eventId":"', lpad(id % 200, 8, '0'), '-0000-0000-0000-000000000000"}')) as value""",
        "'requests' as topic", "0 as partition", "id as offset", "timestamp'2026-05-01 00:00:00' as timestamp",
    )
    numbered.write.json(inbox)
    positions = iter(range(0, 10**9, 10**6))

    def send(rows):
        start = next(positions)
        sent = rows.select("key", "value", F.lit("topic").alias("topic"), F.lit(0).alias("partition"),
                           (F.monotonically_increasing_id() + start).alias("offset"), F.lit(T0).alias("timestamp"))
        write_files(sent, topic)

    publish(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(inbox), organizations, send,
            outbox, "requests", str(tmp_path / "offsets"), availableNow=True).awaitTermination()
    assert spark.read.parquet(outbox.refusals).count() == 12
    sent = spark.read.parquet(outbox.audit).agg(F.sum("received"), F.sum("published")).first()
    assert tuple(sent) == (400, 388)
    for _ in range(2):
        query = consume(file_messages(spark, topic, 1), lambda: organizations, store, "events",
                        str(tmp_path / "offsets"), availableNow=True)
        query.awaitTermination()
        # Files do not tell how far behind a reader is; Kafka does.
        assert backlog(query) is None
    # Each of 200 ids twice; 4 ids always come with an error and 2 with a wrong key.
    assert audit(spark, store) == (388, 0, 0, 194, 194)
    assert store.read(spark).select("organization_id", "event_id").distinct().count() == 194


def test_every_target_has_its_own_offsets():
    def session(**settings):
        return SimpleNamespace(conf={f"spark.{name}.dir": folder for name, folder in settings.items()})

    shared = session(checkpoint="/shared/y")
    assert checkpoint_location(shared, "s", "/store", "/x/") == "/x/s"
    one, two = (checkpoint_location(shared, "s", target) for target in ("/store", "/other"))
    assert one != two and one.startswith("/shared/y/") and one.endswith("/s")
    assert checkpoint_location(shared, "s", "/store/") == one
    assert checkpoint_location(session(), "s", "/store") == "/store/_offsets/s"


def test_two_stores_of_one_cluster_both_get_everything(spark, organizations, tmp_path):
    topic = str(tmp_path / "topic")
    write_files(messages(spark, [message(n) for n in range(6)]), topic)
    for name in ("one", "two"):
        store = Store(str(tmp_path / name))
        consume(file_messages(spark, topic), lambda: organizations, store, availableNow=True).awaitTermination()
        assert store.read(spark).count() == 6


def test_odd_times_stop_nothing(spark, organizations, store):
    odd = [json.loads(t) if t.startswith('"') else ... for t in ODD_TIMES]
    values = [message(n, occurredAt=o) for n, o in enumerate(odd) if o is not ...]
    values += [message(20 + n).replace('"2026-05-01T00:00:00Z"', t) for n, t in enumerate(ODD_TIMES) if not t.startswith('"')]
    values += [message(50), message(51)]
    for _ in range(2):
        store_batch(messages(spark, values), organizations, store, "b0")
        # Four numbers are beyond the range.
        assert store.read(spark).count() == 9 and audit(spark, store) == (13, 4, 0, 9, 0)
    store_batch(messages(spark, [message(60), message(50)], 100), organizations, store, "b1")
    assert store.read(spark).count() == 10 and audit(spark, store) == (15, 4, 0, 10, 1)
    delete_events(spark, store, F.col("event_id").isin(UUID.format(50), UUID.format(2)))
    assert store.read(spark).count() == 8


# --- streams: state, faults, reports -------------------------------------------


def ingest_files(spark, topic, organizations, store, tmp_path, **more):
    query = consume(file_messages(spark, topic), lambda: organizations, store, "events", str(tmp_path / "offsets"),
                    availableNow=True, **more)
    query.awaitTermination()
    return query


def test_a_batch_costs_what_it_holds(spark, organizations, store, tmp_path, monkeypatch):
    """After the first batch of a run none reads the event table, however large it is."""
    topic, reads = str(tmp_path / "topic"), []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, session: reads.append(1) or real(self, session))
    numbers = []
    watch = Watch().attach(spark)
    write_files(messages(spark, [message(n) for n in range(3)]), topic)
    query = consume(file_messages(spark, topic), lambda: organizations, store, "events", str(tmp_path / "offsets"), processingTime="0 seconds")
    try:
        query.processAllAvailable()
        for size in (20, 200):  # the table grows tenfold
            numbers.append(len(reads))
            write_files(messages(spark, [message(n) for n in range(size // 5, size)], size), topic)
            query.processAllAvailable()
    finally:
        query.stop()
        spark.streams.removeListener(watch)
    assert numbers[-1] == len(reads)
    held = store.read(spark).count()
    # Ids 0 to 2, 4 to 19 and 40 to 199.
    assert held == 3 + 16 + 160 and audit(spark, store) == (179, 0, 0, 179, 0)
    standing = watch.streams["events-remember"]
    assert standing.remembered >= 179 and standing.error is None and watch.streams["events-admit"].input_rows >= 179


def test_sums_of_days_are_dealt_out_by_date(spark, organizations, store, tmp_path):
    """No task has all partitions of their aggregation, and a date still gets one file."""
    topic, days = str(tmp_path / "topic"), range(1, 21)
    write_files(messages(spark, [message(n, occurredAt=f"2026-04-{n:02d}T00:00:00Z", userId="u", anonymousId=f"a-{n}") for n in days]), topic)
    consume(file_messages(spark, topic), lambda: organizations, store, checkpoints=str(tmp_path / "offsets"), availableNow=True).awaitTermination()
    for folder in (store.daily, store.links):
        rows = spark.read.parquet(folder).select("event_date", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).collect()
        assert len(rows) == len({row.event_date for row in rows}) == len(days)
        assert len({row.task for row in rows}) > 1


def test_lost_checkpoints_lose_and_double_nothing(spark, organizations, store, tmp_path):
    topic = str(tmp_path / "topic")
    write_files(messages(spark, [message(n % 7) for n in range(10)] + ["{", message(8, org=9)]), topic)
    for run in range(2):  # each time from the first message on, without any checkpoint
        folder = tmp_path / f"run{run}"
        folder.mkdir()
        ingest_files(spark, topic, organizations, store, folder)
        assert store.read(spark).count() == 7
    assert audit(spark, store) == (24, 2, 2, 7, 13)
    # An id of the table that no stream has stored is known, too.
    store.append(store.read(spark).limit(1).withColumn("event_id", F.lit(UUID.format(50))), "load")
    write_files(messages(spark, [message(50), message(51)], 100), topic)
    ingest_files(spark, topic, organizations, store, tmp_path)
    assert store.read(spark).count() == 9


@pytest.mark.parametrize("step", ["add_audit", "append"])
def test_a_batch_that_stopped_half_way_is_stored_once(spark, organizations, store, tmp_path, monkeypatch, step):
    """Rows are stored, but the batch is not accounted for; or a part of the rows only."""
    topic = str(tmp_path / "topic")
    write_files(messages(spark, [message(n) for n in range(6)] + [message(3)]), topic)
    real = getattr(Store, step)

    def fail(self, rows, *more):
        if step == "append":
            real(self, rows.where(F.col("event_id") < UUID.format(3)), *more)
        raise OSError("gone")

    monkeypatch.setattr(Store, step, fail)
    with pytest.raises(Exception, match="gone"):
        ingest_files(spark, topic, organizations, store, tmp_path)
    monkeypatch.undo()
    ingest_files(spark, topic, organizations, store, tmp_path)
    assert store.read(spark).count() == 6 and audit(spark, store) == (7, 0, 0, 6, 1)
    assert store.read_daily(spark).groupBy().max("count").first()[0] == 6


def test_first_delivery_wins_within_and_across_batches(spark, organizations, store, tmp_path):
    topic = str(tmp_path / "topic")
    write_files(messages(spark, [message(1, event_type=f"try {n}") for n in range(9)]).repartition(4), topic)
    ingest_files(spark, topic, organizations, store, tmp_path)
    write_files(messages(spark, [message(1, event_type="late"), message(2)], 100), topic)
    ingest_files(spark, topic, organizations, store, tmp_path)
    assert sorted(r.event_type for r in store.read(spark).collect()) == ["page_view", "try 0"]


def test_a_record_that_cannot_be_stored_costs_itself_only(spark, organizations, store, tmp_path, monkeypatch):
    from footfall.streaming import ingest as stream

    topic, waits = str(tmp_path / "topic"), []
    write_files(messages(spark, [message(n, event_type="poison" if n in (4, 11) else "fine") for n in range(16)]), topic)
    real = stream.classify

    def brittle(rows, known):
        poison = F.raise_error(F.lit("this record is too much")).cast("string")
        return real(rows, known).withColumn("event_type", F.when(F.col("event_type") == "poison", poison).otherwise(F.col("event_type")))

    monkeypatch.setattr(stream, "classify", brittle)
    back_off = BackOff(sleep=waits.append)
    ingest_files(spark, topic, organizations, store, tmp_path, back_off=back_off)
    assert waits == [1, 2, 4, 8] and {entry[0] for entry in back_off.ledger} == {back_off.ledger[0][0]}
    assert store.read(spark).count() == 14 and audit(spark, store) == (16, 0, 2, 14, 0)
    letters = store.read_dead_letters(spark).orderBy("offset").collect()
    assert [r.offset for r in letters] == [4, 11] and all("too much" in r.reason for r in letters)


def test_an_outage_rejects_nothing(spark, organizations, store, tmp_path, monkeypatch):
    topic = str(tmp_path / "topic")
    write_files(messages(spark, [message(n) for n in range(4)]), topic)
    from footfall.streaming import ingest as stream

    def gone(*_):
        raise OSError("storage is away")

    monkeypatch.setattr(stream, "admit_batch", gone)
    with pytest.raises(Exception, match="storage is away"):
        ingest_files(spark, topic, organizations, store, tmp_path, back_off=BackOff(sleep=lambda _: None))
    monkeypatch.undo()
    ingest_files(spark, topic, organizations, store, tmp_path)
    assert store.read(spark).count() == 4 and audit(spark, store) == (4, 0, 0, 4, 0)


def test_back_off_gives_up_and_succeeds():
    waits, tries = [], []
    BackOff(sleep=waits.append).run("b", lambda: tries.append(1) or len(tries) == 3 or 1 / 0)
    assert waits == [1, 2]
    with pytest.raises(ZeroDivisionError):
        BackOff(first=1, factor=3, most=5, sleep=waits.append).run("b", lambda: 1 / 0)
    assert waits == [1, 2, 1, 3]


def test_lag_is_that_of_the_slowest_partition():
    assert lag_of([{"maxOffsetsBehindLatest": "7", "minOffsetsBehindLatest": "0"}, {}, None, {"maxOffsetsBehindLatest": "19"}]) == 19
    assert lag_of([{}]) is None
    progress = {"sources": [{"metrics": {"maxOffsetsBehindLatest": "5"}}, {"metrics": None}]}
    assert backlog(SimpleNamespace(lastProgress=progress)) == 5 and backlog(SimpleNamespace(lastProgress=None)) is None


def test_watch_adds_up_reports():
    def report(batch, rows, lag, dropped, n):
        return SimpleNamespace(progress=SimpleNamespace(
            name="s", batchId=batch, numInputRows=rows, processedRowsPerSecond=2.0 * rows,
            observedMetrics={"seen": SimpleNamespace(asDict=lambda: {"valid": n})},
            sources=[SimpleNamespace(metrics={"maxOffsetsBehindLatest": str(lag)})],
            stateOperators=[SimpleNamespace(numRowsTotal=10 * rows, customMetrics={"numDroppedDuplicateRows": dropped})]))

    watch = Watch()
    watch.onQueryStarted(SimpleNamespace(runId="r", name="s"))
    for event in (report(0, 5, 40, 1, 4), report(1, 7, 20, 2, 5), report(1, 7, 20, 2, 5)):  # the last is said twice
        watch.onQueryProgress(event)
    watch.onQueryTerminated(SimpleNamespace(runId="r", exception="gone"))
    standing = watch.streams["s"]
    assert (standing.input_rows, standing.lag, standing.refused, standing.remembered) == (12, 20, 3, 70)
    assert standing.totals == {"seen.valid": 9} and standing.error == "gone"
