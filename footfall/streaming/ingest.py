"""Streams: requests become messages, messages become arrivals, and arrivals rows.

None has a watermark. Events may be backdated as far as their sender likes, and an id is
recognised again however old it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.times import instant
from footfall.operators.ingest import (
    KEY,
    POSITION,
    as_stored,
    attribute,
    audit_counts,
    decode,
    first_deliveries,
    error,
    from_messages,
    to_messages,
    unseen,
    validate,
    with_defaults,
    with_known_tenant,
)
from footfall.plans.skew import BROADCAST_ROWS
from footfall.schema import ARRIVALS, AUDIT, EVENTS, REQUEST
from footfall.session import check_session, checkpoint_location
from footfall.sources.store import Outbox, Store, at_once, finish_rewrite, replace_batch
from footfall.streaming.retry import BackOff, store_each

LETTER = ["topic", *POSITION, "key", "value", "timestamp", "reason"]

# Ids are kept in RocksDB and changes to them in a log, so a batch does not copy what is kept.
# The check of operators knows no sort inside a partition, which is what puts first things first.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.unsupportedOperationCheck": "false",
}


def accept(requests: DataFrame, organizations: DataFrame) -> DataFrame:
    """Requests with a tenant, event columns and ``errors``, which is empty if the
    request is accepted.

    ``requests`` has ``api_key`` and ``value`` next to the columns of a message.
    """
    checked = validate(decode(requests, REQUEST))
    owned = attribute(checked, organizations, spread_by=POSITION)
    stranger = F.array(error("api_key", "is missing or unknown"))
    errors = F.when(F.col("organization_id").isNull(), F.concat(stranger, "errors"))
    return with_defaults(
        owned.withColumn("errors", errors.otherwise(F.col("errors"))),
        source=["topic", *POSITION],
        arrived_at=F.col("timestamp"),
    )


def publish(
    requests: DataFrame,
    organizations: DataFrame,
    send: Callable[[DataFrame], None],
    outbox: Outbox,
    name: str = "requests",
    checkpoints: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Send accepted requests on as messages, keep the refused ones with their errors,
    and count both. An outage of the receiver fails the batch, and the batch runs again;
    what it had sent already is recognised by its ids when it is stored."""

    def run(batch: DataFrame, batch_id: int) -> None:
        judged = accept(batch, organizations).persist()
        try:
            accepted = F.size("errors") == 0
            send(to_messages(judged.where(accepted)))
            refused = judged.where(~accepted).select("topic", *POSITION, "value", "errors")
            counts = judged.agg(
                F.count(F.lit(1)).alias("received"), F.count_if(accepted).alias("published")
            )
            replace_batch(refused, outbox.refusals, f"{name}-{batch_id:012d}")
            replace_batch(counts, outbox.audit, f"{name}-{batch_id:012d}")
        finally:
            judged.unpersist()

    place = checkpoint_location(requests.sparkSession, name, outbox.root, checkpoints)
    return _start(requests, run, name, place, trigger)


def consume(
    messages: DataFrame,
    organizations: Callable[[], DataFrame],
    store: Store,
    name: str = "events",
    checkpoints: str | None = None,
    back_off: BackOff | None = None,
    **trigger: object,
) -> Ingest:
    """Store messages, each id once per tenant, and account for every one of them.

    Two streams: :func:`admit` judges messages and passes the valid ones on as arrivals,
    :func:`remember` stores those whose id is new. ``organizations`` is called for each batch, so
    that new tenants are seen.
    """
    spark = messages.sparkSession
    check_session(spark)
    prepare(spark, store, name, checkpoints)
    first = admit(messages, organizations, store, name, checkpoints, back_off, **trigger)
    return Ingest(first, lambda: remember(spark, store, name, checkpoints, **trigger), "availableNow" in trigger)


class Ingest:
    """The two streams as one. With ``availableNow`` the second starts when the first is done."""

    def __init__(self, admitting: StreamingQuery, start_storing: Callable[[], StreamingQuery], in_turn: bool):
        self.admitting, self._start = admitting, start_storing
        self.storing = None if in_turn else start_storing()

    def awaitTermination(self) -> None:
        """Until both have ended. One that fails stops the other: messages that are not stored
        must not pile up unseen."""
        try:
            if self.storing is None:
                self.admitting.awaitTermination()
                self.storing = self._start()
            while not (self.storing.awaitTermination(1) or self.admitting.exception()):
                pass
            self.admitting.awaitTermination()
        finally:
            self.stop()

    def processAllAvailable(self) -> None:
        self.admitting.processAllAvailable()
        self.storing.processAllAvailable()

    def stop(self) -> None:
        for query in filter(None, (self.admitting, self.storing)):
            query.stop()

    @property
    def lastProgress(self):
        return self.admitting.lastProgress


def admit(
    messages: DataFrame,
    organizations: Callable[[], DataFrame],
    store: Store,
    name: str = "events",
    checkpoints: str | None = None,
    back_off: BackOff | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Judge messages: valid ones become arrivals, rejected ones dead letters, all are counted.

    A batch that keeps failing for its data is cut down to the records at fault, which go to the
    dead letters; an outage fails the stream.
    """
    spark = messages.sparkSession
    place = checkpoint_location(spark, f"{name}-admit", store.root, checkpoints)
    wait = back_off or BackOff()
    name_of = _batch_names(spark, name, place)

    def run(batch: DataFrame, batch_id: int) -> None:
        def reject(rows: DataFrame, part: str, why: str) -> None:
            letters = rows.withColumn("reason", F.lit(f"cannot be stored: {why}"))
            store.add_dead_letters(letters.select(LETTER), part.split(".")[0])
            number = rows.count()
            add_counts(spark, store, f"{part}.rejected", received=number, rejected=number)

        step = lambda rows, part: admit_batch(rows, organizations(), store, part)
        store_each(batch, name_of(batch_id), step, reject, wait, ["topic", *POSITION])

    return _start(messages, run, f"{name}-admit", place, trigger)


def admit_batch(messages: DataFrame, organizations: DataFrame, store: Store, batch: str) -> None:
    """Write the arrivals, dead letters and counts of one batch, which is read once.

    It may run again: arrivals are told apart by their ids, letters by their position and
    counts by the batch. The counts come last, so they are there only if all else is.
    """
    spark = messages.sparkSession
    seen = Observation(f"admitted {batch}")
    outcome = F.col("outcome")
    # Counted by the tasks that write; no shuffle comes after this.
    classified = classify(messages, organizations).observe(
        seen,
        F.count(F.lit(1)).alias("received"),
        F.count_if(outcome == "invalid").alias("invalid"),
        F.count_if(outcome == "rejected").alias("rejected"),
        F.count_if(outcome == "valid").alias("valid"),
    )
    arrivals = classified.where(outcome != "invalid").withColumns(
        {
            "kind": F.when(outcome == "valid", "event").otherwise("rejected"),
            "value": F.when(outcome == "rejected", F.col("value")),
            "arrived_in": F.lit(batch),
        }
    )
    _as_arrivals(arrivals).write.mode("append").parquet(f"{store.arrivals}/messages")
    counts = seen.get
    if counts.get("rejected"):
        mine = (F.col("arrived_in") == batch) & (F.col("kind") == "rejected")
        letters = spark.read.schema(ARRIVALS).parquet(f"{store.arrivals}/messages").where(mine)
        store.add_dead_letters(letters.select(LETTER), batch.split(".")[0])
    if counts.get("received"):
        add_counts(spark, store, batch, **counts)


def add_counts(spark: SparkSession, store: Store, batch: str, **counts: int) -> None:
    """Send a batch's numbers after its arrivals; who stores those accounts for the batch."""
    row = spark.createDataFrame([(batch, "counts", batch)], "event_id string, kind string, arrived_in string")
    row = row.withColumns({name: F.lit(number).cast("long") for name, number in counts.items()})
    _as_arrivals(row).coalesce(1).write.mode("append").parquet(f"{store.arrivals}/counts")


def _as_arrivals(rows: DataFrame) -> DataFrame:
    return rows.select(
        *(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ARRIVALS))


def prepare(spark: SparkSession, store: Store, name: str, checkpoints: str | None = None) -> None:
    """Before the streams run without a checkpoint, for the first time or because it was lost:
    write down the ids that the table holds, and the batches that the audit holds, which they take
    into their state. The folders of arrivals must exist for a stream to read them."""
    place = checkpoint_location(spark, f"{name}-remember", store.root, checkpoints)

    def folder(path: str) -> None:
        _as_arrivals(spark.createDataFrame([], "kind string")).coalesce(1).write.mode("ignore").parquet(path)

    def know() -> None:
        if _checkpoint_id(spark, place) is None:
            finish_rewrite(spark, store)
            accounted = store.accounted(spark).select(F.lit(None).cast("long").alias(KEY[0]), KEY[1])
            known = store.read(spark).select(KEY).unionByName(accounted).withColumn("kind", F.lit("known"))
            _as_arrivals(known).write.mode("overwrite").parquet(f"{store.known}/{name}")

    at_once(know, lambda: folder(f"{store.arrivals}/messages"), lambda: folder(f"{store.arrivals}/counts"))


def remember(
    spark: SparkSession,
    store: Store,
    name: str = "events",
    checkpoints: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Store the arrivals whose id is new, first delivered first.

    The ids seen are the state of the stream, so a batch costs what it holds and not what the
    table holds. The table is read by the first batch of a run only, which may have been
    interrupted before, and then in the dates of that batch. The number of shuffle partitions at
    the very first run stays that of the state. Arrivals are deleted once they are stored.
    """
    place = checkpoint_location(spark, f"{name}-remember", store.root, checkpoints)

    def stream(folder: str, clean: str) -> DataFrame:
        options = {"ignoreMissingFiles": "true", "cleanSource": clean}
        return spark.readStream.schema(ARRIVALS).options(**options).parquet(folder)

    events = stream(f"{store.arrivals}/messages", "delete").where("kind = 'event'")
    counts = stream(f"{store.arrivals}/counts", "delete").where("kind = 'counts'")
    arrivals = events.unionAll(counts).unionAll(stream(f"{store.known}/{name}", "off"))
    # Of one id, what is stored already comes before what is new, and then the first delivery.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [(F.col("kind") == "known").desc(), F.col("arrived_in"), *map(F.col, POSITION)]
    once = arrivals.repartition(parts, *KEY).sortWithinPartitions(*order).dropDuplicates(KEY)
    begun: list[int] = []
    name_of = _batch_names(spark, name, place)

    def run(batch: DataFrame, batch_id: int) -> None:
        again = not begun
        begun.append(batch_id)
        batch.persist()
        try:
            store_arrivals(batch.where("kind <> 'known'"), store, name_of(batch_id), again)
        finally:
            batch.unpersist()

    return _start(once, run, f"{name}-remember", place, trigger, STATE_SETTINGS)


def store_arrivals(new: DataFrame, store: Store, batch: str, again: bool) -> None:
    """Store one batch of events with new ids. ``again``: it may have run before, whole or in
    part, so what the table holds of it is looked up in the dates it touches."""
    spark = new.sparkSession
    numbers = ["received", "invalid", "rejected", "valid"]
    # Reads every row of the batch, which is kept from here on.
    at = F.unix_micros("occurred_at")
    sums = new.agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers),
        F.min(at).alias("low"),
        F.max(at).alias("high"),
        F.count_if(F.col("kind") == "event").alias("events"),
        F.collect_list(F.when(F.col("kind") == "counts", F.col("event_id"))).alias("admitted"),
    ).first()
    if not sums.received and not sums.events:
        return
    rows = as_stored(new.where("kind = 'event'")).select(EVENTS.names)
    mine = of_batch(spark, store, batch, sums.low, sums.high) if again and sums.events else None
    if mine is None or mine.isEmpty():
        store.append(rows, batch)
    else:
        store.append(rows.join(mine, KEY, "left_anti").select(EVENTS.names), batch, rows)
    audit = spark.createDataFrame([(sums.received, sums.invalid, sums.rejected, sums.events, sums.valid - sums.events)], AUDIT)
    store.add_audit(audit, batch, sums.admitted)


def of_batch(spark: SparkSession, store: Store, batch: str, low: int, high: int) -> DataFrame:
    """What the table holds of a batch whose times lie between two, in microseconds."""
    first, last = (F.to_date(instant(at)) for at in (low, high))
    mine = (F.col("ingest_batch") == batch) & F.col("event_date").between(first, last)
    return store.read(spark).where(mine).select(EVENTS.names)


def store_batch(messages: DataFrame, organizations: DataFrame, store: Store, batch: str) -> None:
    """Store one batch without a stream, as in a load: ids are looked up in the table.

    Running it again, whole or after a crash half-way, leaves the same rows, dead letters and
    audit. Its cost follows the table; a stream's does not, see :func:`consume`.
    """
    spark = messages.sparkSession
    finish_rewrite(spark, store)
    classified = classify(messages, organizations).persist()
    try:
        valid = classified.where(F.col("outcome") == "valid")
        at = F.unix_micros("occurred_at")
        sums = valid.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(at), F.lit(0)).alias("low"), F.coalesce(F.max(at), F.lit(0)).alias("high")).first()
        if sums.n:
            new = unseen(first_deliveries(valid), store.read(spark), keys=valid, small=sums.n <= BROADCAST_ROWS)
            fresh = as_stored(new).select(EVENTS.names).persist()
            # Looked up before the rows of this run are there.
            before = of_batch(spark, store, batch, sums.low, sums.high)
            store.append(fresh, batch, before.unionByName(fresh))
            fresh.unpersist()
        rejected = classified.where(F.col("outcome") == "rejected")
        if not rejected.isEmpty():
            store.add_dead_letters(rejected.select(LETTER), batch)
        # Counted in the table and not while writing: after a crash the second run
        # writes only what the first did not.
        counts = audit_counts(classified, F.lit(of_batch(spark, store, batch, sums.low, sums.high).count()))
        store.add_audit(counts.where("received > 0"), batch)
    finally:
        classified.unpersist()


def classify(messages: DataFrame, organizations: DataFrame) -> DataFrame:
    """Messages as event columns with ``outcome`` and ``reason``; one of an unknown
    tenant is rejected by itself and not along with its batch."""
    rows = with_known_tenant(from_messages(messages), organizations, spread_by=POSITION)
    homeless = (F.col("outcome") == "valid") & ~F.col("known_tenant")
    return rows.withColumns(
        {
            "outcome": F.when(homeless, "rejected").otherwise(F.col("outcome")),
            "reason": F.when(homeless, "unknown organization").otherwise(F.col("reason")),
        }
    ).drop("known_tenant")


def _checkpoint_id(spark: SparkSession, place: str) -> str | None:
    """What tells a checkpoint from one that was lost; None where there is none."""
    try:
        return json.loads(spark.read.text(f"{place}/metadata").first()[0])["id"][:8]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _batch_names(spark: SparkSession, name: str, place: str) -> Callable[[int], str]:
    """Names that no two batches share, also where a checkpoint was lost and numbers begin anew."""
    own: list[str] = []

    def name_of(batch_id: int) -> str:
        if not own:
            own.append(_checkpoint_id(spark, place))
        return f"{name}-{own[0]}-{batch_id:012d}"

    return name_of


def _start(stream, run, name, checkpoints, trigger, settings=None) -> StreamingQuery:
    spark = stream.sparkSession
    check_session(spark)
    # A query keeps the settings that hold when it starts.
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        return (
            stream.writeStream.queryName(name)
            .foreachBatch(run)
            .option("checkpointLocation", checkpoints)
            .trigger(**(trigger or {"processingTime": "10 seconds"}))
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
