"""One folder with everything the ingest keeps, each part a plain Parquet table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators.ingest import POSITION
from footfall.operators.maintenance import without
from footfall.operators.partials import daily_counts, daily_links
from footfall.schema import AUDIT, BATCH_AUDIT, DAILY, LETTERS, LINKS, NOBODY, STORED_EVENTS
from footfall.sources.events import append_events, read_events, write_dates


def read_table(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """A Parquet table; one that was never written to is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def at_once(*jobs) -> list:
    """What the jobs give; they are small and wait for storage, so they run side by side."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [result.result() for result in [pool.submit(job) for job in jobs]]


@dataclass(frozen=True)
class Store:
    """Events, what is added up from them by day, dead letters and the audit, below ``root``.

    The tables have one writer at a time: one ingest stream, or one rewrite while the stream
    is stopped. A rewrite is Spark's dynamic overwrite of the dates it touches, from a table
    that holds what those dates will be. While that has begun and is not finished, readers take
    these dates from that table, so they see the rows after the rewrite and never a part of
    them; the next writer finishes it.
    """

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def daily(self) -> str:
        return f"{self.root}/daily"

    @property
    def links(self) -> str:
        return f"{self.root}/links"

    @property
    def arrivals(self) -> str:
        return f"{self.root}/arrivals"

    @property
    def known(self) -> str:
        return f"{self.root}/known"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    @property
    def rewrite(self) -> str:
        return f"{self.root}/rewrite"

    def pending(self, spark: SparkSession) -> DataFrame | None:
        """What a rewrite that has begun and not ended puts in place of the dates in it."""
        state = read_table(spark, "pending boolean", f"{self.rewrite}/state").first()
        return spark.read.schema(STORED_EVENTS).parquet(f"{self.rewrite}/rows") if state and state.pending else None

    def _current(self, spark: SparkSession, stored: DataFrame, instead) -> DataFrame:
        pending = self.pending(spark)
        if pending is not None:
            dates = pending.select("event_date").distinct()
            stored = stored.join(dates, "event_date", "left_anti").unionByName(instead(pending))
        # Stands in for the rows of a date that has none left.
        return stored.where(F.col("organization_id") != NOBODY)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._current(spark, read_events(spark, self.events), lambda rows: rows)

    def read_daily(self, spark: SparkSession) -> DataFrame:
        """Counts and last times by tenant, type and day, as batches added them."""
        return self._current(spark, read_table(spark, DAILY, self.daily), daily_counts)

    def read_links(self, spark: SparkSession) -> DataFrame:
        """Earliest links of anonymous ids by tenant and day, as batches added them."""
        return self._current(spark, read_table(spark, LINKS, self.links), daily_links)

    def read_audit(self, spark: SparkSession) -> DataFrame:
        """One row for each batch, however often it ran."""
        rows = read_table(spark, BATCH_AUDIT, self.audit)
        return rows.groupBy("ingest_batch").agg(*(F.max(name).alias(name) for name in AUDIT.names)).select(AUDIT.names)

    def read_dead_letters(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, LETTERS, self.dead_letters).dropDuplicates(["ingest_batch", "topic", *POSITION])

    def append(self, events: DataFrame, ingest_batch: str, of_batch: DataFrame | None = None) -> None:
        """Add a batch's rows, and what they add to the days they belong to.

        ``of_batch`` are all rows of the batch where part of them is stored already.
        """
        finish_rewrite(events.sparkSession, self)
        whole = events if of_batch is None else of_batch
        at_once(
            lambda: append_events(events, self.events, ingest_batch),
            lambda: _by_date(daily_counts(whole.withColumn("ingest_batch", F.lit(ingest_batch))), self.daily),
            lambda: _by_date(daily_links(whole), self.links),
        )

    def accounted(self, spark: SparkSession) -> DataFrame:
        """The batches of messages that are in the audit, by name."""
        rows = read_table(spark, BATCH_AUDIT, self.audit)
        return rows.select(F.explode("admitted").alias("event_id")).distinct()

    def add_audit(self, counts: DataFrame, ingest_batch: str, admitted: list[str] | None = None) -> None:
        """A row for the batch; its numbers are the same if it runs again."""
        named = F.array(*map(F.lit, admitted or ())).cast("array<string>")
        row = counts.withColumns({"ingest_batch": F.lit(ingest_batch), "admitted": named}).select(BATCH_AUDIT.names)
        row.coalesce(1).write.mode("append").parquet(self.audit)

    def add_dead_letters(self, letters: DataFrame, ingest_batch: str) -> None:
        """Folders grow with days; a batch that runs again adds what readers count once."""
        days = F.coalesce(F.to_date("timestamp"), F.current_date())
        rows = letters.withColumns({"ingest_batch": F.lit(ingest_batch), "day": days})
        rows.write.mode("append").partitionBy("day").parquet(self.dead_letters)


@dataclass(frozen=True)
class Outbox:
    """What the publishing stream keeps below ``root``: refused requests and counts."""

    root: str

    @property
    def refusals(self) -> str:
        return f"{self.root}/refusals"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"


def replace_batch(rows: DataFrame, folder: str, batch: str) -> None:
    """Write the rows of one micro-batch, if there are any; running it again replaces them."""
    if rows.isEmpty():
        return
    rows.write.mode("overwrite").parquet(f"{folder}/ingest_batch={batch}")


def _by_date(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Sums are dealt out by date before they are written, so that a date gets one file, and more
    only where it is very large. Put into one task instead, all partitions of the aggregation would
    keep their buffers in that task until it ends."""
    # Streams run without adaptive execution, and without it the hint does nothing.
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    dealt = rows.hint("rebalance", "event_date") if adaptive else rows.repartition("event_date")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def delete_events(spark: SparkSession, store: Store, doomed: Column) -> int:
    """Delete the rows for which ``doomed`` holds; returns the number of dates rewritten.

    Only dates that hold such rows are rewritten. A deletion that was interrupted has either
    had no effect yet or is finished by whoever writes next; it may be called again.
    """
    finish_rewrite(spark, store)
    touched = store.read(spark).where(doomed).select("event_date").distinct()
    return _rewrite(spark, store, touched, doomed)


def compact_events(spark: SparkSession, store: Store, dates: Column) -> int:
    """Put the many files that micro-batches left in some dates into few sorted ones, and what
    they added to those days into one row for each key.

    ``dates`` is a condition on ``event_date``.
    """
    finish_rewrite(spark, store)
    touched = store.read(spark).where(dates).select("event_date").distinct()
    return _rewrite(spark, store, touched, F.lit(False))


def _rewrite(spark: SparkSession, store: Store, dates: DataFrame, doomed: Column) -> int:
    """What the dates will hold is written beside the table first; from the moment that this is
    marked as begun it counts, and putting it in place may be repeated until it is done."""
    dates.write.mode("overwrite").parquet(f"{store.rewrite}/dates")
    listed = spark.read.schema("event_date date").parquet(f"{store.rewrite}/dates")
    number = listed.count()
    if number:
        stay = store.read(spark).join(listed, "event_date", "left_semi")
        # One row for each date, so that a date without any other is overwritten, too.
        midnight = F.col("event_date").cast("timestamp")
        stand_ins = {"event_id": F.lit(""), "organization_id": F.lit(NOBODY), "event_type": F.lit(""), "occurred_at": midnight,
                     "received_at": midnight, "metadata": F.lit("{}")}
        empty = listed.withColumns(stand_ins | {
            name: F.lit(None).cast("string") for name in ("user_id", "anonymous_id", "actor_id", "ingest_batch")})
        rows = without(stay, doomed).select(STORED_EVENTS.names).unionByName(empty.select(STORED_EVENTS.names))
        rows.write.mode("overwrite").parquet(f"{store.rewrite}/rows")
        _mark(spark, store, True)
        finish_rewrite(spark, store)
    return number


def _mark(spark: SparkSession, store: Store, pending: bool) -> None:
    """An overwrite that stops half-way leaves no mark, which is right both before the first
    date is touched and after the last."""
    spark.createDataFrame([(pending,)], "pending boolean").coalesce(1).write.mode("overwrite").parquet(f"{store.rewrite}/state")


def finish_rewrite(spark: SparkSession, store: Store) -> None:
    """Put in place what a rewrite has prepared, if there is such; may be repeated."""
    rows = store.pending(spark)
    if rows is None:
        return
    write_dates(rows, store.events)
    # As one batch, so that days whose batches were added up are not added twice.
    _by_date(daily_counts(rows.withColumn("ingest_batch", F.lit("rewritten"))), store.daily, "overwrite")
    _by_date(daily_links(rows), store.links, "overwrite")
    _mark(spark, store, False)


def fold_dead_letters(spark: SparkSession, store: Store, days: Column) -> None:
    """Put the files of closed days into few. ``days`` is a condition on ``day``; a day must
    not get any more letters, or wait for the next fold, while it is folded."""
    rows = store.read_dead_letters(spark).where(days)
    folder = f"{store.rewrite}/dead_letters"
    rows.write.mode("overwrite").parquet(folder)
    spark.read.schema(rows.schema).parquet(folder).hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(store.dead_letters)
