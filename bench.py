"""Times the ingest stream and the headline queries; prints one JSON line.

The events of $BENCH_SF_DIR are sent as messages, stored by the ingest stream, and the
queries then read the stored table, as they do in service. Every query runs once to warm
up and then RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import functions as F  # noqa: E402

from footfall import operators as op  # noqa: E402
from footfall.operators.ingest import to_messages  # noqa: E402
from footfall.session import local_session  # noqa: E402
from footfall.sources.messages import MESSAGES, file_messages, write_files  # noqa: E402
from footfall.sources.sample_tables import sample_events, sample_organizations  # noqa: E402
from footfall.sources.store import Store  # noqa: E402
from footfall.streaming.ingest import consume  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
MONTH = ("2024-01-01", "2024-02-01")
STEPS = ["view", "signup", "purchase"]
TENANT = 1

QUERIES = {
    "timeseries_day": lambda e: op.time_series(e, TENANT, *MONTH),
    "timeseries_hour": lambda e: op.time_series(e, TENANT, *MONTH, interval="hour"),
    "breakdown_event_type": lambda e: op.breakdown(e, TENANT, *MONTH),
    "breakdown_plan": lambda e: op.breakdown(e, TENANT, *MONTH, group_by="metadata.plan"),
    "summary": lambda e: op.summary(e, TENANT, *MONTH),
    "summary_filter_5pct": lambda e: op.summary(e, TENANT, *MONTH, filters=["plan:enterprise"]),
    "summary_filter_85pct": lambda e: op.summary(e, TENANT, *MONTH, filters=["plan:free"]),
    "events_page": lambda e: op.events_page(e, TENANT, *MONTH),
    "event_types": lambda e: op.event_types(e, TENANT),
    "funnel_3step": lambda e: op.funnel(e, TENANT, STEPS, "7d", *MONTH),
}


def messages_of(events):
    numbered = to_messages(events).withColumn("offset", F.monotonically_increasing_id())
    return numbered.selectExpr(
        "key", "value", "'bench' as topic", "cast(key as int) as partition", "offset",
        "current_timestamp() as timestamp",
    )


def ingest(spark, root: Path, name: str, store: Store, organizations) -> float:
    stream = file_messages(spark, str(root / "messages"))
    started = time.perf_counter()
    consume(stream, lambda: organizations, store, name, str(root), availableNow=True).awaitTermination()
    return time.perf_counter() - started


def main() -> None:
    spark = local_session("bench", **{"spark.driver.memory": "16g"})
    root = Path(tempfile.mkdtemp(prefix="bench-", dir=os.environ.get("BENCH_DIR")))
    events, organizations = sample_events(spark, SF_DIR), sample_organizations(spark, SF_DIR)
    write_files(messages_of(events).repartition(8), str(root / "messages"))
    sent = spark.read.schema(MESSAGES).json(str(root / "messages")).count()

    warm = ingest(spark, root, "warm", Store(str(root / "warm")), organizations)
    store = Store(str(root / "store"))
    took = ingest(spark, root, "bench", store, organizations)
    stored = store.read(spark)
    persisted = stored.count()
    assert persisted == sent, (persisted, sent)

    times = {}
    for name, query in QUERIES.items():
        query(stored).collect()
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            query(stored).collect()
            runs.append(time.perf_counter() - started)
        times[name] = round(median(runs), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(SF_DIR).name.removeprefix("sf") or 0),
                "events": persisted,
                "ingest_persisted_per_sec": round(persisted / took, 1),
                "ingest_sec": round(took, 3),
                "ingest_cold_sec": round(warm, 3),
                "cpus": os.environ.get("BENCH_CPUS", "*"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
