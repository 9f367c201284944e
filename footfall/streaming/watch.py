"""What the streams report of themselves: how far behind they are, and what they counted."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Standing:
    """The last report of one stream, and what its reports add up to."""

    batch_id: int = -1
    input_rows: int = 0
    rows_per_second: float = 0.0
    lag: int | None = None
    # Rows that the state holds, and duplicates it has refused.
    remembered: int = 0
    refused: int = 0
    totals: dict[str, int] = field(default_factory=dict)
    error: str | None = None


class Watch(StreamingQueryListener):
    """Keeps a :class:`Standing` for every named stream of a session.

    Reports come after a batch is done and are kept in the driver only: they are for gauges and
    alarms, the audit table for accounts. Values observed under a name (``DataFrame.observe``)
    add up in ``totals``.
    """

    def __init__(self) -> None:
        self.streams: dict[str, Standing] = {}
        self._names: dict[str, str] = {}
        self._lock = threading.Lock()

    def attach(self, spark: SparkSession) -> Watch:
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._names[str(event.runId)] = event.name
            self.streams.setdefault(event.name, Standing()).error = None

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            standing = self.streams.setdefault(progress.name, Standing())
            if progress.batchId > standing.batch_id:
                standing.input_rows += progress.numInputRows
                for name, row in progress.observedMetrics.items():
                    for column, value in row.asDict().items():
                        key = f"{name}.{column}"
                        standing.totals[key] = standing.totals.get(key, 0) + (value or 0)
                standing.refused += sum(
                    int(op.customMetrics.get("numDroppedDuplicateRows", 0)) for op in progress.stateOperators)
            standing.batch_id = progress.batchId
            standing.rows_per_second = progress.processedRowsPerSecond
            standing.lag = lag_of(source.metrics for source in progress.sources)
            standing.remembered = sum(op.numRowsTotal for op in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            name = self._names.pop(str(event.runId), None)
            if name is not None and event.exception:
                self.streams[name].error = event.exception


def lag_of(metrics) -> int | None:
    """How many messages the slowest topic partition is behind, if a source tells."""
    found = [m.get("maxOffsetsBehindLatest") for m in metrics if m]
    known = [int(lag) for lag in found if lag is not None]
    return max(known) if known else None
