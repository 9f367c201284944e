"""Trying again, and finding the records at fault where that does not help."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A batch with more parts at fault than this has another problem than single records.
MOST_FAULTS = 256


@dataclass
class BackOff:
    """Waits that grow from ``first`` seconds by ``factor``, ``most`` seconds in all."""

    first: float = 1.0
    factor: float = 2.0
    most: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    # What was waited for: (batch, attempt, seconds, error).
    ledger: list[tuple[str, int, float, str]] = field(default_factory=list)

    def run(self, name: str, step: Callable[[], None]) -> None:
        """Run ``step`` until it succeeds; its last error is raised when all waits are used up."""
        wait, left, attempt = self.first, self.most, 1
        while True:
            try:
                return step()
            except Exception as problem:
                if wait > left:
                    raise
                self.ledger.append((name, attempt, wait, _short(problem)))
            self.sleep(wait)
            wait, left, attempt = wait * self.factor, left - wait, attempt + 1


def _short(problem: Exception) -> str:
    return str(problem).strip().split("\n")[0][:500]


def store_each(
    batch: DataFrame,
    name: str,
    step: Callable[[DataFrame, str], None],
    reject: Callable[[DataFrame, str, str], None],
    back_off: BackOff,
    key: list[str],
) -> int:
    """``step(batch, name)``, with the records at fault left out of it and handed to ``reject``
    with the error; returns how many those are.

    The whole batch is tried with back-off first. If it keeps failing although the same step takes no
    rows at all, so that storage is there, the batch is cut into halves by a hash of the
    ``key`` columns, which name a record, and those that fail are cut again, down to single
    records. An outage raises and nothing is rejected. A part's ``name`` tells where it was cut, so a
    step may recognise a part that ran before.
    """
    try:
        back_off.run(name, lambda: step(batch, name))
        return 0
    except Exception as problem:
        step(batch.limit(0), f"{name}.none")
        return _search(batch, name, step, reject, F.xxhash64(*key), 0, problem, [0])


def _search(part, name, step, reject, place, depth, problem, faults) -> int:
    if part.limit(2).count() <= 1 or depth == 63:
        faults[0] += 1
        if faults[0] > MOST_FAULTS:
            raise RuntimeError(f"more than {MOST_FAULTS} records of {name} cannot be stored") from problem
        rows = part.count()
        reject(part, name, _short(problem))
        return rows
    found = 0
    for bit in (0, 1):
        half, half_name = part.where(F.shiftrightunsigned(place, depth).bitwiseAND(F.lit(1).cast("long")) == bit), f"{name}.{bit}"
        try:
            step(half, half_name)
        except Exception as again:
            found += _search(half, half_name, step, reject, place, depth + 1, again, faults)
    return found
