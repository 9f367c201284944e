"""Checks on caller parameters. Everything here raises before a Spark job starts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from footfall.functions.text import is_blank, trim_controls

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICROSECOND = timedelta(microseconds=1)

# Fixed values of the query interface.
INTERVALS = ("hour", "day", "week", "month")
DEFAULT_RANGE = timedelta(days=30)
METADATA_KEY = re.compile(r"[a-zA-Z0-9_.\-]{1,64}")
MAX_FILTERS = 20
MIN_STEPS, MAX_STEPS = 2, 8
WINDOW = re.compile(r"([0-9]{1,6})([mhd])")
WINDOW_UNITS = {"m": 60, "h": 3_600, "d": 86_400}
DEFAULT_WINDOW_SECONDS = 7 * 86_400
MAX_WINDOW_SECONDS = 365 * 86_400
BREAKDOWN_LIMIT, MAX_BREAKDOWN_LIMIT = 50, 500
PAGE_LIMIT, MAX_PAGE_LIMIT = 100, 1000

Instant = datetime | str


def as_utc(value: Instant) -> datetime:
    """Read an instant; one without a zone is taken as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def as_micros(value: datetime) -> int:
    return (value - EPOCH) // MICROSECOND


@dataclass(frozen=True)
class TimeRange:
    """Half-open range: `start` belongs to it, `end` does not."""

    start: datetime
    end: datetime

    @classmethod
    def resolve(
        cls, start: Instant | None, end: Instant | None, now: Instant | None = None
    ) -> TimeRange:
        last = as_utc(end if end is not None else now or datetime.now(timezone.utc))
        first = as_utc(start) if start is not None else last - DEFAULT_RANGE
        if first >= last:
            raise ValueError("the start of a range must be before its end")
        return cls(first, last)

    @property
    def start_micros(self) -> int:
        return as_micros(self.start)

    @property
    def end_micros(self) -> int:
        return as_micros(self.end)


def parse_interval(text: str | None) -> str:
    if is_blank(text):
        return "day"
    unit = trim_controls(text).lower()
    if unit not in INTERVALS:
        raise ValueError(f"interval {text!r} is not one of {', '.join(INTERVALS)}")
    return unit


def check_key(key: str) -> str:
    if not METADATA_KEY.fullmatch(key):
        raise ValueError(f"metadata key {key!r} does not match {METADATA_KEY.pattern}")
    return key


def parse_dimension(text: str | None) -> str | None:
    """The metadata key to group by, or None for the event type."""
    if is_blank(text) or text.lower() == "eventtype":
        return None
    prefix, dot, key = text.partition(".")
    if prefix == "metadata" and dot:
        return check_key(key)
    raise ValueError(f"groupBy {text!r} is neither 'eventType' nor 'metadata.<key>'")


def parse_filters(filters: Iterable[str] | None) -> dict[str, str]:
    """``["plan:pro", "country:SE"]`` as a mapping; the last value of a key counts."""
    given = list(filters or ())
    if len(given) > MAX_FILTERS:
        raise ValueError(f"{len(given)} filters given, at most {MAX_FILTERS} allowed")
    wanted: dict[str, str] = {}
    for text in given:
        key, _, value = text.partition(":")
        if not key or not value:
            raise ValueError(f"filter {text!r} is not of the form key:value")
        wanted[check_key(key)] = value
    return wanted


@dataclass(frozen=True)
class FunnelSpec:
    steps: tuple[str, ...]
    window_seconds: int

    @classmethod
    def parse(cls, steps: Sequence[str] | None, window: str | None = None) -> FunnelSpec:
        steps = tuple(steps or ())
        if not MIN_STEPS <= len(steps) <= MAX_STEPS:
            raise ValueError(
                f"a funnel has {MIN_STEPS} to {MAX_STEPS} steps, {len(steps)} given"
            )
        if any(is_blank(step) for step in steps):
            raise ValueError("a funnel step must name an event type")
        return cls(steps, parse_window(window))

    @property
    def window_micros(self) -> int:
        return self.window_seconds * 1_000_000

    @property
    def window_text(self) -> str:
        """Whole days as days, anything else as minutes."""
        days, rest = divmod(self.window_seconds, 86_400)
        return f"{self.window_seconds // 60}m" if rest else f"{days}d"


def parse_window(text: str | None) -> int:
    """``30m``, ``24h`` or ``7d`` in seconds."""
    if is_blank(text):
        return DEFAULT_WINDOW_SECONDS
    found = WINDOW.fullmatch(trim_controls(text).lower())
    if not found:
        raise ValueError(f"window {text!r} is not a number followed by m, h or d")
    seconds = int(found[1]) * WINDOW_UNITS[found[2]]
    if not 0 < seconds <= MAX_WINDOW_SECONDS:
        raise ValueError(f"window {text!r} must be more than zero and at most 365d")
    return seconds


def clamp(value: int | None, default: int, highest: int) -> int:
    return default if value is None else max(1, min(value, highest))
