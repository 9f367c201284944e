from datetime import timedelta

import pytest
from conftest import T0, utc

from footfall.params import (
    FunnelSpec,
    TimeRange,
    clamp,
    parse_dimension,
    parse_filters,
    parse_interval,
    parse_window,
)


@pytest.mark.parametrize("text, unit", [
    (None, "day"), ("", "day"), ("  ", "day"), ("HOUR", "hour"), ("week", "week"), (" Month ", "month"),
])
def test_interval(text, unit):
    assert parse_interval(text) == unit


@pytest.mark.parametrize("text", ["century", "day'; drop table x", "days"])
def test_interval_refused(text):
    with pytest.raises(ValueError, match="interval"):
        parse_interval(text)


@pytest.mark.parametrize("text, key", [
    (None, None), ("", None), ("eventType", None), ("EVENTTYPE", None),
    ("metadata.plan", "plan"), ("metadata.app.version", "app.version"),
])
def test_dimension(text, key):
    assert parse_dimension(text) == key


@pytest.mark.parametrize("text", [
    "organization_id", "metadata", "metadata.", "metadata.bad key", "metadata.plan'; DROP TABLE x", "METADATA.plan",
])
def test_dimension_refused(text):
    with pytest.raises(ValueError):
        parse_dimension(text)


def test_filters():
    assert parse_filters(None) == {}
    assert parse_filters(["plan:pro", "country:SE"]) == {"plan": "pro", "country": "SE"}
    assert parse_filters(["referrer:https://example.com/x"]) == {"referrer": "https://example.com/x"}
    assert parse_filters(["app.version:2.1", "utm-source:x"]) == {"app.version": "2.1", "utm-source": "x"}
    assert parse_filters(["plan:pro", "plan:free"]) == {"plan": "free"}
    assert parse_filters([f"k{n}:v" for n in range(20)])


@pytest.mark.parametrize("filters", [
    ["plan"], [":pro"], ["plan:"], [f"k{n}:v" for n in range(21)], ["x" * 65 + ":v"],
    ["a'b:v"], ["a b:v"], ["f(x):v"],
])
def test_filters_refused(filters):
    with pytest.raises(ValueError):
        parse_filters(filters)


@pytest.mark.parametrize("text, seconds, echo", [
    (None, 604_800, "7d"), (" ", 604_800, "7d"), ("30m", 1_800, "30m"), (" 24H ", 86_400, "1d"),
    ("5h", 18_000, "300m"), ("7d", 604_800, "7d"), ("365d", 31_536_000, "365d"), ("1440m", 86_400, "1d"),
])
def test_window(text, seconds, echo):
    spec = FunnelSpec.parse(["a", "b"], text)
    assert (spec.window_seconds, spec.window_text) == (seconds, echo)


@pytest.mark.parametrize("text", ["fortnight", "0d", "366d", "7", "d", "-1d", "1234567m", "1w", "7 d"])
def test_window_refused(text):
    with pytest.raises(ValueError, match="window"):
        parse_window(text)


@pytest.mark.parametrize("steps", [None, [], ["a"], ["a"] * 9, ["a", " "], ["a", None]])
def test_steps_refused(steps):
    with pytest.raises(ValueError, match="funnel"):
        FunnelSpec.parse(steps)


def test_range():
    now = TimeRange.resolve(None, None, now=T0)
    assert (now.start, now.end) == (T0 - timedelta(days=30), T0)
    assert TimeRange.resolve(None, "2026-05-01T02:00:00+02:00").end == T0
    assert TimeRange.resolve("2026-04-01", "2026-05-01").start == utc(2026, 4, 1)
    for start, end in ((T0, T0), (T0, T0 - timedelta(seconds=1))):
        with pytest.raises(ValueError, match="before"):
            TimeRange.resolve(start, end)


def test_clamp():
    assert [clamp(n, 50, 500) for n in (None, -1, 0, 1, 500, 501)] == [50, 1, 1, 1, 500, 500]
