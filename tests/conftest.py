import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from footfall.schema import EVENTS  # noqa: E402
from footfall.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # The JVM runs in another zone than UTC, so that a bucket cut in local time shows.
    session = local_session(
        "tests",
        cores="8",
        **{
            "spark.driver.memory": "8g",
            "spark.driver.extraJavaOptions": "-Duser.timezone=Asia/Kolkata",
        },
    )
    yield session
    session.stop()


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


T0 = utc(2026, 5, 1)
SPAN = {"start": utc(2026, 4, 1), "end": utc(2026, 6, 1)}


class EventMaker:
    """Builds event tables row by row, each row with its own id."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = []

    def add(self, event_type="page_view", after=timedelta(0), actor=None, user=None, org=1,
            metadata="{}", at=None, event_id=None):
        at = at or T0 + after
        number = len(self.rows)
        self.rows.append((
            event_id or f"00000000-0000-0000-0000-{number:012d}", org, event_type, at,
            at + timedelta(seconds=1), metadata, user, actor, user or actor,
        ))
        return self

    def table(self):
        return self.spark.createDataFrame(self.rows, EVENTS)


@pytest.fixture
def make(spark):
    return EventMaker(spark)
