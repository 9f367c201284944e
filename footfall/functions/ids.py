"""Event ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
DASHES = r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$"


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def derived_id(*position: Column) -> Column:
    """An id fixed by where a record came from.

    A random id would be drawn again when a micro-batch is retried, and the retry
    would then store the event a second time.
    """
    digest = F.sha2(F.concat_ws("|", *(part.cast("string") for part in position)), 256)
    return F.regexp_replace(digest, DASHES, "$1-$2-$3-$4-$5")
