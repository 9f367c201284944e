"""Joins whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is split from this many rows on, into as many parts as it has times that many.
HEAVY_ROWS = 1_000_000
# Rows of a lookup side that may be sent to every executor, some 100 MB at most.
BROADCAST_ROWS = 500_000


def survey(
    rows: DataFrame, key: Column, heavy_rows: int | None = None
) -> tuple[int, DataFrame | None]:
    """How many rows there are, and the keys with ``heavy_rows`` or more of them (HEAVY_ROWS
    by default): ``(heavy_key, parts)``, or None if there is no such key, as is usual.

    Rows are counted per key, in partial counts first, and no list of keys reaches the driver.
    There are at most ``rows / heavy_rows`` heavy keys.
    """
    least = HEAVY_ROWS if heavy_rows is None else heavy_rows
    counts = rows.groupBy(key.alias("heavy_key")).agg(F.count(F.lit(1)).alias("held"))
    most = F.max(F.when(F.col("heavy_key").isNotNull(), F.col("held")))
    total, largest = counts.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(most, F.lit(0))).first()
    if largest < least:
        return total, None
    heavy = counts.where((F.col("held") >= least) & F.col("heavy_key").isNotNull())
    parts = F.ceil(F.col("held") / least).cast("int")
    return total, heavy.select("heavy_key", parts.alias("parts"))


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: list[str],
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on a string ``key`` that is unique in ``right``.

    Left rows without a key match nothing; hashed as they are they would all meet in
    one task, so they travel under a stand-in key made from ``spread_by``. The rows of
    a ``heavy`` key are dealt out in its parts, and its single right row is repeated for
    each of them.
    """
    scattered = F.xxhash64(*spread_by)
    left_side = {
        "_key": F.coalesce(F.col(key), scattered.cast("string")),
        "_keyed": F.col(key).isNotNull(),
    }
    right = right.withColumnRenamed(key, "_right_key")
    match = (F.col("_key") == F.col("_right_key")) & F.col("_keyed")
    if heavy is not None:
        # One short row for each HEAVY_ROWS rows of the left side, at most.
        named = F.broadcast(heavy)
        left = left.join(named, F.col(key) == F.col("heavy_key"), "left").drop("heavy_key")
        left_side["_salt"] = F.coalesce(F.pmod(scattered, F.col("parts")), F.lit(0).cast("long"))
        right = right.join(named, F.col("_right_key") == F.col("heavy_key"), "left").drop("heavy_key")
        every_salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
        right = right.select("*", every_salt.alias("_right_salt")).drop("parts")
        match &= F.col("_salt") == F.col("_right_salt")
    return (
        left.withColumns(left_side)
        .join(right, match, "left")
        .drop("_key", "_keyed", "_right_key", "_salt", "_right_salt", "parts")
    )


def fits_broadcast(rows: DataFrame, most: int | None = None) -> bool:
    """Whether ``rows`` is small enough to broadcast. Counted, as an estimate may err."""
    return rows.count() <= (BROADCAST_ROWS if most is None else most)


def lookup(
    left: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: list[str],
    broadcast_rows: int | None = None,
) -> DataFrame:
    """LEFT JOIN with a dimension: broadcast if its counted size allows, else spread."""
    if fits_broadcast(dimension, broadcast_rows):
        return left.join(F.broadcast(dimension), key, "left")
    _, heavy = survey(left, F.col(key))
    return spread_left_join(left, dimension, key, spread_by, heavy)


def known(
    rows: DataFrame, keys: DataFrame, on: list[str], small: bool | None = None
) -> DataFrame:
    """Those of ``keys`` that occur in the far larger ``rows``.

    A small ``keys`` is broadcast, and ``rows`` is read in place and not shuffled.
    Beyond that both sides are shuffled; Catalyst may then filter ``rows`` by a Bloom
    filter of the keys first.
    """
    keys = keys.select(on)
    if fits_broadcast(keys) if small is None else small:
        keys = F.broadcast(keys)
    return rows.select(on).join(keys, on, "left_semi")
