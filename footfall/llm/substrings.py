"""Substring dedup: passages that occur earlier are cut out, word by word.

Seed: of the ``SEED``-word runs in a window, the one with the smallest hash is the window's
anchor, so equal windows have the same anchor at the same place, whatever surrounds them.
Neighbouring windows with one anchor occurrence form a block. Extend: occurrences of an anchor
are joined by the whole block, that is, by the anchor extended both ways as far as its windows
reach; all but the first occurrence of a block are repeats. Blocks that share an anchor but
differ are where a repeat begins or ends; there the anchor is extended window by window. The
union of all repeated windows is the set of maximal repeats.

Equality is by two 64-bit hashes of the words, computed apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Ranges, WordHashes, batches, by_id, cells, mixed, rolled, small_batches, written

WINDOW = 20
SEED = 8
# One document in so many is asked which anchors are frequent. An anchor counts as frequent
# from so many finds, and from that share of all finds, so that the list stays bounded.
SURVEY, SURVEY_LEAST, SURVEY_SHARE = 64, 32, 20_000

FOUND = "doc_id long, start long, windows int, one long, two long, repeat boolean"


def anchored_blocks(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of windows, anchor hashes and block hashes of a document's blocks."""
    grams = rolled(hashes, seed)
    place = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(axis=1)
    at = place + np.arange(len(place))
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    windows = np.diff(np.concatenate((starts, [len(at)])))
    whole = Ranges(hashes).of(starts, starts + windows + window - 1)
    return starts, windows, grams[at[starts]], whole


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that begins at ``starts``."""
    other = Ranges(mixed(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    return Ranges(hashes).of(starts, starts + window), other.of(starts, starts + window)


def _found(parts: list[tuple], names: str = FOUND) -> pa.RecordBatch:
    """Rows of ``(doc_id, starts, windows, one, two)``; all but the earliest of a key in this
    batch are marked as repeats already, so that few rows of a frequent key travel by it."""
    columns = [np.concatenate([np.asarray(p[i]) for p in parts]) if parts else np.empty(0) for i in range(5)]
    doc, start, windows, one, two = columns
    doc, start, one, two = (c.astype(t) for c, t in ((doc, np.int64), (start, np.int64), (one, np.uint64), (two, np.uint64)))
    order = np.lexsort((start, doc, two, one))
    repeat = np.zeros(len(doc), bool)
    repeat[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(start), pa.array(windows.astype(np.int32)),
         pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(repeat)],
        ["doc_id", "start", "windows", "one", "two", "repeat"],
    )


def _blocks(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows):
            parts = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), cells(batch, "text")):
                words = text.split()
                if len(words) >= window:
                    starts, windows, anchors, blocks = anchored_blocks(hashes.of(words), window, seed)
                    parts.append((np.full(len(starts), doc), starts, windows, anchors, blocks))
            yield _found(parts)

    return docs.mapInArrow(kernel, FOUND)


def _windows(blocks: DataFrame, window: int) -> DataFrame:
    """The windows of blocks: ``blocks`` has ``doc_id``, ``text`` and ``spans``."""

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows):
            parts = []
            spans = batch.column("spans").to_pylist()
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), cells(batch, "text"), spans):
                starts = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in own])
                one, two = window_hashes(hashes.of(text.split()), starts, window)
                parts.append((np.full(len(starts), doc), starts, np.ones(len(starts)), one, two))
            yield _found(parts)

    return blocks.mapInArrow(kernel, FOUND)


def _frequent(found: DataFrame) -> DataFrame:
    """Anchors with very many occurrences; at most ``SURVEY_SHARE`` of them."""
    counts = found.groupBy("one").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(SURVEY_LEAST, total // SURVEY_SHARE + 1)
    return counts.where(F.col("count") >= least).select("one", F.lit(True).alias("frequent"))


def _labelled(found: DataFrame, frequent: DataFrame | None) -> DataFrame:
    """``repeat``: an earlier row has the same two hashes. ``contested``: other blocks, too,
    have the anchor.

    Rows travel by the first hash; those known as repeats, and the blocks of frequent anchors,
    are spread by more, and such blocks all count as contested.
    """
    if frequent is not None:
        found = found.join(F.broadcast(frequent), "one", "left")
    else:
        found = found.withColumn("frequent", F.lit(True))
    spread = (
        F.when(F.col("repeat"), F.xxhash64("doc_id", "start"))
        .when(F.col("frequent"), F.xxhash64("one", "two"))
        .otherwise(F.col("one"))
    )
    # Three small numbers travel as one: row fields take eight bytes each.
    flags = F.col("repeat").cast("long") * 2 + F.coalesce("frequent", F.lit(False)).cast("long")
    place = F.shiftleft("start", 16) + F.col("windows") * 4 + flags
    dealt = found.select("doc_id", place.alias("place"), "one", "two", spread.alias("route")).repartition("route")
    known = F.col("place").bitwiseAND(2) > 0
    earlier = Window.partitionBy("route", "one", "two").orderBy(known, "doc_id", "place")
    anchor = Window.partitionBy("route", "one")
    return dealt.select(
        "doc_id",
        F.shiftright("place", 16).alias("start"),
        F.shiftright(F.col("place").bitwiseAND(0xFFFF), 2).cast("int").alias("windows"),
        (known | (F.row_number().over(earlier) > 1)).alias("repeat"),
        ((F.col("place").bitwiseAND(1) > 0) | (F.min("two").over(anchor) != F.max("two").over(anchor))).alias("contested"),
    )


def repeated_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Spans of words, ``(doc_id, start, end)``, of windows that also start earlier.

    ``docs`` has each id once. Earlier: a smaller ``doc_id``, or the same and an earlier start.
    """
    small_batches(docs.sparkSession)
    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SURVEY)) == 0)
    frequent = _frequent(_blocks(sampled, window, seed).where("not repeat"))
    blocks = _labelled(_blocks(docs, window, seed), written(frequent))
    blocks = written(blocks.where("repeat or contested"))
    contested = blocks.where("not repeat").groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "windows")).alias("spans"))
    windows = _labelled(_windows(docs.join(contested, "doc_id"), window), None)
    span = lambda rows: rows.where("repeat").select(
        "doc_id", "start", (F.col("start") + F.col("windows") + window - 1).alias("end"))
    return span(blocks).unionAll(span(windows))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by a space).

    Every word inside a window of ``window`` words that also starts earlier is removed; windows
    are judged on the input. Words are separated by ASCII white space and compared as they are.
    Each id gives a row; rows of one id, and rows without: see
    :func:`footfall.llm.common.one_row_per_document`.
    """
    docs = by_id(docs)
    spans = repeated_words(docs, window, seed).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            counts, removed, kept = [], [], []
            for text, own in zip(cells(batch, "text"), batch.column("spans").to_pylist()):
                words = text.split()
                counts.append(len(words))
                if own:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in own], 1)
                    np.add.at(change, [s["end"] for s in own], -1)
                    left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    words = list(map(words.__getitem__, left.tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = docs.join(spans, "doc_id", "left")
    return joined.mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept string")


