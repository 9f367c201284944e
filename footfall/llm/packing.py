"""Packing: windows filled with texts that are lexically alike.

Texts become ids; a whole window of a long text is a sequence by itself. What is left of each
text goes to a shard of bounded size, drawn by the hash of its id. A shard holds an inverted
index with BM25 weights, whose document frequencies are those of the whole corpus. The longest
unused text seeds a window; the unused texts that score best for the seed's rarest words fill
it, the last of them cut where the window ends; its rest goes back to the unused ones. Where
nothing scores, the next unused text is taken. The ids left over at a shard's end are cut into
powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import batches, cells, scratch, small_batches
from footfall.llm.word_tokens import word_tokens

WINDOW, END_ID = 4096, 2
SHARD_IDS = 2_000_000
QUERY_TERMS, K1, B = 16, 1.2, 0.75
NEIGHBOURS = 64
TERMS = 1 << 16
# Sequences of whole windows are numbered apart from those of shards.
WHOLE = 1 << 62

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenized(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """Ids of each text with ``end_id`` after them, 16 bits each, and the number of its first
    whole window's sequence."""

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(vocabulary), np.array([end_id], np.uint16).tobytes()
        number = WHOLE | TaskContext.get().partitionId() << 40
        for batch in rows:
            ids = [x + end for x in tokens.encode(cells(batch, "text"))]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            whole = n // window
            first = number + np.cumsum(whole) - whole
            number += int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(first), pa.array(ids, pa.binary())],
                ["doc_id", "doc_tokens", "first", "ids"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(kernel, "doc_id long, doc_tokens long, first long, ids binary")


def frequencies(rests: DataFrame) -> np.ndarray:
    """In how many rests each id occurs: at most 2 ** 16 counts."""

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, places = np.zeros(TERMS, np.int64), np.zeros(TERMS, np.int64), np.arange(1)
        for batch in rows:
            for text in cells(batch, "ids"):
                ids = np.frombuffer(text, np.uint16)
                if len(ids) > len(places):
                    places = np.arange(2 * len(ids))
                # The last place of each id, so that none counts twice.
                own = places[: len(ids)]
                last[ids] = own
                held[ids[last[ids] == own]] += 1
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["term", "n"])

    out = np.zeros(TERMS, np.int64)
    for term, n in rests.select("ids").mapInArrow(kernel, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Shard:
    """BM25 over the texts of a shard."""

    def __init__(self, texts: list[np.ndarray], held: np.ndarray, total: int, mean: float):
        self.idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
        parts = [np.unique(t, return_counts=True) for t in texts]
        sizes = [len(p[0]) for p in parts]
        terms = np.concatenate([p[0] for p in parts]).astype(np.int64)
        counts = np.concatenate([p[1] for p in parts]).astype(np.float64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        length = np.array([len(t) for t in texts])[owner]
        weight = self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.at = np.searchsorted(terms[order], np.arange(TERMS + 1))
        # The terms of a text that tell most about it.
        begin = np.concatenate(([0], np.cumsum(sizes)))
        self.query = []
        for i in range(len(texts)):
            own, score = terms[begin[i] : begin[i + 1]], weight[begin[i] : begin[i + 1]]
            top = np.lexsort((own, -score))[:QUERY_TERMS]
            self.query.append(own[top])

    def scores(self, seed: int, n: int) -> np.ndarray:
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed]]
        owner = np.concatenate([self.owner[s] for s in spans])
        return np.bincount(owner, np.concatenate([self.weight[s] for s in spans]), n)


def packed(texts: list[np.ndarray], shard: Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of ``(text, first id, end)``; every id of every text is in exactly one."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    begin = np.zeros(n, np.int64)
    queue = sorted(range(n), key=lambda i: (-size[i], i))
    unused = np.ones(n, bool)
    ahead, rest = 0, int(size.sum())

    while rest >= window:
        while not unused[queue[ahead]]:
            ahead += 1
        seed = queue[ahead]
        unused[seed] = False
        sequence, room = [(seed, int(begin[seed]), int(size[seed]))], window - int(size[seed] - begin[seed])
        if room:
            scores = np.where(unused, shard.scores(seed, n), 0)
            while room and scores.any():
                few = np.argpartition(-scores, min(NEIGHBOURS, n - 1))[:NEIGHBOURS]
                for i in few[np.lexsort((few, -scores[few]))].tolist():
                    if room and scores[i] > 0:
                        room -= _take(i, room, begin, size, unused, sequence)
                        scores[i] = 0
        at = ahead
        while room:
            while not unused[queue[at]]:
                at += 1
            room -= _take(queue[at], room, begin, size, unused, sequence)
        rest -= window
        yield sequence

    sequence = [(i, int(begin[i]), int(size[i])) for i in np.flatnonzero(unused).tolist()]
    while rest:
        part, room, left = [], 1 << rest.bit_length() - 1, []
        rest -= room
        for i, a, b in sequence:
            take = min(room, b - a)
            room -= take
            if take:
                part.append((i, a, a + take))
            if a + take < b:
                left.append((i, a + take, b))
        sequence = left
        yield part


def _take(i: int, room: int, begin: np.ndarray, size: np.ndarray, unused: np.ndarray, sequence: list) -> int:
    """Put text ``i``, or as much of it as fits, at the end of a sequence."""
    a = int(begin[i])
    take = min(room, int(size[i]) - a)
    sequence.append((i, a, a + take))
    begin[i] = a + take
    unused[i] = begin[i] < size[i]
    return take


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of texts in sequences of ``window`` ids; the last few of a shard are powers of two.

    Returns ``doc_id``, ``start`` and ``length`` of the piece in its text's ids, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence) and ``ids`` (32 bits each, little-endian).
    Every row of ``docs`` is a text of its own, whatever its id; a null text is empty and
    consists of ``end_id`` alone. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark)
    tokenized(docs, vocabulary, window, end_id).write.option("compression", "zstd").parquet(folder)
    texts = spark.read.schema("doc_id long, doc_tokens long, first long, ids binary").parquet(folder)

    def whole_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 200):
            found = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.uint16).astype("<u4")
                found += [
                    (row["doc_id"], k * window, window, len(ids), row["first"] + k, 0,
                     ids[k * window : (k + 1) * window].tobytes())
                    for k in range(len(ids) // window)
                ]
            yield _pieces(found)

    def fill(group: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(group.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "shard"))),
            key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        ids = [np.frombuffer(r[2], np.uint16) for r in rows]
        before = [r[1] - len(x) for r, x in zip(rows, ids)]
        index = Shard(ids, held, total, mean)
        found = []
        for k, sequence in enumerate(packed(ids, index, window)):
            offset = 0
            for i, a, b in sequence:
                found.append((rows[i][0], before[i] + a, b - a, rows[i][1], rows[i][3] << 32 | k, offset,
                              ids[i][a:b].astype("<u4").tobytes()))
                offset += b - a
        return pa.Table.from_batches([_pieces(found)])

    left = F.col("doc_tokens") % window
    rests = texts.where(left > 0).select(
        "doc_id", "doc_tokens", F.expr(f"substring(ids, cast(2 * (doc_tokens - doc_tokens % {window}) as int) + 1)").alias("ids"))
    total, n_ids = rests.agg(F.count("*"), F.coalesce(F.sum(F.length("ids")), F.lit(0)) / 2).first()
    held, mean = frequencies(rests), n_ids / max(total, 1)
    shards = max(1, round(n_ids / SHARD_IDS))
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids"), F.lit(shards)))
    filled = dealt.groupBy("shard").applyInArrow(fill, PIECES)
    return texts.where(F.col("doc_tokens") >= window).mapInArrow(whole_windows, PIECES).unionAll(filled)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
