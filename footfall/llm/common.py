"""What several operators share: reading tables, written intermediates, words in bytes.

Rows are told apart by ``doc_id``. Operators that bring rows of a document together (joins,
groups) treat rows of one ``doc_id``, and rows whose ``doc_id`` is null, as stated in their
own docstrings; :func:`one_row_per_document` is the rule that most of them name.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words: space, \t, \n, \v, \f, \r. The same six bytes separate
# in bytes.split(), so kernels split the UTF-8 form.
SPACES = r"[\x20\x09-\x0D]+"
# Python kernels hold a batch, its words and their hashes at once.
BATCH_BYTES = "8m"
# Keys that a join splits: how many at most, from how many rows on, and into how many parts.
HOT_KEYS, HOT_ROWS, HOT_PARTS = 1_000, 500, 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by bytes, as texts differ in length by orders."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@lru_cache(maxsize=1)
def own_folder() -> str:
    """For sessions without a shared folder, as in tests."""
    return tempfile.mkdtemp(prefix="footfall-")


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the shared folder that the cluster names. Only a
    session of one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = own_folder()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    folder = folder or scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined on ``keys`` with ``facts``, which has one row a key and its number of rows
    in ``copies``; rows of a hot key are dealt into parts by the hash of their ``by`` columns.

    Hot are the ``HOT_KEYS`` most frequent keys, as far as they have more than ``HOT_ROWS`` rows.
    Any other key has less than one row in ``HOT_KEYS``, and the list, of 64-bit hashes that are
    broadcast, has that many entries at most.
    """
    hot = (facts.where(F.col("copies") > HOT_ROWS).select(F.xxhash64(*keys).alias("_hot"), "copies")
           .orderBy(F.desc("copies"), "_hot").limit(HOT_KEYS).select("_hot").distinct())

    def parted(side: DataFrame, parts: Column) -> DataFrame:
        marked = side.join(F.broadcast(hot), F.xxhash64(*keys) == F.col("_hot"), "left")
        own = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(parts)
        return marked.withColumn("_part", F.explode(own)).drop("_hot")

    one = parted(rows, F.array(F.pmod(F.xxhash64(*by), F.lit(HOT_PARTS)).cast("int")))
    each = parted(facts, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1)))
    return one.join(each.hint("merge"), [*keys, "_part"], how).drop("_part")


def one_row_per_document(docs: DataFrame) -> DataFrame:
    """One row for each distinct non-null ``doc_id``: its smallest text, null counts as empty.

    Rows without an id cannot be named in a result; they are left out of it.
    """
    return (
        docs.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )


def by_id(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with every id once: :func:`one_row_per_document`.

    Where the ids are unique already, as a count of ids tells, texts are not moved for it.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.limit(1).count():
        return one_row_per_document(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def words_of(text: str = "text"):
    """Words of a text column, in order; none of a null or blank text."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """What ``make`` gives, kept in this worker until another operator keeps something.

    Workers serve one operator after the other; tables of two would not fit their memory.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def cells(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``most`` rows."""
    for batch in rows:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are few enough."""

    LIMIT = 200_000

    def __init__(self, seed: int = 0):
        super().__init__()
        import xxhash

        self.seed, self.digest = seed, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.digest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Ranges:
    """64-bit hashes of ranges of a sequence of hashes, from sums of powers."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)
    BASE = np.uint64(0xD6E8FEB86659FD93)
    INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        while len(Ranges.powers) < n:
            p, q = Ranges.powers, Ranges.inverses
            Ranges.powers = np.concatenate((p, p * (p[-1:] * self.BASE)))
            Ranges.inverses = np.concatenate((q, q * (q[-1:] * self.INVERSE)))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * Ranges.powers[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * Ranges.inverses[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes, order included."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n] + np.uint64(i + 1))
    return out
