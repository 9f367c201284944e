"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the size of their shingle sets. A text that contains at least
``percent`` of an item's shingles misses few of them, and a partition's largest size says how
many at most; so one shingle more, those with the smallest hashes (the item's MinHash
signature, its length chosen per partition), must include one that the text has. Texts'
shingles are looked up among the signatures, whatever the text's length; every candidate is
then verified by counting the item's shingles, as strings, in the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written

WIDTH, PERCENT = 5, 80
# Tables of at most so many counted rows are broadcast (numbers and short strings).
BROADCAST_ROWS = 200_000
SIGNS = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SIGNS), lambda w: w != "")


def _shingles(words: Column, width: Column, value) -> Column:
    """``value(words, position)`` of each run of ``width`` words, distinct; none if too short."""
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: value(words, i))
    return F.when(last >= 0, F.array_distinct(runs)).otherwise(F.slice(F.array_distinct(runs), 1, 0))


def _hashed(width: int):
    return lambda words, i: F.xxhash64(F.lit(width), *(F.get(words, i + k) for k in range(width)))


def _spelled(width: int):
    return lambda words, i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(width)))


def _by_width(rows: DataFrame, widths: list[int], value, name: str) -> DataFrame:
    """A row for each distinct run of any of the widths in ``words``."""
    lists = [_shingles(F.col("words"), F.lit(w), value(w)) for w in widths]
    return rows.withColumn(name, F.explode(lists[0] if len(lists) == 1 else F.concat(*lists)))


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, to be broadcast if its counted rows are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def item_shingles(items: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """``(item_id, shingle, hash, n)`` and the widths in use.

    An item of fewer than ``width`` words is one shingle of its own length. Items of one id are
    pooled; null ids and texts without words have no shingles.
    """
    worded = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words"))
    worded = worded.where(F.size("words") > 0)
    own = F.least(F.size("words"), F.lit(width))
    parts = [
        _by_width(worded.where(own == w), [w], _spelled, "shingle")
        .withColumn("hash", F.xxhash64(F.lit(w), *(F.get(F.split("shingle", " "), F.lit(k)) for k in range(w))))
        .withColumn("width", F.lit(w))
        for w in range(1, width + 1)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    rows = rows.select("item_id", "shingle", "hash", "width").distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    found = written(rows.join(sizes, "item_id"))
    return found, sorted(r["width"] for r in found.select("width").distinct().collect())


def signatures(shingles: DataFrame, percent: int) -> DataFrame:
    """``(hash, item_id)``: each item's smallest hashes, as many as its size partition needs."""
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    length = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    sets = shingles.groupBy("item_id", "n").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    return sets.select("item_id", F.explode(F.slice("hashes", F.lit(1), length)).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles)`` of items that documents contain.

    An item is contained if ``100 * n_shared >= percent * n_shingles``: distinct shingles of
    ``width`` words that the document has, too. Words are runs of letters and digits, lower
    case. Rows of one ``doc_id`` are pooled to one document; rows without an id, null and
    wordless texts, contain nothing. Only ``doc_id`` and ``text`` are read, and of the items
    ``item_id`` and ``text``.
    """
    shingles, widths = item_shingles(items, width)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not widths:
        none = F.lit(None).cast("long")
        return texts.select("doc_id", none.alias("item_id"), none.alias("n_shared"), none.alias("n_shingles")).limit(0)
    worded = texts.select("doc_id", _words("text").alias("words"))
    signed = written(signatures(shingles, percent))
    candidates = written(
        _by_width(worded, widths, _hashed, "hash").select("doc_id", "hash")
        .join(_small(signed), "hash").select("doc_id", "item_id").distinct())

    suspects = texts.join(_small(written(candidates.select("doc_id").distinct())), "doc_id")
    spelled = _by_width(suspects.select("doc_id", _words("text").alias("words")), widths, _spelled, "shingle")
    shared = (
        spelled.select("doc_id", "shingle")
        .join(_small(shingles.select("item_id", "shingle", "n")), "shingle")
        .join(_small(candidates), ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id", "n").agg(F.count_distinct("shingle").alias("n_shared"))
    )
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n")).select(
        "doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain an item; rows without an id stay."""
    found = written(contaminated(docs, items, width, percent).select("doc_id").distinct())
    return docs.join(_small(found), "doc_id", "left_anti")
