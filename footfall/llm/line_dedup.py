"""Line dedup: runs of lines that occur before are removed.

A text's written lines make pairs of neighbours, with the blank lines between them. A rolling
hash over the hashes of a pair's lines decides whether a chunk ends there, so borders follow
the lines alone: a passage that is shifted, or stands between other lines, is cut in the same
places. Neighbouring chunks share the line at their border, so each has two lines or more and
each pair lies in one chunk. Of equal chunks all but the first are copies, whatever their
number, and their pairs need no further look. At the ends of a passage, where chunks reach into
the text around it, the pairs of the remaining chunks are looked up as chunks of their own. So
no repeated run of two written lines is missed, and what goes is the same for every ``EVERY``.
Everything that is cut was compared with its first occurrence by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import spread_join, written

# One pair in so many ends a chunk.
EVERY = 4


def _bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last``, blank ones too."""
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _pairs(lines: Column) -> Column:
    """``(first, last, hash)`` of each written line, counted from 0, and the next written one."""
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.get(lines, i)) != "")

    def of_places(hashes: Column, p: Column) -> Column:
        return F.filter(F.transform(p, lambda i, k: _bound(F.get(p, k + 1), lambda end: F.when(end.isNotNull(), F.struct(
            i.alias("first"), end.alias("last"),
            F.xxhash64(F.slice(hashes, i + 1, end - i + 1)).alias("hash"))))), lambda pair: pair.isNotNull())

    return _bound(F.transform(lines, lambda line: F.xxhash64(line)), lambda h: _bound(places, lambda p: of_places(h, p)))


def line_chunks(lines: Column, every: int = EVERY) -> Column:
    """``(one, two, first, last, pairs)`` of each chunk: two hashes of its text, its first and
    last line, and its pairs. None of a text with fewer than two written lines."""

    def of_pairs(pairs: Column) -> Column:
        final = F.size(pairs) - 1
        ends = F.filter(
            F.transform(pairs, lambda pair, k: F.when((k == final) | (F.pmod(pair["hash"], F.lit(every)) == 0), k)),
            lambda k: k.isNotNull())
        return _bound(ends, lambda e: F.transform(e, lambda end, c: _bound(
            F.coalesce(F.get(e, c - 1) + 1, F.lit(0)), lambda start: F.slice(pairs, start + 1, end - start + 1))))

    def named(own: Column) -> Column:
        first, last = own[0]["first"], F.element_at(own, -1)["last"]
        return _bound(_joined(lines, first, last), lambda text: F.struct(
            F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"),
            first.alias("first"), last.alias("last"), own.alias("pairs")))

    return F.transform(_bound(_pairs(lines), of_pairs), named)


def repeated_runs(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``(doc_id, mark, first, n)`` of chunks, and of pairs in other chunks, that occur earlier:
    in a smaller id, or above; ``mark`` is a hash of the row's text.

    Hashes travel first, without text. Chunks with the same 128 bits as an earlier one are set
    aside; of the others the pairs whose 64-bit hash occurs again, and of all chunks those that
    are repeated, are brought together with their text and grouped by it. Spans of one run
    overlap, and a span may overlap its earlier occurrence.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    lines = F.split("text", "\n")
    place = F.struct("doc_id", "mark", "first")
    counted = (F.min(place).alias("earliest"), F.count("*").alias("copies"))

    chunks = written(texts.select("doc_id", "mark", F.inline(_bound(lines, lambda x: line_chunks(x, every)))))
    same = written(chunks.groupBy("one", "two").agg(*counted).where("copies > 1"))
    judged = spread_join(chunks, same, ["one", "two"], ["doc_id", "mark", "first"], "left")
    # A repeated chunk as a whole, without a hash; and the pairs of all chunks but copies.
    span = F.struct("first", "last", F.lit(None).cast("long").alias("hash"))
    spans = F.when(F.col("earliest").isNotNull(), F.array(span))
    pairs = F.when(F.col("earliest").isNull() | (place == F.col("earliest")), F.col("pairs"))
    places = written(judged.select("doc_id", "mark", F.inline(
        F.flatten(F.filter(F.array(spans, pairs), lambda x: x.isNotNull())))))

    again = written(places.where("hash is not null").groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"))
    suspect = spread_join(places.where("hash is not null"), again, ["hash"], ["doc_id", "mark", "first"]).select(
        "doc_id", "mark", "first", "last").unionAll(places.where("hash is null").select("doc_id", "mark", "first", "last"))
    suspect = suspect.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    shown = written(texts.join(suspect.hint("merge"), ["doc_id", "mark"]).select("doc_id", "mark", F.inline(_bound(
        lines, lambda x: F.transform("spans", lambda s: F.struct(
            s["first"].alias("first"), s["last"].alias("last"), _joined(x, s["first"], s["last"]).alias("span_text")))))))
    first = written(shown.groupBy("span_text").agg(*counted).where("copies > 1"))
    found = spread_join(shown, first, ["span_text"], ["doc_id", "mark", "first"]).where(place != F.col("earliest"))
    return found.select("doc_id", "mark", "first", (F.col("last") - F.col("first") + 1).alias("n"))


def remove_repeated_runs(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``docs`` without lines in runs of two written lines or more that occur earlier, wherever
    a run begins or ends and whatever stands around it; and ``n_lines``, ``n_removed``.

    Lines end at ``\\n``; what is left is joined by it again. Every line that goes has an equal
    one that stays. Blank lines go inside of a run only. A row gives a row: a null id or a null
    text stays as it is, and rows of one id and one text count as one occurrence. All other
    columns are handed on; columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    cuts = repeated_runs(docs, every).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("_cuts"))
    cuts = cuts.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    here = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_mark"))
    return _without(docs.columns, docs.join(cuts, here, "left"))


def _without(columns: list[str], joined: DataFrame) -> DataFrame:
    """``columns`` of rows whose ``_cuts`` list the ``(first, n)`` that go from ``text``."""
    lines = F.split("text", "\n")
    # Line numbers that go, in one list; a text keeps what lies outside of it.
    gone = F.array_distinct(F.flatten(F.transform("_cuts", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1))))
    left = _bound(lines, lambda all_lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone), lambda i: F.get(all_lines, i)), "\n"))
    n_lines = F.coalesce(F.size(lines).cast("long"), F.lit(0))
    removed = F.when(F.col("_cuts").isNotNull(), F.size(gone)).otherwise(0).cast("long")
    return joined.select(
        *(F.when(F.col("_cuts").isNotNull(), left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
          for c in columns),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
    )
