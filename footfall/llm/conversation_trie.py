"""The prefix trie of conversations, by collapsing whole sequences.

Conversations with one and the same sequence of turns become one weighted sequence with the list
of its conversations. Sequences in which no other one goes on are the leaves, found by an anti
join. Only the prefixes of distinct sequences are then added up, with their weights, in partial
sums first.

A prefix is named by its depth and by the combined 64-bit hashes (two of them) of its turns, each
hashed together with its place; turns themselves are known by the SHA-256 of role and text, so
no text is shuffled. What runs along a conversation (numbers, names, sums from below) is
added up inside the ranges of a range partitioning and then over ranges, so one very long
conversation is spread over tasks like any other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import batches, written

# The most turns that are taken over from another conversation.
HEAD = 8
NODE = ["depth", "one", "two"]
# Ids that make up one row on the way to their hash.
IDS_A_ROW = 8_192
RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


def running(rows: DataFrame, key: str, order: list[Column], combine, **values: str) -> DataFrame:
    """``rows`` with, for each name of ``values``, its column combined over the rows of a key up
    to this one. ``order`` is total within a key up to rows that are equal altogether."""
    dealt = written(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
                    .withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # A row for each key and range: few even where a key fills many ranges.
    totals = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(
        *(combine(column).alias(name) for name, column in values.items()))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_key", "_of", *(combine(name).over(before).alias(f"_{name}") for name in values))
    earlier = earlier.where(F.col(f"_{next(iter(values))}").isNotNull())
    local = dealt.withColumns({f"_in_{name}": combine(column).over(inside) for name, column in values.items()})
    both = local.join(earlier, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_of")), "left")
    neutral = F.lit(0).cast("long")
    joined = {name: _pair(combine, F.coalesce(f"_{name}", neutral), F.col(f"_in_{name}")) for name in values}
    return both.withColumns(joined).select(*rows.columns, *values)


def _pair(combine, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if combine is F.bit_xor else a + b


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``j`` (from 1), ``content`` and ``n_bytes`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(content).alias("content"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("step"))
    return running(rows, "conv_id", [F.col("turn"), F.col("content")], F.sum, j="step").select(
        "conv_id", "j", "content", "n_bytes")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their number of rebuilt turns, and the rebuilt turns by depth."""
    of = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    heads = turns.where(F.col("j") <= HEAD).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("j", "content", "n_bytes"))).alias("head"))
    all_of = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    convs = all_of.withColumns({"h": of, "base": F.col("conv_id") - F.col("conv_id") % 5})
    convs = convs.join(heads.hint("merge"), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    convs = written(convs.select(
        "conv_id", "h", "taken", F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)).alias("own"),
        F.slice("head", F.lit(1), F.col("taken").cast("int")).alias("head")))
    first = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.j").alias("depth"), "t.content", "t.n_bytes")
    rest = turns.join(convs.where("own > 0").select("conv_id", "h", "taken").hint("merge"), "conv_id").where("j > h").select(
        "conv_id", (F.col("taken") + F.col("j") - F.col("h")).alias("depth"), "content", "n_bytes")
    return convs.select("conv_id", (F.col("taken") + F.col("own")).alias("length")), first.unionAll(rest)


def _hashed_lists(members: DataFrame, key: list[str]) -> DataFrame:
    """The SHA-256 of each key's ids, ascending and joined by commas.

    A key's ids may be a third of all: they are sorted over many tasks, which join them to rows
    of some thousand ids each, and a hash goes over such rows as they stream by.
    """
    kinds = ", ".join(f"{k} long" for k in key)

    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, done = None, [], []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * (len(key) + 1) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [*key, "least", "ids"])

        for batch in rows:
            for *name, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id"))):
                if ids and (name != at or len(ids) == IDS_A_ROW):
                    done.append((*at, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(done) == 200:
                        yield out()
                        done = []
                at = name
                ids.append(conv)
        if ids:
            done.append((*at, ids[0], ",".join(map(str, ids))))
        if done:
            yield out()

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in done], pa.int64()) for i in range(len(key))), pa.array([r[-1] for r in done], pa.string())],
                [*key, "ends_sha256"])

        for batch in batches(rows, 500):
            for *name, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if name == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = name, hashlib.sha256(ids.encode())
            yield out()
            done = []
        if at is not None:
            done.append((*at, digest.hexdigest()))
            yield out()

    ordered = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = written(ordered.mapInArrow(joined, f"{kinds}, least long, ids string"))
    together = chunks.repartition(*key).sortWithinPartitions(*key, "least").select(*key, "ids")
    return together.mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; columns as in ``RESULT``.

    Turns are ordered by ``turn``, null first, and equal ones by the SHA-256 of role and text;
    a repeated row is a turn of its own. A null role or text is empty, rows without ``conv_id``
    are left out. Conversation c begins with the first ``crc32(c) % 9`` turns of conversation
    ``c - c % 5`` and goes on with its own after as many; so it may have no turns at all, and is
    a member of the root only. No conversations, no nodes.

    ``saved_tokens`` of a node adds up, over its subtree, the bytes of a node's last text times
    its conversations but one. Every node belongs to the leaf with the least name below it, which
    owns the lower end of its path; sums from below on those parts, and their totals handed to
    all nodes above, give every subtree without visiting a node once for each of its ancestors.
    """
    spark = conversations.sparkSession
    convs, turns = _rebuilt(written(_turns(conversations)))
    placed = turns.withColumns({"mark_one": F.xxhash64("depth", "content"), "mark_two": F.xxhash64("content", "depth")})
    paths = written(running(placed, "conv_id", [F.col("depth")], F.bit_xor, one="mark_one", two="mark_two").select(
        "conv_id", *NODE, F.col("one").bitwiseXOR(F.col("mark_one")).alias("up_one"),
        F.col("two").bitwiseXOR(F.col("mark_two")).alias("up_two"), "n_bytes"))

    # Whole sequences: the node at which each conversation ends; the root for one without turns.
    root = [F.lit(0).cast("long").alias(c) for c in ("one", "two")]
    ends = convs.withColumnRenamed("length", "depth").join(
        paths.select("conv_id", *NODE).hint("merge"), ["conv_id", "depth"]).select("conv_id", *NODE)
    ends = written(ends.unionAll(convs.where("length = 0").select("conv_id", F.col("length").alias("depth"), *root)))
    sequences = written(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")))
    along = paths.join(sequences.select("conv_id", "weight").hint("merge"), "conv_id").select(
        "conv_id", "weight", *NODE, "up_one", "up_two", "n_bytes")
    no_bytes, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = sequences.select("conv_id", "weight", F.lit(0).cast("long").alias("depth"), *root,
                            none.alias("up_one"), none.alias("up_two"), no_bytes.alias("n_bytes"))
    # A sequence that goes on in another one is no leaf.
    parents = paths.select((F.col("depth") - 1).alias("depth"), F.col("up_one").alias("one"), F.col("up_two").alias("two")).distinct()
    leaves = sequences.join(parents.hint("merge"), NODE, "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    prefixes = written(along.unionAll(tops).join(leaves.hint("merge"), "conv_id", "left"))
    nodes = written(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("up_one").alias("up_one"), F.max("up_two").alias("up_two"), F.count("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner")))

    # Sums from below along each leaf's own nodes, and their totals for the nodes above them.
    own = nodes.select("owner", *NODE, ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    totals = written(own.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("total")))
    lower = running(own, "owner", [F.col("depth").desc()], F.sum, below="saved").join(
        totals.select(F.col("conv_id").alias("owner"), F.col("total").alias("of_owner")).hint("merge"), "owner")
    above = prefixes.where("leaf").join(totals.hint("merge"), "conv_id").groupBy(*NODE).agg(F.sum("total").alias("of_all"))

    up = ["up_depth", "up_one", "up_two"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_one").alias("one"), F.col("up_two").alias("two")).agg(
        F.count("*").alias("n_children"))
    whole = (
        nodes.select(*NODE, "conv_id", "n_convs", "n_leaves", "up_one", "up_two")
        .join(lower.select(*NODE, "below", "of_owner").hint("merge"), NODE)
        .join(above.hint("merge"), NODE)
        .join(children.hint("merge"), NODE, "left")
        .join(_hashed_lists(ends, NODE).hint("merge"), NODE, "left")
    )
    whole = written(whole.select(
        "conv_id", "depth", (F.col("depth") - 1).alias("up_depth"), "up_one", "up_two", "n_convs",
        F.coalesce("n_children", no_bytes).alias("n_children"), "n_leaves",
        (F.col("below") + F.col("of_all") - F.col("of_owner")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    # Every node of depth 1 has the one root as its parent, which is a single row.
    top = whole.where("depth = 0").select("conv_id").first()
    if top is None:
        return spark.createDataFrame([], RESULT)
    names = nodes.where("depth > 0").select(
        F.col("depth").alias("up_depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("conv_id").alias("parent_conv_id"))
    near = whole.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top.conv_id).cast("long")))
    deep = whole.where("depth > 1").join(names.hint("merge"), up, "left")
    return near.unionByName(deep).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
