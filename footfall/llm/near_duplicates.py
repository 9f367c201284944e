"""Near duplicates by SuperMinHash: signatures, banding, exact verification, union-find.

Signatures: each shingle visits the slots of a signature in an order of its own, one slot a
level, and offers ``level + chance`` there; a slot keeps the least offer. As a shingle's places
are a permutation, slots are spread evenly over shingles, which lowers the variance; a text is
done as soon as its slots are all below the level reached. A shingle's permutation is a few
rounds of steps that can be undone (an odd factor, a sum, high bits into low ones) with
factors of the shingle's own, so no shuffled arrays are kept.

Texts with one and the same set form a class, which only its least id represents from there
on. Representatives that share a band of slots are hung below the least of the bucket, which
joins candidates without forming pairs. Inside a group of candidates, cut into blocks of
bounded size, sets are compared as a whole: intersections of all members of a block at once,
by a product of 0/1 matrices, and with a few leaders of the group that every block gets. Where
a group falls into several parts that way, members outside its largest part are compared with
the blocks in which they have bucket mates of another part, if sizes and rarest shingles allow
a link there; the visitors of a block are dealt into slices of bounded size. Linked texts are
united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import WordHashes, batches, by_id, cells, mixed, rolled, small_batches, written
from footfall.llm.components import components, star_components

SLOTS, ROWS = 512, 8
PLACE_ROUNDS = 4
LEADERS = 8
# A block has about so many members, and so many shingles, at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 384, 1_000_000
# Visitors of a block that one task takes.
SLICE_VISITORS = 768
COLUMNS = 4_096
# Buckets in which shingles are counted.
SKETCH = 1 << 15


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    return np.unique(rolled(hashes.of(words), width) + np.uint64(width))


def place_keys(members: np.ndarray) -> np.ndarray:
    """An odd factor and a sum for each round of each member's permutation."""
    one = mixed(members + np.uint64(0x632BE59BD9B4E019))
    two = mixed(members ^ np.uint64(0x2545F4914F6CDD1D))
    cut = lambda x, k: (x >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.uint32)
    return np.stack([f(cut(x, k)) for k in range(PLACE_ROUNDS) for f, x in ((lambda v: v | np.uint32(1), one), (lambda v: v, two))])


def places(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
    """Each member's slot of a level; over all levels a permutation of the slots."""
    half, low = np.uint32((slots.bit_length() - 1) // 2 or 1), np.uint32(slots - 1)
    at = np.full(keys.shape[1], level, np.uint32)
    for k in range(0, len(keys), 2):
        at = at * keys[k] + keys[k + 1] & low
        at ^= at >> half
    return at.astype(np.int64)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of slots for each non-empty set; rows of empty sets stay at the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), slots), top, np.uint64)
    flat = out.reshape(-1)
    members = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys = place_keys(members)
    for level in range(slots):
        if not len(members):
            break
        slot = places(keys, level, slots)
        chance = mixed(members ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(32)
        np.minimum.at(flat, owner * slots + slot, chance | np.uint64(level << 32))
        if level % 4 == 3 or len(members) > 4 * slots:
            # A text whose slots are all below the next level cannot change any more.
            open_texts = np.unique(owner)
            done = np.zeros(len(sets), bool)
            done[open_texts] = out[open_texts].max(axis=1) < np.uint64((level + 1) << 32)
            left = ~done[owner]
            members, owner, keys = members[left], owner[left], keys[:, left]
    return out


def band_hashes(slots: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of ``rows`` slots."""
    cut = slots.reshape(len(slots), -1, rows)
    out = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return out


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, size of its set, the set's 128-bit hash and its band hashes."""

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches(rows, 500):
            sets = [shingle_set(t.lower().split(), width, hashes) for t in cells(batch, "text")]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            parts = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            bands = band_hashes(signatures(sets))
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(parts[:, 0]), pa.array(parts[:, 1]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))],
                ["doc_id", "n", "one", "two", "bands"],
            )

    return docs.mapInArrow(kernel, "doc_id long, n long, one long, two long, bands array<long>")


def _with_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (with ``id``) with each text's set as bytes."""
    rows = wanted.join(docs.withColumnRenamed("doc_id", "id").hint("merge"), "id")

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows):
            sets = [shingle_set(t.lower().split(), width, hashes).tobytes() for t in cells(batch, "text")]
            left = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(sets, pa.binary())], [*left.schema.names, "shingles"])

    fields = ", ".join(f"{name} {kind}" for name, kind in wanted.dtypes)
    ordered = rows.select(*wanted.columns, "text")
    return ordered.mapInArrow(kernel, f"{fields}, shingles binary")


def links_between(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set and each other, whether 100 * intersection >= percent * union."""
    everything = np.concatenate([*sets, *others])
    names, inverse = np.unique(everything, return_inverse=True)
    # Shingles of one text only meet nothing.
    held = np.bincount(inverse, minlength=len(names))
    place = np.cumsum(held > 1) - 1
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    use = held[inverse] > 1
    owner, place = owner[use], place[inverse[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(others)), np.float64)
    edges = np.arange(0, (place[-1] if len(place) else 0) + COLUMNS + 1, COLUMNS)
    cuts = np.searchsorted(place, edges)
    for k in range(len(edges) - 1):
        rows, columns = owner[cuts[k] : cuts[k + 1]], place[cuts[k] : cuts[k + 1]] - edges[k]
        if len(rows):
            table = np.zeros((len(sets) + len(others), COLUMNS), np.float32)
            table[rows, columns] = 1
            common += table[: len(sets)] @ table[len(sets) :].T
    n, m = (np.array([len(s) for s in x], np.float64) for x in (sets, others))
    return 100 * common >= percent * (n[:, None] + m[None, :] - common)


def parts_of(linked: np.ndarray) -> np.ndarray:
    """The least index in each index's connected part of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _inside_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the members of each block, and its leaders, to their parts."""

    def kernel(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), np.int64)
        order = np.unique(ids, return_index=True)[1]
        ids = ids[order]
        shingles = group.column("shingles")
        sets = [np.frombuffer(shingles[int(i)].as_py(), np.uint64) for i in order]
        label = parts_of(links_between(sets, sets, percent))
        return pa.table({"a": ids, "b": ids[label]})

    return rows.groupBy("group", "block").applyInArrow(kernel, "a long, b long")


def _across_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the visitors in a slice and the members of their block to their
    parts: one for each of them at most, however many of the members a visitor is linked with."""

    def kernel(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), np.int64)
        visits = np.array(group.column("visits").to_pylist(), bool)
        shingles = group.column("shingles")
        read = lambda which: [np.frombuffer(shingles[int(i)].as_py(), np.uint64) for i in which]
        guests, own = np.flatnonzero(visits), np.flatnonzero(~visits)
        members, found = read(own), [np.empty((0, 2), np.int64)]
        for start in range(0, len(guests) if len(own) else 0, BLOCK_MEMBERS):
            some = guests[start : start + BLOCK_MEMBERS]
            between = links_between(read(some), members, percent)
            linked = np.zeros((len(some) + len(own),) * 2, bool)
            linked[: len(some), len(some) :] = between
            linked[len(some) :, : len(some)] = between.T
            both = ids[np.concatenate([some, own])]
            label = parts_of(linked)
            joined = label != np.arange(len(label))
            found.append(np.stack([both[joined], both[label[joined]]], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("group", "block", "slice").applyInArrow(kernel, "a long, b long")


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles.view(np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _sketch(rows: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of a fixed number of buckets."""

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, np.int64)
        for batch in batches(rows, 500):
            joined = b"".join(batch.column("shingles").to_pylist())
            held += np.bincount(_buckets(np.frombuffer(joined, np.int64)), minlength=SKETCH)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "held"])

    counted = rows.select("shingles").mapInArrow(kernel, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))
    sketch = np.zeros(SKETCH, np.int64)
    for row in counted.collect():  # SKETCH rows at most
        sketch[row.bucket] = row.held
    return sketch


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each row's set, by a sketch of how often shingles occur.

    Two sets are linked only if one of the ``n - ceil(percent * n / 100) + 1`` first shingles
    of the larger is one of the ``n - ceil(2 * percent * n / (100 + percent)) + 1`` first
    (``short``) of the smaller: those beyond them are too few for the overlap that is needed. That
    holds for any one order of all shingles; rare ones first leave the fewest sets to compare.
    """
    sketch = _sketch(rows)

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 500):
            sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            first, short = [np.empty(0, np.int64)], [np.empty(0, bool)]
            for s in sets:
                most = len(s) + percent * len(s) // -100 + 1
                few = len(s) + 2 * percent * len(s) // -(100 + percent) + 1
                first.append(s[np.lexsort((s, sketch[_buckets(s)]))[:most]])
                short.append(np.arange(most) < few)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in first[1:]])
            rest = batch.drop_columns(["shingles"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(np.concatenate(first)), pa.array(np.concatenate(short))], [*rest.schema.names, "shingle", "short"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name != "shingles")
    ordered = rows.select(*(c for c in rows.columns if c != "shingles"), "shingles")
    return written(ordered.mapInArrow(kernel, f"{fields}, shingle long, short boolean"))


def _visits(prefixes: DataFrame, percent: int) -> DataFrame:
    """``(id, group, block)``: the blocks in which a member of another part may be linked with
    an id that is ``outside``, by sizes and by their rarest shingles."""
    at = prefixes.groupBy("group", "shingle", "block").agg(
        F.min("part").alias("least"), F.max("part").alias("most"), F.min("n").alias("small"), F.max("n").alias("large"),
        F.min(F.when(F.col("short"), F.col("n"))).alias("small_short"))
    guests = prefixes.where("outside").select("id", "group", "shingle", "part", "n", "short", F.col("block").alias("home"))
    return guests.join(at.hint("merge"), ["group", "shingle"]).where(
        "block <> home and (part <> least or part <> most)").where(
        f"100 * small <= {10_000 / percent} * n and {percent} * n <= 100 * large").where(
        "(short and large >= n) or small_short <= n").select("id", "group", "block").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each id of ``docs``.

    Two texts are linked if ``100 * intersection >= percent * union`` of their sets of distinct
    ``width``-word shingles (ASCII lower case; all words as one shingle if they are fewer). A
    text without words is linked with nothing. ``component_id`` is the least id that links
    reach; it is kept. Rows of one id, and rows without: see
    :func:`footfall.llm.common.one_row_per_document`.

    Candidates share one of 64 bands of 8 slots: with independent slots two texts whose
    similarity is exactly 0.8 would be missed with a chance of 8 in a million. In a simulation
    60,000 pairs of 4 and 5 shingles, 20,000 of 8 and 10 and 10,000 of 24 and 30 had no miss.
    There is no exact search for small sets besides.
    """
    docs = by_id(docs)
    small_batches(docs.sparkSession)
    signed = written(_signed(docs, width))
    sets = signed.where("n > 0")
    classes = written(sets.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")))

    # Buckets of two or more representatives, each hung below its least member.
    bands = sets.select(F.col("doc_id").alias("id"), "bands").join(classes.select("id").hint("merge"), "id", "left_semi")
    buckets = bands.select("id", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail")
    # Merged whatever the sizes: what is sent grows with the input, and skewed keys are split.
    mates = written(buckets.join(heads.select("key", "head").hint("merge"), "key"))
    # An id has a link for each of its bands at most.
    groups = star_components(mates.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))

    members = groups.join(classes.select("id", "n").hint("merge"), "id").select("id", F.col("component").alias("group"), "n")
    members = written(members)
    choice = [F.min(F.struct(F.xxhash64("id", F.lit(i)), F.col("id"))).alias(f"leader{i}") for i in range(LEADERS)]
    shape = members.groupBy("group").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"), *choice)
    shape = written(shape.select(
        "group", "blocks", F.array_distinct(F.array(*(F.col(f"leader{i}.id") for i in range(LEADERS)))).alias("leaders")))
    placed = written(members.join(shape.hint("merge"), "group").select(
        "id", "group", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")))
    # A leader visits every block of its group; one row carries the blocks of an id.
    leaders = shape.where("blocks > 1").select(
        F.explode("leaders").alias("id"), "group", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1).alias("at"))
    stays = placed.select("id", "group", F.array("block").alias("at")).unionAll(leaders)
    # Texts are moved once, for the sets of all members.
    own_sets = written(_with_sets(docs, placed.select("id"), width)).hint("merge")
    grouped = stays.join(own_sets, "id").select("id", "group", F.explode("at").alias("block"), "shingles")
    links = written(_inside_blocks(grouped, percent).where("a <> b"))
    parts = written(components(links))

    # Groups of several blocks whose members are not all united yet.
    of_part = placed.join(parts, "id", "left").select(
        "id", "group", "blocks", "block", F.coalesce("component", "id").alias("part")).where("blocks > 1")
    sizes = of_part.groupBy("group", "part").count()
    largest = sizes.groupBy("group").agg(F.max(F.struct("count", "part")).alias("top"), F.count("*").alias("n_parts"))
    apart = written(of_part.join(largest.where("n_parts > 1"), "group").select(
        "id", "group", "block", "part", (F.col("part") != F.col("top.part")).alias("outside")))
    if apart.limit(1).count():
        # A block is visited if the visitor's bucket has a member of another part there.
        there = mates.select("id", "key").join(apart.select("id", "group", "block", "part"), "id")
        at_key = there.groupBy("key", "group", "block").agg(F.min("part").alias("least"), F.max("part").alias("most"))
        guests = mates.select("id", "key").join(apart.where("outside").select("id", "part", F.col("block").alias("home")), "id")
        visits = guests.join(at_key, "key").where("(part <> least or part <> most) and block <> home").select(
            "id", "group", "block").distinct()
        own = apart.join(members.select("id", "n").hint("merge"), "id")
        able = _visits(_prefixes(own.join(own_sets, "id"), percent), percent)
        visits = written(visits.join(able.hint("merge"), ["id", "group", "block"], "left_semi"))
        # A task holds a block and a slice of its visitors; the block's members are in each slice.
        slices = written(visits.groupBy("group", "block").agg(F.ceil(F.count("*") / SLICE_VISITORS).alias("slices")))
        place = lambda slice: F.struct("block", slice.alias("slice"))
        dealt = visits.join(slices.hint("merge"), ["group", "block"]).select(
            "id", "group", place(F.pmod(F.xxhash64("id"), F.col("slices"))).alias("place"))
        dealt = dealt.groupBy("id", "group").agg(F.collect_list("place").alias("at")).withColumn("visits", F.lit(True))
        hosts = apart.join(slices.hint("merge"), ["group", "block"]).select(
            "id", "group", F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), place).alias("at"),
            F.lit(False).alias("visits"))
        met = dealt.unionByName(hosts).join(own_sets, "id").select(
            "id", "group", "visits", F.explode("at").alias("place"), "shingles").select(
            "id", "group", "visits", "place.block", "place.slice", "shingles")
        links = links.unionAll(written(_across_blocks(met, percent)))
        parts = components(links)

    united = classes.join(parts.hint("merge"), "id", "left").select(
        "one", "two", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", "n", "one", "two").join(united.hint("merge"), ["one", "two"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
