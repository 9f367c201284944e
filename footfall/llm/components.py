"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written

MOST_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in the links ``(a, b)``; a component's name is its least id.

    Each round hangs the larger neighbours of every id, and then the smaller ones, below the
    least of them; links only ever shrink in number until each is ``(id, least)``. A hot id is
    met in partial aggregates and in joins that adaptive execution splits. Every round is
    written, so a lost executor costs a part of one round.
    """
    down = lambda rows: rows.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(down(links))
    for _ in range(MOST_ROUNDS):
        # Larger neighbours of each id go below its least neighbour (or itself).
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "least").alias("least"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.distinct())
        # Smaller neighbours, and the id itself, go below the least of them.
        least = _least(large)
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        new = written(down(small.unionAll(least.select("a", F.col("least").alias("b")))))
        # Settled: every id hangs below one other, and none of those hangs below another.
        shape = new.agg(F.count("*"), F.count_distinct("a")).first()
        edges = new
        if shape[0] == shape[1] and not new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
                roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
    raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")


def star_components(links: DataFrame) -> DataFrame:
    """The same for links ``(a, b)``, ``b`` the smaller, of which an ``a`` has a bounded number.

    Ids that are nobody's smaller neighbour are taken out first: each hangs below its least
    neighbour, and only what its neighbours are to one another goes through the rounds.
    """
    stars = written(links.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("near")))
    heads = stars.select(F.explode("near").alias("a")).distinct()
    between = stars.select(F.explode("near").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    own = stars.select("a", F.col("least").alias("b")).join(heads.hint("merge"), "a", "left_semi")
    core = written(components(between.unionAll(own)))
    names = core.select(F.col("id").alias("least"), "component").hint("merge")
    roots = heads.join(stars.select("a").hint("merge"), "a", "left_anti").select("a", F.col("a").alias("least"))
    return stars.select("a", "least").unionAll(roots).join(names, "least", "left").select(
        F.col("a").alias("id"), F.coalesce("component", "least").alias("component"))
