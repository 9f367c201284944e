"""URL filters: every capture is judged by the list entries that were active when it was made.

List entries are dated: a key (a domain with its subdomains, a path with what lies below it,
or one address) is added on a day and may be removed later. Entries become validity intervals.
A capture has a few keys: its host and the domains above it, its path and those above it, its
address. The distinct pairs of key and day, of which a frequent host has no more than there
are days, are joined with the intervals as of the day; captures then take up what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and closing dot; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)


def path_of(url: Column) -> Column:
    """Path as it stands, without closing slashes."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def address_of(url: Column) -> Column:
    """Host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(\?[^#]*)", 1))


def keys_of(url: Column) -> Column:
    """All keys under which a list may name an address; none without a host."""

    def of_parts(parts: Column) -> Column:
        host, path, address = parts["host"], parts["path"], parts["address"]
        labels, steps = F.split(host, r"\."), F.split(path, "/")
        domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
            F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(
            F.lit("path:"), host, F.array_join(F.slice(steps, F.lit(1), i), "/")))
        all_keys = F.concat(domains, paths, F.array(F.concat(F.lit("address:"), address)))
        return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_keys))

    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    return F.transform(F.array(parts), of_parts)[0]


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``(list, key, since, until)``, ``until`` exclusive, in which a key is listed.

    ``entries`` has ``list``, ``key``, ``day`` and ``action`` (``add`` or ``remove``). Repeated
    entries count once; of an addition and a removal on one day the removal holds. Entries with
    a null in any of the four are left out.
    """
    per_day = entries.dropna(subset=["list", "key", "day", "action"]).groupBy("list", "key", "day").agg(
        F.min(F.col("action") == "add").alias("listed"))
    later = Window.partitionBy("list", "key").orderBy("day")
    until = F.coalesce(F.lead("day").over(later), F.lit(FOREVER).cast("date"))
    return per_day.withColumn("until", until).where("listed").select("list", "key", F.col("day").alias("since"), "until")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``lists``: the sorted names of lists that had the address on the day.

    ``captures`` has ``url`` and ``fetched`` (a date). A row gives a row; a null or unreadable
    address, and a null day, is on no list. Columns named ``lists`` are replaced.
    """
    captures = captures.drop("lists")
    keyed = captures.select(F.col("fetched").alias("day"), F.explode(F.coalesce(keys_of(F.col("url")), F.array())).alias("key"))
    asked = keyed.where(F.col("day").isNotNull()).distinct()
    spans = validity(entries)
    active = asked.join(spans, "key").where((F.col("day") >= F.col("since")) & (F.col("day") < F.col("until")))
    found = active.groupBy("key", "day").agg(F.sort_array(F.collect_set("list")).alias("found"))

    # Captures with the same address and day are judged once.
    places = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    named = places.withColumn("key", F.explode(keys_of(F.col("url")))).join(
        found.withColumnRenamed("day", "fetched"), ["key", "fetched"])
    verdicts = named.groupBy("url", "fetched").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("lists"))
    joined = captures.join(verdicts, ["url", "fetched"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return joined.select(*captures.columns, lists.alias("lists"))
