"""URL filters over time: dated list entries become validity intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_limit
from .common import SALTS

FAR = 1 << 62


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]*([^?#\s]*)", 1)


def url_keys(url: Column) -> Column:
    """What a list entry may name: the host, each parent domain of two labels or more, and host with each path folder."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    folders = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, folders)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, at, action) to (list, pattern, valid_from, valid_to): from each add up to the next remove.

    Repeated entries count once; an add and a remove at the same instant are an add. Entries with a null list, pattern
    or instant, and actions other than add and remove, say nothing.
    """
    known = entries.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    daily = known.groupBy("list", "pattern", "at").agg(F.max(F.col("action") == "add").alias("on"))
    history = Window.partitionBy("list", "pattern").orderBy("at")
    turns = daily.withColumn("was", F.lag("on", 1, False).over(history)).where(F.col("on") != F.col("was"))
    spans = turns.withColumn("valid_to", F.lead("at", 1, FAR).over(history)).where("on")
    return spans.select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, entries: DataFrame, allow: list[str]) -> DataFrame:
    """As-of join of captures (page_id, url, fetched_at) with the entries active at fetched_at.

    One row per distinct capture: page_id, host, fetched_at, n_active, lists (sorted), blocked: an entry of a list that
    is not in `allow` is active and none of `allow` is. A null or unreadable url or a null time has no active entry.
    Intervals are broadcast if counted to fit; else a key's captures are salted and its intervals are copied to the
    salts, so a host with a third of all captures is dealt to many tasks.
    """
    spans = validity_intervals(entries)
    keyed = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at", F.explode_outer(url_keys(F.col("url"))).alias("key"))
    size = spans.agg(F.count("*").alias("n"), F.max(F.length("pattern")).alias("w")).first()
    during = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to"))
    if size["n"] * (64 + (size["w"] or 0)) <= broadcast_limit(captures.sparkSession):
        met = keyed.join(F.broadcast(spans), (F.col("key") == F.col("pattern")) & during, "left")
    else:
        left = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "fetched_at"), F.lit(SALTS)).cast("int"))
        right = spans.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.join(right, (F.col("key") == F.col("pattern")) & (F.col("_salt") == F.col("_salt2")) & during, "left")
    found = met.groupBy("page_id", "host", "fetched_at").agg(
        F.count("list").alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"),
    )
    permitted = F.arrays_overlap("lists", F.array(*[F.lit(x) for x in allow]))
    return found.withColumn("blocked", (F.col("n_active") > 0) & ~permitted)
