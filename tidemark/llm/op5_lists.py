"""URL filters with dated lists: every capture is judged by the list entries active when it was fetched.

List changes (key, action ``add`` or ``remove``, day) become intervals of validity: for each key the state after a day's changes
holds until the next day on which it changes, and equal neighbouring states merge. A removal on the day of an addition
wins. A key is a host, a parent domain of one, or a host with a path prefix; a capture meets all keys its own address
spells out: the host, each of its parent domains of two labels or more, and the host with each prefix of its path.

The as-of join is an equality join on key and period (``PERIOD`` days): intervals are cut at period borders, so a
popular key is spread over the periods of its captures, and within a period a capture meets only the few intervals that touch it.
Captures are first counted by distinct host, path prefix and day, so that a host with a third of all captures sends one
row for each of its days and prefixes.

A null or empty address, or one without a host, meets no key and is not blocked. A capture without a day meets nothing.
Rules with a null key, day or action are ignored; repeated changes count once. Repeated captures get equal results. Empty
tables give empty results, an empty list blocks nothing. All is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD = 30
FOREVER = 2**31 - 1


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user, port and a leading www; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path of an address without query, fragment and a trailing slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"/+$", "")


def keys_of(host: Column, path: Column) -> Column:
    """All keys that can cover an address: its domains and its path prefixes."""
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    # a host of one label is its own only domain
    domains = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(
        F.slice(labels, i + 1, F.size(labels) - i), "."))
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.concat(
        host, F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.when(path != "", prefixes).otherwise(
        F.array().cast("array<string>")))))


def intervals(changes: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (days, the end excluded) of every stretch in which a key is listed."""
    known = changes.where("key is not null and day is not null and action in ('add', 'remove')")
    # one state for each key and day; windows below run over the changes of one key
    daily = known.groupBy("key", "day").agg(F.min((F.col("action") == "add").cast("int")).alias("listed"))
    by_day = Window.partitionBy("key").orderBy("day")
    changed = daily.withColumn("before", F.coalesce(F.lag("listed").over(by_day), F.lit(0))).where("listed <> before")
    return changed.withColumn("valid_to", F.coalesce(F.lead("day").over(by_day), F.lit(FOREVER))).where(
        "listed = 1").select("key", F.col("day").alias("valid_from"), "valid_to")


def active_keys(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """url_host, url_path, day, n_active and first_key for each distinct host, path and day that meets an active entry.

    ``captures`` has url_host, url_path and day (days since 1970-01-01).
    """
    low, high = captures.agg(F.min("day")).scalar(), captures.agg(F.max("day")).scalar()
    distinct = captures.where("url_host <> '' and day is not null").distinct()
    period = lambda day: F.floor(day / F.lit(PERIOD)).cast("long")
    asked = distinct.withColumn("key", F.explode(keys_of(F.col("url_host"), F.col("url_path")))).withColumn(
        "period", period(F.col("day")))
    dated = intervals(changes).withColumns({"low": low, "high": high})  # the days captured; a listing may last forever
    cut = dated.where("valid_from <= high and valid_to > low").select("key", "valid_from", "valid_to", F.explode(F.sequence(
        period(F.greatest("valid_from", "low")), period(F.least(F.col("valid_to") - 1, F.col("high"))))).alias("period"))
    met = asked.join(cut, ["key", "period"]).where("day >= valid_from and day < valid_to")
    return met.groupBy("url_host", "url_path", "day").agg(F.count("*").alias("n_active"), F.min("key").alias("first_key"))


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, day) with host, n_active, first_key and blocked."""
    own = captures.select("page_id", "day", host_of(F.col("url")).alias("url_host"), path_of(F.col("url")).alias("url_path"))
    active = active_keys(own.select("url_host", "url_path", "day"), changes)
    return own.join(active, ["url_host", "url_path", "day"], "left").select(
        "page_id", F.col("url_host").alias("host"), "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "first_key", F.col("n_active").isNotNull().alias("blocked"))
