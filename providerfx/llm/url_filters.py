"""URL filters: dated list entries become validity intervals; each capture is held against the entries active when it was fetched.

DataFrame functions only. Captures are first reduced to distinct (host, day), which bounds what a popular host
costs; the as-of join runs on these, by equality of list entry and host suffix. Hosts are salted and list entries
repeated for each salt, so that a parent domain with very many hosts is not one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of the hosts below one list entry.
SALTS = 8


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a closing dot; null without a scheme or a host."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(entry, action 'add' or 'remove', day) to (entry, since, until): active from `since` on, before `until` (null: open).

    Rows with a null count for nothing; of several actions of one entry on one day the removal holds; repeated
    rows count once.
    """
    day = entries.filter("entry is not null and action in ('add', 'remove') and day is not null").groupBy(F.lower("entry").alias("entry"), "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("entry").orderBy("day")
    return day.withColumn("until", F.lead("day").over(w)).filter("action = 'add'").select("entry", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with host, n_active (active entries among the host and its parents), blocked, entry and since (of the longest).

    A null URL, one without a host, or a null day matches nothing. Repeated rows stay; columns named like a result
    column are replaced. Empty captures give an empty result, an empty list blocks nothing.
    """
    made = ["host", "n_active", "blocked", "entry", "since"]
    base = captures.drop(*(c for c in made if c not in (url, day))).withColumn("host", host_of(F.col(f"`{url}`")))
    asked = base.select("host", F.col(f"`{day}`").alias("_day")).filter("host is not null and _day is not null").distinct()
    keys = asked.select("host", "_day", F.explode(suffixes(F.col("host"))).alias("_key"), F.pmod(F.xxhash64("host", "_day"), F.lit(SALTS)).alias("_salt"))
    held = validity_intervals(entries).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_part"))
    hit = keys.join(held, (F.col("_key") == F.col("entry")) & (F.col("_salt") == F.col("_part")) & (F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    best = F.max(F.struct(F.length("entry"), F.col("entry"), F.col("since")))
    verdict = hit.groupBy(F.col("host").alias("_host"), "_day").agg(F.count("*").alias("n_active"), best.alias("_best"))
    out = base.join(verdict, (F.col("host") == F.col("_host")) & (F.col(f"`{day}`") == F.col("_day")), "left")
    return out.withColumns({"n_active": F.coalesce("n_active", F.lit(0).cast("long")), "blocked": F.col("_best").isNotNull(), "entry": F.col("_best.entry"), "since": F.col("_best.since")}).drop("_host", "_day", "_best")
