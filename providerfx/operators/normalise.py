"""Any DataFrame to records (pid, y, n, z1..zp), and the relational operators on them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from providerfx.functions.columns import col

#: Most providers whose sizes the driver takes to balance blocks; beyond, blocks are dealt by hash.
MAX_GREEDY = 200_000


def features_of(df: DataFrame, taken: list[str], features=None, exclude=()) -> list[str]:
    """The named features (a list, or names with commas), else every column that is not taken or excluded."""
    if features is None:
        return [c for c in df.columns if c not in {*taken, *exclude}]
    names = [c.strip() for c in features.split(",")] if isinstance(features, str) else list(features)
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return names


def normalise(df: DataFrame, success: str, provider: str, trials: str | None = None, features=None, exclude=(), cutoff: int = 0) -> tuple[DataFrame, list[str]]:
    """Records (pid, y, n, z1..zp) and the features' names.

    Covariates become doubles, null or unreadable ones 0; without trials n is 1. The id keeps its type. Rows whose
    id, success or trials are null are left out. cutoff: providers with fewer rows are left out.
    """
    for c in (success, provider, *([trials] if trials else [])):
        if c not in df.columns:
            raise ValueError(f"no such column: {c}")
    names = features_of(df, [success, provider, *([trials] if trials else [])], features, exclude)
    number = lambda c: col(c).try_cast("double")
    z = [F.coalesce(number(c), F.lit(0.0)).alias(f"z{k + 1}") for k, c in enumerate(names)]
    out = df.select(col(provider).alias("pid"), number(success).alias("y"), (number(trials) if trials else F.lit(1.0)).alias("n"), *z)
    out = out.filter("pid is not null and y is not null and n is not null")
    return (at_least(out, cutoff) if cutoff > 0 else out), names


def at_least(rows: DataFrame, cutoff: int) -> DataFrame:
    """Rows of providers with at least `cutoff` rows. Sizes are combined before the shuffle; a large provider is not gathered."""
    sizes = rows.groupBy("pid").count().filter(F.col("count") >= cutoff).select("pid")
    return rows.join(sizes, "pid", "left_semi")


def provider_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid").agg(F.count("*").alias("n_records"))


def with_sizes(rows: DataFrame) -> DataFrame:
    """Each row with its provider's number of rows."""
    return rows.withColumn("n_records", F.count("*").over(Window.partitionBy("pid")))


def check_binary(df: DataFrame, success: str) -> None:
    if df.filter(~F.coalesce(col(success).try_cast("double").isin(0.0, 1.0), F.lit(False))).limit(1).count():
        raise ValueError(f"{success} must be 0 or 1 everywhere")


def start_value(rows: DataFrame) -> float:
    """Logit of the mean; at 0 or 1 of the totals with half a success and half a failure more."""
    y, n = rows.agg(F.sum("y"), F.sum("n")).head()
    if not n:
        raise ValueError("no records")
    import math

    return math.log(y / (n - y)) if 0 < y < n else math.log((y + 0.5) / (n - y + 0.5))


def greedy_blocks(rows: DataFrame, blocks: int) -> tuple[DataFrame, bool]:
    """(pid, block): providers largest first, each to the least loaded block (ties: lower block, lower id); False if dealt by hash."""
    counts = provider_counts(rows)
    sizes = counts.orderBy(F.desc("n_records"), "pid").limit(MAX_GREEDY + 1).collect()
    if len(sizes) > MAX_GREEDY:
        return counts.select("pid", hashed_block(blocks).alias("block")), False
    load, out = [(0, k) for k in range(blocks)], []
    for r in sizes:
        total, k = heapq.heappop(load)
        out.append((r["pid"], k))
        heapq.heappush(load, (total + r["n_records"], k))
    return rows.sparkSession.createDataFrame(out, f"pid {rows.schema['pid'].dataType.simpleString()}, block int"), True


def hashed_block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")
