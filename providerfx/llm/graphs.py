"""Connected components of an edge table, by alternating large and small stars; all state stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.llm import blocks as B

#: Edges of a task, about: tables of edges shrink, and so do the tasks that make them.
TASK_EDGES = 250_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link: root is the smallest node of its component.

    edges: a table (a, b) of longs, which is read several times; rows with a null and links to itself count for nothing, repeated ones once. Each round
    is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the longest chain.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    n, mark = e.count(), None
    for _ in range(most_rounds):
        tasks = max(1, -(-n // TASK_EDGES))
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = B.written(large.coalesce(tasks), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("c", "m")).filter("u <> v").distinct().coalesce(tasks)
        e = B.written(small, "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == mark:
            break
        n, mark = now[0], now
    else:
        raise RuntimeError("components did not settle")
    # every node hangs on its root now; roots stand for themselves
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
