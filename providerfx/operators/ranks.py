"""Order statistics and running totals of many values without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values up to which Spark's exact median is taken, which gathers them; and about how many a bracket may hold.
MOST_GATHERED = 1_000_000
BRACKET = 100_000


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median, exactly: beyond MOST_GATHERED values from the few between two approximate quantiles and a count of those below."""
    n = df.agg(F.count(column)).head()[0]
    if n <= MOST_GATHERED:
        return df.agg(F.median(column)).head()[0]
    ranks, half = ((n - 1) // 2, n // 2), BRACKET / (2 * n)
    while True:
        half = min(half, 0.5)
        low, high = df.agg(F.percentile_approx(column, [0.5 - half, 0.5 + half], int(min(4 / half, 10_000_000)))).head()[0]
        below, inside = df.agg(F.count(F.when(F.col(column) < low, 1)), F.count(F.when(F.col(column).between(low, high), 1))).head()
        if below <= ranks[0] and ranks[1] < below + inside:
            break
        half *= 4
    at, found = below, []
    # equal values are one row, so the bracket holds few
    for r in df.filter(F.col(column).between(low, high)).groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect():
        found += [r[0]] * sum(at <= k < at + r["n"] for k in ranks)
        at += r["n"]
    return (found[0] + found[1]) / 2


def running_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """counts with `first`: the sum of n over all smaller keys. Keys are range-partitioned; only one total of each partition is gathered."""
    from providerfx.sources.io import ensure_checkpoint_dir

    ensure_checkpoint_dir(counts.sparkSession)
    c = counts.repartitionByRange(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals, before, rows = c.groupBy("_part").agg(F.sum(n).alias("t")).orderBy("_part").collect(), 0, []
    for r in totals:
        rows.append((r["_part"], before))
        before += r["t"]
    starts = F.broadcast(c.sparkSession.createDataFrame(rows, "_part int, _before long"))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("first", inner).join(starts, "_part").withColumn("first", (F.col("first") + F.col("_before")).cast("long")).drop("_part", "_before")
