"""Running successes and trials by provider of a stream; an addition, since batch fits need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.functions.columns import col


def provider_totals(stream: DataFrame, success: str, provider: str, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, pid, y, n, gamma): totals of a window and the intercept that a fit without covariates gives it."""
    kept = stream.withWatermark(time, delay).groupBy(F.window(time, window), col(provider).alias("pid"))
    out = kept.agg(F.sum(col(success).cast("double")).alias("y"), F.count("*").alias("n"))
    return out.withColumn("gamma", F.ln((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5)))
