"""Clustered binary data: sizes and effects are drawn on the driver, records in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from providerfx.functions.columns import provider_name, sigmoid


def simulate_providers(spark: SparkSession, n_providers: int = 50, n_per_provider: float = 80, n_covariates: int = 5, event_rate: float = 0.2, gamma_sd: float = 0.5, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(y, x1..xp, id) and the truth (id, gamma): sizes max(2, Poisson), covariates N(0, 1), gammas shifted to the event rate."""
    if n_providers < 2 or n_per_provider < 2 or n_covariates < 1:
        raise ValueError("n_providers and n_per_provider must be 2 or more, n_covariates 1 or more")
    if not 0 < event_rate < 1 or gamma_sd < 0:
        raise ValueError("event_rate must lie between 0 and 1, gamma_sd must not be negative")
    rng = np.random.default_rng(seed)
    sizes = np.maximum(2, rng.poisson(n_per_provider, n_providers))
    gamma = rng.normal(0.0, gamma_sd, n_providers)
    beta = true_beta(n_covariates)
    rows = [(k + 1, int(s), float(g)) for k, (s, g) in enumerate(zip(sizes, gamma))]
    p = spark.createDataFrame(rows, "k int, size int, g double").withColumn("id", provider_name(F.col("k")))
    x = p.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("size"))))
    # random numbers by hash of (provider, record, column): the same whatever the partitioning
    u = lambda c: (F.xxhash64(F.lit(seed), F.col("k"), F.col("j"), F.lit(c)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    normal = lambda c: F.sqrt(-2 * F.ln(u(2 * c))) * F.cos(2 * np.pi * u(2 * c + 1))
    x = x.withColumns({f"x{c + 1}": normal(c) for c in range(n_covariates)})
    lin = sum((F.lit(float(b)) * F.col(f"x{c + 1}") for c, b in enumerate(beta)), F.col("g"))
    x = x.withColumn("lin", lin).cache()
    low, high = -30.0, 30.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if x.agg(F.avg(sigmoid(F.col("lin") + mid))).head()[0] < event_rate else (low, mid)
        if high - low < 1e-4:
            break
    x.unpersist()  # the numbers come from hashes, so they are the same when made again
    shift = (low + high) / 2
    y = (u(1_000_003) < sigmoid(F.col("lin") + shift)).cast("int").alias("y")
    return x.select(y, *(f"x{c + 1}" for c in range(n_covariates)), "id"), p.select("id", (F.col("g") + shift).alias("gamma"))


def true_beta(p: int) -> np.ndarray:
    return np.round(np.linspace(0.5, -0.5, p), 3)
