import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from providerfx.operators import exact, one_shot, ranks
from tests.test_fits import dense, records, values


def test_median_without_gathering(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ranks, "MOST_GATHERED", 50)
    monkeypatch.setattr(ranks, "BRACKET", 40)
    for x in (rng.normal(size=4001), rng.normal(size=4000), np.repeat([1.0, 2.0, 2.0, 7.0], 500), np.concatenate([np.zeros(1000), np.ones(1000)])):
        assert ranks.exact_median(spark.createDataFrame(pd.DataFrame({"x": x})), "x") == np.median(x)
    assert ranks.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_offsets(spark):
    counts = spark.range(1000).selectExpr("id * 7 % 1000 as k", "id % 13 as n")
    want, at = {}, 0
    for r in sorted(counts.collect()):
        want[r["k"]], at = at, at + r["n"]
    assert {r["k"]: r["first"] for r in ranks.running_offsets(counts, "k", "n").collect()} == want


def test_one_provider_with_most_records(spark):
    pdf = records(m=5, seed=4)
    big = pdf[pdf["id"] == 2].sample(2000, replace=True, random_state=1)
    big[["z.0", "z.1"]] += np.random.default_rng(1).normal(0, 0.3, (2000, 2))
    pdf = pd.concat([pdf, big])
    g, b = dense(pdf, 2)
    for options in ({}, {"max_local": 0}):
        f = exact.fit_exact(spark.createDataFrame(pdf).drop("n"), "y", "id", tol=1e-9, **options)
        assert np.allclose(f.slopes, b, atol=1e-6) and np.allclose(values(f), g, atol=1e-6)
        f.close()


def test_likelihood_at_the_fit(spark):
    df = spark.createDataFrame(records(m=5)).drop("n")
    f = exact.fit_exact(df, "y", "id", tol=1e-10)
    got = exact.likelihood_at(df, "y", "id", f.gamma, f.slopes)
    assert np.isclose(got["penalised"], f.loglik) and np.isclose(got["neg2_loglik"], f.neg2_loglik) and np.isclose(got["log_det"], f.log_det)


def test_one_shot_reports(spark):
    df = spark.createDataFrame(records(m=6)).drop("n").withColumn("block", F.when(F.col("id") > 2, F.col("id") % 2))
    f = one_shot.fit_one_shot(df, "y", "id", block="block", tol=1e-10, clamp="median")
    assert f.converged and f.blocks == 2 and 1 < f.iterations < 100 and f.gamma.count() == 6
    assert not one_shot.fit_one_shot(df, "y", "id", block="block", max_iter=1).converged
    assert one_shot.fit_one_shot(df.drop("block"), "y", "id").blocks == 1
    f.close()


def test_two_passes_and_many_covariates(spark):
    pdf = records(m=6, p=2, seed=6)
    g, b = dense(pdf, 2)
    for options in ({}, {"max_local": 0}):
        f = exact.fit_exact(spark.createDataFrame(pdf).drop("n"), "y", "id", tol=1e-9, passes=2, **options)
        assert np.allclose(f.slopes, b, atol=1e-6) and np.allclose(values(f), g, atol=1e-6)
        f.close()
    wide = pd.concat([records(m=6, p=10, seed=s) for s in range(4)])
    g, b = dense(wide, 10)
    f = exact.fit_exact(spark.createDataFrame(wide).drop("n"), "y", "id", tol=1e-9)
    assert np.allclose(f.slopes, b, atol=1e-6) and np.allclose(values(f), g, atol=1e-6)
    f.close()
