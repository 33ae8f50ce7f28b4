import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from providerfx.operators.exact import fit_exact
from providerfx.operators.hypothesis import test_providers as provider_tests
from providerfx.operators.normalise import greedy_blocks, normalise
from providerfx.operators.one_shot import fit_one_shot


def records(m=8, p=2, seed=1, trials=False):
    rng = np.random.default_rng(seed)
    ids = np.repeat(np.arange(m), rng.integers(15, 40, m))
    z = rng.normal(1.0, 1.0, (len(ids), p))
    gamma = rng.normal(-0.5, 0.5, m)
    prob = 1 / (1 + np.exp(-(gamma[ids] + z @ np.linspace(0.4, -0.3, p))))
    n = rng.integers(1, 5, len(ids)) if trials else np.ones(len(ids), int)
    return pd.DataFrame({"id": ids, "y": rng.binomial(n, prob), "n": n, **{f"z.{k}": z[:, k] for k in range(p)}})


def dense(pdf, p):
    """Newton on all m + p parameters with the dense hat diagonal."""
    ids = pdf["id"].to_numpy()
    x = np.concatenate([np.eye(ids.max() + 1)[ids], pdf[[f"z.{k}" for k in range(p)]].to_numpy()], 1)
    y, n, b = pdf["y"].to_numpy(float), pdf["n"].to_numpy(float), np.zeros(x.shape[1])
    for _ in range(100):
        prob = 1 / (1 + np.exp(-x @ b))
        w = n * prob * (1 - prob)
        info = (x * w[:, None]).T @ x
        h = w * np.einsum("ia,ab,ib->i", x, np.linalg.inv(info), x)
        step = np.linalg.solve(info, x.T @ (y - n * prob + h * (0.5 - prob)))
        b = b + step
        if abs(step).max() < 1e-12:
            break
    return b[: ids.max() + 1], b[ids.max() + 1 :]


def values(fit):
    return np.array([r["gamma"] for r in fit.gamma.orderBy("pid").collect()])


@pytest.mark.parametrize("trials", [False, True])
def test_exact_is_the_dense_fit(spark, trials):
    pdf = records(trials=trials)
    g, b = dense(pdf, 2)
    for options in ({}, {"max_local": 0}, {"num_partitions": 2, "damping": True}, {"stop": "all"}):
        f = fit_exact(spark.createDataFrame(pdf.sample(frac=1, random_state=3)), "y", "id", "n" if trials else None, features="z.0,z.1", tol=1e-9, **options)
        assert np.allclose(f.slopes, b, atol=1e-6) and np.allclose(values(f), g, atol=1e-6) and f.converged
        f.close()


def test_binomial_rows_equal_expanded_ones(spark):
    pdf = records(trials=True)
    one = [(r.id, int(k < r.y), r[3], r[4]) for r in pdf.itertuples(index=False) for k in range(r.n)]
    a = fit_exact(spark.createDataFrame(pdf), "y", "id", "n", tol=1e-9)
    b = fit_exact(spark.createDataFrame(pd.DataFrame(one, columns=["id", "y", "z.0", "z.1"])), "y", "id", tol=1e-9)
    assert np.allclose(a.slopes, b.slopes, atol=1e-7) and np.allclose(values(a), values(b), atol=1e-7)


def test_no_covariates_no_events_and_string_ids(spark):
    df = spark.createDataFrame([("a", 0)] * 6 + [("b", 1)] * 2 + [("b", 0)] * 3 + [(None, 1), ("b", None)], "id string, y int")
    f = fit_exact(df, "y", "id", features=[], tol=1e-10)
    assert np.allclose(values(f), [np.log(0.5 / 6.5), np.log(2.5 / 3.5)], atol=1e-7)
    assert fit_exact(df, "y", "id", features=[], cutoff=6).n_providers == 1


def test_one_block_is_the_exact_fit(spark):
    pdf = records(m=5)
    df = spark.createDataFrame(pdf).drop("n")
    a, b = fit_exact(df, "y", "id", tol=1e-10, clamp="absolute"), fit_one_shot(df, "y", "id", num_blocks=1, tol=1e-10)
    assert np.allclose(list(a.beta.values()), list(b.beta.values()), atol=1e-7) and np.allclose(values(a), values(b), atol=1e-6)
    blocks = greedy_blocks(normalise(df, "y", "id")[0], 3)[0].collect()
    assert sorted(r["pid"] for r in blocks) == list(range(5))


def test_collinear_and_bad_arguments(spark):
    df = spark.createDataFrame(records(m=3)).drop("n").withColumn("twice", F.col("`z.0`") * 2)
    with pytest.raises(ValueError, match="collinear"):
        fit_exact(df, "y", "id")
    for bad in ({"stop": "x"}, {"clamp": "x"}, {"features": ["nope"]}):
        with pytest.raises(ValueError):
            fit_exact(df, "y", "id", **bad)


def test_provider_tests(spark):
    pdf = records(m=6)
    f = fit_exact(spark.createDataFrame(pdf).drop("n"), "y", "id", tol=1e-10)
    got = {(m, c): provider_tests(f, m, firth=c).orderBy("pid").toPandas() for m, c in (("wald", False), ("score", False), ("lrt", False), ("lrt", True))}
    for t in got.values():
        assert np.allclose(t["gamma_est"], values(f)) and t["p"].between(0, 1).all()
    ids, z = pdf["id"].to_numpy(), pdf[["z.0", "z.1"]].to_numpy()
    x, g = np.concatenate([np.eye(6)[ids], z], 1), values(f)
    y, null = pdf["y"].to_numpy(), np.median(g)

    def penalised(gamma, firth):
        eta = gamma[ids] + z @ f.slopes
        prob = 1 / (1 + np.exp(-eta))
        ll = (eta * y - np.logaddexp(0, eta)).sum()
        return ll + firth * 0.5 * np.linalg.slogdet((x * (prob * (1 - prob))[:, None]).T @ x)[1]

    for firth in (False, True):
        for k in range(6):
            other = g.copy()
            other[k] = null
            assert np.isclose(got["lrt", firth]["stat"][k], -2 * (penalised(other, firth) - penalised(g, firth)), atol=1e-6)
    prob = 1 / (1 + np.exp(-(g[ids] + z @ f.slopes)))
    se = np.sqrt(np.diag(np.linalg.inv((x * (prob * (1 - prob))[:, None]).T @ x)))[:6]
    assert np.allclose(got["wald", False]["stat"], (g - null) / se, atol=1e-6)
    assert provider_tests(f, "score", null=0.0, providers=[2]).count() == 1
    with pytest.raises(ValueError):
        provider_tests(f, "other")
