"""One pass over the records: the per-provider sums that a Newton step of the Firth likelihood needs.

With v = w (1/2 - prob) the adjusted score depends on the inverse Schur complement only through contractions of
sums of v z z z, so information and score come from a single aggregation. Covariates are centred by their global
means first, which keeps third moments well conditioned and changes no slope. With many covariates the sums of v are
left out, and scores() is a second pass over the records once the inverse is known.
"""

from __future__ import annotations

from itertools import combinations_with_replacement as multisets

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from providerfx.functions.columns import sigmoid, softplus, weight


def monomials(p: int, fused: bool = True) -> list[tuple[str, tuple[int, ...]]]:
    """(kind, indices): w up to degree 2, and if fused v up to 3 and r up to 1."""
    return [(kind, i) for kind, top in (("w", 2), ("v", 3), ("r", 1))[: 3 if fused else 1] for d in range(top + 1) for i in multisets(range(p), d)]


def name(kind: str, i: tuple[int, ...]) -> str:
    return kind + "".join(f"_{k}" for k in i)


def eta_column(gamma: Column, beta: np.ndarray) -> Column:
    e = gamma
    for k, b in enumerate(beta):
        e = e + F.lit(float(b)) * F.col(f"z{k + 1}")
    return e


def with_weights(rows: DataFrame, gamma: Column, beta: np.ndarray, means: np.ndarray) -> DataFrame:
    """rows with _eta, _prob, the weight w, v, the residual r and centred covariates c0..."""
    p = len(beta)
    x = rows.withColumn("_eta", eta_column(gamma, beta)).withColumn("_prob", sigmoid(F.col("_eta")))
    x = x.withColumn("w", weight(F.col("n"), F.col("_prob")))
    return x.withColumns({"v": F.col("w") * (0.5 - F.col("_prob")), "r": F.col("y") - F.col("n") * F.col("_prob"), **{f"c{k}": F.col(f"z{k + 1}") - float(means[k]) for k in range(p)}})


def moments(rows: DataFrame, gamma: Column, beta: np.ndarray, means: np.ndarray, fused: bool = True) -> DataFrame:
    """(pid, sums, ll) by provider; rows hold pid, y, n, z1..zp and what `gamma` reads."""
    x, sums = with_weights(rows, gamma, beta, means), []
    for kind, i in monomials(len(beta), fused):
        e = F.col(kind)
        for k in i:
            e = e * F.col(f"c{k}")
        sums.append(F.sum(e).alias(name(kind, i)))
    return x.groupBy("pid").agg(*sums, F.sum(F.col("_eta") * F.col("y") - F.col("n") * softplus(F.col("_eta"))).alias("ll"), F.sum("y").alias("y"), F.sum("n").alias("n"), F.count("*").alias("n_records"))


def scores(rows: DataFrame, beta: np.ndarray, means: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """(pid, u, u_0...) by provider: sums of the adjusted residuals, and of these times the covariates centred by provider.

    rows hold pid, y, n, z1..zp, gamma, and of the provider w and w_0...
    """
    p = len(beta)
    x = rows.withColumnsRenamed({"w": "_w", **{f"w_{k}": f"_w_{k}" for k in range(p)}})
    x = with_weights(x, F.col("gamma"), beta, means)
    x = x.withColumns({f"d{k}": F.col(f"c{k}") - F.col(f"_w_{k}") / F.col("_w") for k in range(p)})
    h = 1.0 / F.col("_w")
    for a in range(p):
        for b in range(a, p):
            h = h + float(inverse[a, b] * (1 if a == b else 2)) * F.col(f"d{a}") * F.col(f"d{b}")
    x = x.withColumn("u", F.col("r") + F.col("v") * h)
    return x.groupBy("pid").agg(F.sum("u").alias("u"), *(F.sum(F.col("u") * F.col(f"d{k}")).alias(f"u_{k}") for k in range(p)))


class Tables:
    """Moments as arrays: by provider and symmetric in the indices."""

    def __init__(self, pdf, p: int):
        m = len(pdf)
        get = lambda kind, i: pdf[name(kind, tuple(sorted(i)))].to_numpy(float)
        self.p, self.m = p, m
        self.w0 = get("w", ())
        vec = lambda kind: np.stack([get(kind, (a,)) for a in range(p)], 1) if p else np.zeros((m, 0))
        mat = lambda kind: np.stack([get(kind, (a, b)) for a in range(p) for b in range(p)], 1).reshape(m, p, p) if p else np.zeros((m, 0, 0))
        self.w1, self.w2 = vec("w"), mat("w")
        self.ig = 1.0 / self.w0
        self.j = self.w1 * self.ig[:, None]
        if "v" not in pdf:
            return
        self.v0, self.r0, self.v1, self.r1, self.v2 = get("v", ()), get("r", ()), vec("v"), vec("r"), mat("v")
        self.v3 = np.stack([get("v", (a, b, c)) for a in range(p) for b in range(p) for c in range(p)], 1).reshape(m, p, p, p) if p else np.zeros((m, 0, 0, 0))

    def schur(self) -> np.ndarray:
        """This part's share of the Schur complement."""
        return (self.w2 - self.j[:, :, None] * self.w1[:, None, :]).sum(0)

    def scores(self, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adjusted score of each provider's intercept, and this part's share of -H."""
        j, v0, v1, v2, v3 = self.j, self.v0, self.v1, self.v2, self.v3
        c1 = v1 - j * v0[:, None]
        c2 = v2 - j[:, :, None] * v1[:, None, :] - v1[:, :, None] * j[:, None, :] + v0[:, None, None] * j[:, :, None] * j[:, None, :]
        s = inverse
        quad = np.einsum("mabc,bc->ma", v3, s) - 2 * np.einsum("mab,bc,mc->ma", v2, s, j) + v1 * np.einsum("ma,ab,mb->m", j, s, j)[:, None]
        c3 = quad - j * np.einsum("mbc,bc->m", c2, s)[:, None]
        sg = self.r0 + self.ig * v0 + np.einsum("mab,ab->m", c2, s)
        return sg, ((self.r1 - self.r0[:, None] * j) + self.ig[:, None] * c1 + c3).sum(0)


def inverse_of(schur: np.ndarray, names: list[str]) -> np.ndarray:
    """The inverse of a positive definite matrix, or an error that names collinear covariates."""
    if not len(schur):
        return schur
    scale = np.sqrt(np.maximum(np.diag(schur), 1e-300))
    values, vectors = np.linalg.eigh(schur / np.outer(scale, scale))
    if not np.isfinite(schur).all() or values[0] < 1e-12:
        involved = [c for c, x in zip(names, np.abs(vectors[:, 0])) if x > 0.1]
        raise ValueError(f"the information matrix is singular; collinear or constant within providers: {', '.join(involved)}")
    return np.linalg.inv(schur)


def log_det(schur: np.ndarray) -> float:
    """Log determinant by Cholesky, with a ridge of 1e-8 on a second try."""
    if not len(schur):
        return 0.0
    for ridge in (0.0, 1e-8):
        try:
            return float(2 * np.log(np.diag(np.linalg.cholesky(schur + ridge * np.eye(len(schur))))).sum())
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the information matrix is not positive definite")
