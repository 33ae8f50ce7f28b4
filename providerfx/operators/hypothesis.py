"""Tests of every provider's effect in one pass over the records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.functions.columns import chi2_p, normal_p, sigmoid, softplus, verdict, weight
from providerfx.operators import moments as M
from providerfx.operators.exact import MAX_LOCAL, Fit
from providerfx.operators.ranks import exact_median

METHODS = ("wald", "score", "lrt")


def null_value(fit: Fit, null="median") -> float:
    """The exact median of the gammas, or the number given."""
    if isinstance(null, str):
        if null != "median":
            raise ValueError("null must be 'median' or a number")
        return exact_median(fit.gamma, "gamma")
    return float(null)


def test_providers(fit: Fit, method: str = "wald", null="median", alpha: float = 0.05, firth: bool = False, providers=None) -> DataFrame:
    """(pid, gamma_est, stat, p, flag, verdict) of each provider, or of the ids given.

    wald: (gamma - null) / se. score: sum of residuals at the null over its standard deviation, slopes as fitted.
    lrt: twice the drop in likelihood when this gamma alone becomes the null, without refit; with firth, of the
    penalised likelihood. flag: 1 above, -1 below, 0 not significant, null where p is.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    at = null_value(fit, null)
    p, slopes, means, schur = len(fit.names), fit.slopes, fit.means, fit.schur
    keep = (lambda d: d) if providers is None else (lambda d: d.filter(F.col("pid").isin(list(providers))))
    info = keep(fit.info)
    if method != "wald":
        x = keep(fit.rows).join(keep(fit.gamma), "pid") if fit.n_providers > MAX_LOCAL else keep(fit.rows).join(F.broadcast(keep(fit.gamma)), "pid")
        x = x.withColumn("_null", M.eta_column(F.lit(at), slopes)).withColumn("_full", M.eta_column(F.col("gamma"), slopes))
        x = x.withColumn("_p0", sigmoid(F.col("_null"))).withColumn("_w0", weight(F.col("n"), F.col("_p0")))
        cells = {"_res": F.col("y") - F.col("n") * F.col("_p0"), "_drop": (F.col("_null") - F.col("_full")) * F.col("y") - F.col("n") * (softplus(F.col("_null")) - softplus(F.col("_full")))}
        for i in [i for kind, i in M.monomials(p) if kind == "w"]:
            e = F.col("_w0")
            for k in i:
                e = e * (F.col(f"z{k + 1}") - float(means[k]))
            cells["_" + M.name("w", i)] = e
        info = info.join(x.groupBy("pid").agg(*(F.sum(e).alias(c) for c, e in cells.items())), "pid")
    kind = fit.rows.schema["pid"].dataType.simpleString()

    def finish(batches):
        inverse = np.linalg.inv(schur) if p else schur
        whole = np.linalg.slogdet(schur)[1] if p else 0.0
        for b in batches:
            gamma, t = b["gamma"].to_numpy(float), M.Tables(b, p)
            if method == "wald":
                j = t.j + means
                stat = (gamma - at) / np.sqrt(t.ig + np.einsum("ma,ab,mb->m", j, inverse, j))
                pv, sign = normal_p(stat), stat
            elif method == "score":
                stat = b["_res"].to_numpy(float) / np.sqrt(b["_w"].to_numpy(float))
                pv, sign = normal_p(stat), stat
            else:
                drop = b["_drop"].to_numpy(float)
                if firth:
                    own = b.drop(columns=[M.name(k, i) for k, i in M.monomials(p) if k == "w"]).rename(columns={"_" + M.name("w", i): M.name("w", i) for k, i in M.monomials(p) if k == "w"})
                    o = M.Tables(own, p)
                    part = lambda q: q.w2 - q.j[:, :, None] * q.w1[:, None, :]
                    det = np.linalg.slogdet(schur[None] - part(t) + part(o))[1] if p else np.zeros(len(b))
                    drop = drop + 0.5 * (np.log(np.maximum(o.w0, 1e-12)) - np.log(np.maximum(t.w0, 1e-12)) + det - whole)
                stat, sign = -2.0 * drop, gamma - at
                pv = chi2_p(stat)
            flag = np.where(pv < alpha, np.where(sign > 0, 1, -1), 0)
            yield pd.DataFrame({"pid": b["pid"], "gamma_est": gamma, "stat": stat, "p": pv, "flag": pd.array(np.where(np.isnan(pv), 0, flag), dtype="Int32").astype("Int32")}).assign(flag=lambda d: d["flag"].mask(d["p"].isna()))

    out = info.mapInPandas(finish, f"pid {kind}, gamma_est double, stat double, p double, flag int")
    return out.withColumn("verdict", verdict(F.col("flag")))


test_providers.__test__ = False
