"""Exact fit: Newton iterations on the Firth-penalised likelihood, one aggregation each, or two with many covariates.

Up to MAX_LOCAL providers the state (one gamma per provider) is held on the driver and broadcast, since its size is then
proven small; records stay where they are read, and only sums of each provider move, combined before they do. Beyond,
records are dealt once by provider and salt, so a large provider is in several tasks, the state is a table dealt
like them, and only p x p sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.operators import moments as M
from providerfx.operators.normalise import normalise, start_value
from providerfx.operators.ranks import exact_median

#: Most providers whose state the driver holds: 16 bytes each, broadcast in every iteration.
MAX_LOCAL = 200_000
#: Parts of a provider's records where the state is a table.
SALTS = 8
#: Most covariates whose third moments are taken in the same pass.
MOST_FUSED = 8
STOPS = ("beta", "relch", "ratch", "all", "or")


@dataclass
class Fit:
    """A fit: slopes, one gamma per provider, and what the tests need."""

    rows: DataFrame
    names: list[str]
    beta: dict[str, float]
    gamma: DataFrame  # pid, gamma
    info: DataFrame  # pid, moments at the fit
    loglik: float  # penalised
    neg2_loglik: float  # of the plain likelihood
    log_det: float
    iterations: int
    crit: float
    converged: bool
    n_records: int
    n_providers: int
    event_rate: float
    means: np.ndarray
    schur: np.ndarray
    history: list[float] = field(default_factory=list)
    clamped: int = 0

    @property
    def slopes(self) -> np.ndarray:
        return np.array(list(self.beta.values()))

    def beta_table(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(list(self.beta.items()) or [], "feature string, beta double")

    def history_table(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(list(enumerate(self.history)), "iter int, loglik double")

    def close(self) -> None:
        self.rows.unpersist()


class State:
    """gamma by provider, on the driver or as a table."""

    def __init__(self, rows: DataFrame, p: int, names: list[str], start: float, local: bool, parts: int, fused: bool):
        self.rows, self.p, self.names, self.local, self.parts, self.fused = rows, p, names, local, parts, fused
        self.start, self.table = start, None

    def joined(self, table: DataFrame) -> DataFrame:
        """The records with a table of providers, without moving them."""
        if self.local:
            return self.rows.join(F.broadcast(table), "pid")
        return self.rows.join(table.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS))))), ["pid", "_salt"])

    def moments(self, beta: np.ndarray, means: np.ndarray) -> DataFrame:
        if self.table is None:
            return M.moments(self.rows, F.lit(self.start), beta, means, self.fused)
        return M.moments(self.joined(self.table), F.col("gamma"), beta, means, self.fused)

    def second_pass(self, inverse: np.ndarray) -> DataFrame:
        """(pid, u, u_0...) at the state of the last take()."""
        cols = ["gamma", "w", *(f"w_{k}" for k in range(self.p))]
        kind = self.rows.schema["pid"].dataType.simpleString()
        table = self.rows.sparkSession.createDataFrame(self.pdf[["pid", *cols]], f"pid {kind}, " + ", ".join(f"{c} double" for c in cols)) if self.local else self.found.select("pid", *cols)
        return M.scores(self.joined(table), self.beta, self.means, inverse)

    def take(self, beta: np.ndarray, means: np.ndarray) -> None:
        """One pass over the records; sets what the step needs."""
        self.beta, self.means = beta, means
        found = self.moments(beta, means)
        if self.table is not None:
            found = found.join(F.broadcast(self.table) if self.local else self.table, "pid")
        else:
            found = found.withColumn("gamma", F.lit(self.start))
        if self.local:
            self.pdf = found.toPandas()
            self.tables = M.Tables(self.pdf, self.p)
            self.schur, self.ll = self.tables.schur(), float(self.pdf["ll"].sum())
            self.log_w = float(np.log(np.maximum(self.tables.w0, 1e-12)).sum())
        else:
            found = found.repartition(self.parts, "pid").checkpoint()
            self.found, p = found, self.p

            def share(batches):
                for b in batches:
                    t = M.Tables(b, p)
                    yield pd.DataFrame({"s": [t.schur().ravel().tolist()], "ll": [b["ll"].sum()], "w": [np.log(np.maximum(t.w0, 1e-12)).sum()]})

            cells = [F.sum(F.col("s")[k]) for k in range(p * p)]
            got = found.mapInPandas(share, "s array<double>, ll double, w double").agg(F.sum("ll"), F.sum("w"), *cells).head()
            self.ll, self.log_w, self.schur = got[0], got[1], np.array(got[2:], float).reshape(p, p)

    def penalised(self) -> float:
        return self.ll + 0.5 * (self.log_w + M.log_det(self.schur))

    def step(self, inverse: np.ndarray, means: np.ndarray, size: float, clamp: str, bound: float) -> tuple[np.ndarray, float, int]:
        """The scaled step of beta, the largest move of a gamma, and how many gammas the clamp holds."""
        if self.local:
            if self.fused:
                sg, down = self.tables.scores(inverse)
            else:
                got = self.pdf[["pid"]].merge(self.second_pass(inverse).toPandas(), on="pid", how="left")
                sg, down = got["u"].to_numpy(), np.array([got[f"u_{k}"].sum() for k in range(self.p)])
            db = size * (inverse @ down if self.p else down)
            dg = size * self.tables.ig * sg - (self.tables.j + means) @ db
            old = self.pdf["gamma"].to_numpy()
            free = old + dg
            centre = float(np.median(free)) if clamp == "median" else 0.0
            new = np.clip(free, centre - bound, centre + bound)
            self.gammas = new
            spark = self.rows.sparkSession
            kind = self.rows.schema["pid"].dataType.simpleString()
            self.table = spark.createDataFrame(pd.DataFrame({"pid": self.pdf["pid"], "gamma": new}), f"pid {kind}, gamma double")
            return db, float(np.abs(new - old).max(initial=0.0)), int((new != free).sum())
        p, found, fused = self.p, self.found, self.fused
        if not fused:
            found = found.join(self.second_pass(inverse), "pid").checkpoint()

        def scored(t, b):
            return t.scores(inverse) if fused else (b["u"].to_numpy(), np.array([b[f"u_{k}"].sum() for k in range(p)]))

        def share(batches):
            for b in batches:
                yield pd.DataFrame({"d": [scored(M.Tables(b, p), b)[1].tolist()]})

        got = found.mapInPandas(share, "d array<double>").agg(*[F.sum(F.col("d")[k]) for k in range(p)]).head() if p else ()
        db = size * (inverse @ np.array(got, float)) if p else np.zeros(0)

        def moved(batches):
            for b in batches:
                t = M.Tables(b, p)
                yield pd.DataFrame({"pid": b["pid"], "old": b["gamma"], "free": b["gamma"].to_numpy() + size * t.ig * scored(t, b)[0] - (t.j + means) @ db})

        kind = self.rows.schema["pid"].dataType.simpleString()
        free = found.mapInPandas(moved, f"pid {kind}, old double, free double").repartition(self.parts, "pid").checkpoint()
        centre = exact_median(free, "free") if clamp == "median" else 0.0
        new = free.withColumn("gamma", F.least(F.greatest("free", F.lit(centre - bound)), F.lit(centre + bound)))
        move, held = new.agg(F.max(F.abs(F.col("gamma") - F.col("old"))), F.sum((F.col("gamma") != F.col("free")).cast("int"))).head()
        self.table = new.select("pid", "gamma")
        return db, float(move or 0.0), int(held or 0)


def fit_exact(df: DataFrame, success: str, provider: str, trials: str | None = None, features=None, exclude=(), cutoff: int = 0, tol: float = 1e-5, max_iter: int = 100, bound: float = 10.0, clamp: str = "median", stop: str = "beta", damping: bool = False, trace: bool = False, num_partitions: int | None = None, max_local: int = MAX_LOCAL, passes: int | None = None) -> Fit:
    """Fit slopes and one intercept per provider.

    clamp: gammas stay within `bound` of their median, or of 0 ("absolute"). stop: "beta" (largest scaled slope step;
    without covariates the largest gamma step), "relch" or "ratch" (relative change of the penalised likelihood, to
    itself or to its rise since the start), "all" (their maximum) or "or" (their minimum). damping adapts the step size
    to the criterion. Providers without events get finite estimates; collinear covariates raise an error. passes: 1 or 2 over
    the records in an iteration, by default 2 beyond MOST_FUSED covariates. The records stay cached until close().
    """
    if passes not in (None, 1, 2):
        raise ValueError("passes must be 1 or 2")
    if stop not in STOPS:
        raise ValueError(f"stop must be one of {', '.join(STOPS)}")
    if clamp not in ("median", "absolute"):
        raise ValueError("clamp must be 'median' or 'absolute'")
    rows, names = normalise(df, success, provider, trials, features, exclude, cutoff)
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = (rows.repartition(num_partitions) if num_partitions else rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if kept.select("pid").distinct().count() > max_local:
            salted = kept.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            first, kept = kept, salted.repartition(parts, "pid", "_salt").persist(StorageLevel.MEMORY_AND_DISK)
            kept.count()
            first.unpersist()
        fused = passes == 1 or passes is None and len(names) <= MOST_FUSED
        return _newton(kept, names, tol, max_iter, bound, clamp, stop, damping, trace, parts, "_salt" not in kept.columns, fused)
    except BaseException:
        kept.unpersist()
        raise


def _newton(rows, names, tol, max_iter, bound, clamp, stop, damping, trace, parts, local, fused) -> Fit:
    p = len(names)
    got = rows.agg(F.count("*"), F.sum("y"), F.sum("n"), F.count_distinct("pid"), *[F.avg(f"z{k + 1}") for k in range(p)]).head()
    count, y, n, providers, means = got[0], got[1], got[2], got[3], np.array(got[4:], float)
    state, beta = State(rows, p, names, start_value(rows), local, parts, fused), np.zeros(p)
    size, before, crit, change, converged, held, history, done = 1.0, None, float("inf"), float("inf"), False, 0, [], 0
    for k in range(max_iter + 1):
        state.take(beta, means)
        inverse = M.inverse_of(state.schur, names)
        value = state.penalised()
        history.append(value)
        if k and stop != "beta":
            last, first = history[-2], history[0]
            relative = abs((value - last) / value) if value else 0.0
            rise = abs((value - last) / (value - first)) if value != first else 0.0
            crit = {"relch": relative, "ratch": rise, "all": max(change, relative, rise), "or": min(change, relative, rise)}[stop]
        if k and crit <= tol:
            converged = True
            break
        if k == max_iter:
            break
        step, move, held = state.step(inverse, means, size, clamp, bound)
        beta, done = beta + step, k + 1
        change = float(np.abs(step).max()) if p else move
        if stop == "beta":
            crit = change
        if damping and k >= 1 and before is not None:
            if change < 0.9 * before:
                size = min(1.2 * size, 1.0)
            elif change >= 0.99 * before:
                size = max(0.5 * size, 0.01)
        before = change
    spark = rows.sparkSession
    info = spark.createDataFrame(state.pdf).withColumn("pid", F.col("pid").cast(rows.schema["pid"].dataType)) if state.local else state.found
    gamma = info.select("pid", "gamma")
    return Fit(rows, names, dict(zip(names, beta.tolist())), gamma, info, value, -2.0 * state.ll, state.log_w + M.log_det(state.schur), done, crit, converged, count, providers, y / n, means, state.schur, history if trace else history[-1:], held)


def likelihood_at(df: DataFrame, success: str, provider: str, gamma: DataFrame, beta, trials: str | None = None, features=None, exclude=()) -> dict[str, float]:
    """loglik, neg2_loglik, log_det and penalised at given intercepts (pid, gamma) and slopes, without a fit; providers without a gamma are left out."""
    rows, names = normalise(df, success, provider, trials, features, exclude)
    rows, p = rows.join(gamma, "pid").persist(StorageLevel.MEMORY_AND_DISK), len(names)
    try:
        means = np.array(rows.agg(F.count("*"), *[F.avg(f"z{k + 1}") for k in range(p)]).head()[1:], float)
        found = M.moments(rows, F.col("gamma"), np.asarray(beta, float), means, fused=False)

        def share(batches):
            for b in batches:
                t = M.Tables(b, p)
                yield pd.DataFrame({"s": [t.schur().ravel().tolist()], "ll": [b["ll"].sum()], "w": [np.log(np.maximum(t.w0, 1e-12)).sum()]})

        got = found.mapInPandas(share, "s array<double>, ll double, w double").agg(F.sum("ll"), F.sum("w"), *[F.sum(F.col("s")[k]) for k in range(p * p)]).head()
    finally:
        rows.unpersist()
    det = got[1] + M.log_det(np.array(got[2:], float).reshape(p, p))
    return {"loglik": got[0], "neg2_loglik": -2.0 * got[0], "log_det": det, "penalised": got[0] + 0.5 * det}
