"""All queries of the library, and their SQL. Doubles are rounded to six places, with -0 as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from providerfx.functions.columns import LEAST_WEIGHT, sigmoid
from providerfx.operators import moments as M
from providerfx.operators import normalise as N
from providerfx.operators.exact import fit_exact, likelihood_at
from providerfx.operators.hypothesis import test_providers
from providerfx.operators.one_shot import fit_one_shot
from providerfx.operators.ranks import running_offsets
from providerfx.plans import datasets as D
from providerfx.plans import oracle as O
from providerfx.tools import simulate, tools

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TIGHT = {"tol": 1e-11, "max_iter": 60}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def s6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def one(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())).select(*(r6(F.col(k), k) if isinstance(v, float) else F.col(k) for k, v in values.items()))


def at_zero(spark, sf_dir):
    """Records of the line items at beta = 0 and the start value, with prob and w."""
    rows, _ = N.normalise(D.line(spark, sf_dir), "y", "provider")
    g = N.start_value(rows)
    x = rows.withColumn("prob", sigmoid(F.lit(g)))
    return x.withColumn("w", F.greatest(F.col("n") * F.col("prob") * (1 - F.col("prob")), F.lit(LEAST_WEIGHT)))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 50 END, 0.0) AS z1, (l_returnflag = 'R')::DOUBLE AS y, 1.0::DOUBLE AS n, l_suppkey AS pid FROM lineitem")
def normalise_fill(spark, sf_dir):
    t = D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("provider"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 50).alias("quantity"))
    rows, _ = N.normalise(t, "y", "provider", features=["quantity", "l_orderkey", "l_linenumber"])
    return rows.select(F.col("z2").cast("long").alias("l_orderkey"), F.col("z3").cast("int").alias("l_linenumber"), "z1", "y", "n", "pid")


@query(f"WITH rec AS ({D.LABELS}) SELECT pid, count(*) AS n_records FROM rec GROUP BY pid")
def provider_counts(spark, sf_dir):
    return N.provider_counts(N.normalise(D.labels(spark, sf_dir), "y", "provider")[0])


@query(f"WITH rec AS ({D.LINE}) SELECT pid, n_records, (sum(n_records) OVER (ORDER BY pid) - n_records)::BIGINT AS first FROM (SELECT pid, count(*) AS n_records FROM rec GROUP BY pid)")
def provider_offsets(spark, sf_dir):
    rows, _ = N.normalise(D.line(spark, sf_dir), "y", "provider")
    return running_offsets(N.provider_counts(rows), "pid", "n_records")


@query(f"WITH rec AS ({D.LABELS}) SELECT pid, n_records, count(*) AS n_rows FROM (SELECT pid, count(*) OVER (PARTITION BY pid) AS n_records FROM rec) WHERE n_records >= 18 GROUP BY ALL")
def provider_cutoff(spark, sf_dir):
    return N.with_sizes(N.normalise(D.labels(spark, sf_dir), "y", "provider", cutoff=18)[0]).groupBy("pid", "n_records").agg(F.count("*").alias("n_rows"))


@query(f"WITH a AS ({D.LINE}), b AS ({D.ORDERS}) SELECT {s6('(SELECT ln(sum(y) / (sum(n) - sum(y))) FROM a)', 'line')}, {s6('(SELECT ln(sum(y) / (sum(n) - sum(y))) FROM b)', 'orders')}")
def start_value(spark, sf_dir):
    return one(spark, line=N.start_value(N.normalise(D.line(spark, sf_dir), "y", "provider")[0]), orders=N.start_value(N.normalise(D.orders(spark, sf_dir), "y", "provider", "n")[0]))


GREEDY = f"""WITH RECURSIVE rec AS ({D.LABELS}), sizes AS (SELECT pid, count(*) AS n_records, row_number() OVER (ORDER BY count(*) DESC, pid) AS k FROM rec GROUP BY pid),
dealt(k, load, pid, n_records, block) AS (SELECT 0::BIGINT, [0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, 0::BIGINT, 0 UNION ALL
SELECT s.k, [CASE WHEN j = list_position(load, list_min(load)) THEN x + s.n_records ELSE x END FOR x, j IN load], s.pid, s.n_records, list_position(load, list_min(load)) - 1 FROM dealt d JOIN sizes s ON s.k = d.k + 1)
SELECT pid, block, n_records FROM dealt WHERE k > 0"""


@query(GREEDY)
def partition_assignment(spark, sf_dir):
    rows, _ = N.normalise(D.labels(spark, sf_dir), "y", "provider")
    return N.greedy_blocks(rows, 4)[0].join(N.provider_counts(rows), "pid")


ZERO = O.fit(D.LINE, 2, 1)


@query(f"{ZERO} SELECT pid, {s6('ig', 'ig')}, {s6('j1', 'j1')}, {s6('j2', 'j2')} FROM a0")
def info_at_zero(spark, sf_dir):
    w = F.sum("w")
    return at_zero(spark, sf_dir).groupBy("pid").agg(r6(1 / w, "ig"), r6(F.sum(F.col("w") * F.col("z1")) / w, "j1"), r6(F.sum(F.col("w") * F.col("z2")) / w, "j2"))


def tables_at_zero(spark, sf_dir):
    rows, names = N.normalise(D.line(spark, sf_dir), "y", "provider")
    rows = rows.cache()
    means = rows.agg(F.avg("z1"), F.avg("z2")).head()
    pdf = M.moments(rows, F.lit(N.start_value(rows)), [0.0, 0.0], means).toPandas()
    rows.unpersist()
    t = M.Tables(pdf, 2)
    return pdf, t, t.schur(), M.inverse_of(t.schur(), names)


@query(f"{ZERO} SELECT {s6('s11', 's11')}, {s6('s12', 's12')}, {s6('s22', 's22')} FROM (SELECT sum(w * x1 * x1) AS s11, sum(w * x1 * x2) AS s12, sum(w * x2 * x2) AS s22 FROM c0)")
def schur_at_zero(spark, sf_dir):
    s = tables_at_zero(spark, sf_dir)[2]
    return one(spark, s11=float(s[0, 0]), s12=float(s[0, 1]), s22=float(s[1, 1]))


GLOBAL = D.LINE.replace("l_suppkey % 4 AS block", "0 AS block")
GZERO = O.fit(GLOBAL, 2, 1)


@query(f"{GZERO} SELECT pid, {s6('sum(h)', 'leverage')} FROM u0 GROUP BY pid")
def hat_diag_by_provider(spark, sf_dir):
    x = at_zero(spark, sf_dir)
    _, t, s, i = tables_at_zero(spark, sf_dir)
    j = x.groupBy("pid").agg((1 / F.sum("w")).alias("ig"), *((F.sum(F.col("w") * F.col(z)) / F.sum("w")).alias("j" + z) for z in ("z1", "z2")))
    a, b = F.col("z1") - F.col("jz1"), F.col("z2") - F.col("jz2")
    quad = float(i[0, 0]) * a * a + 2 * float(i[0, 1]) * a * b + float(i[1, 1]) * b * b
    return x.join(j, "pid").groupBy("pid").agg(r6(F.sum(F.col("w") * (F.col("ig") + quad)), "leverage"))


@query(f"{GZERO} SELECT pid, {s6('sum(u)', 'score')} FROM u0 GROUP BY pid")
def adjusted_score(spark, sf_dir):
    pdf, t, _, i = tables_at_zero(spark, sf_dir)
    return spark.createDataFrame(list(zip(pdf["pid"].tolist(), t.scores(i)[0].tolist())), "pid long, score double").select("pid", r6(F.col("score"), "score"))


@query(f"{GZERO} SELECT {s6('d1', 'quantity')}, {s6('d2', 'discount')} FROM d0")
def newton_step_1(spark, sf_dir):
    _, t, _, i = tables_at_zero(spark, sf_dir)
    d = i @ t.scores(i)[1]
    return one(spark, quantity=float(d[0]), discount=float(d[1]))


P0 = f"WITH rec AS ({D.LABELS}) SELECT pid, {s6('ln((sum(y) + 0.5) / (sum(n) - sum(y) + 0.5))', 'gamma')} FROM rec GROUP BY pid"


@query(P0)
def closed_form_p0(spark, sf_dir):
    rows, _ = N.normalise(D.labels(spark, sf_dir), "y", "provider", features=[])
    return rows.groupBy("pid").agg(r6(F.ln((F.sum("y") + 0.5) / (F.sum("n") - F.sum("y") + 0.5)), "gamma"))


def gammas(fit):
    fit.close()  # neither the gammas nor the slopes need the records
    return fit.gamma.select("pid", r6(F.col("gamma"), "gamma"))


def betas(fit):
    fit.close()
    return fit.beta_table().select("feature", r6(F.col("beta"), "beta"))


@query(P0)
def fit_exact_p0(spark, sf_dir):
    return gammas(fit_exact(D.labels(spark, sf_dir), "y", "provider", features=[], **TIGHT))


FIT = O.fit(GLOBAL, 2)
GAMMA, BETA = f"{FIT} SELECT pid, {s6('gamma', 'gamma')} FROM g", f"{FIT} SELECT unnest(['quantity', 'discount']) AS feature, round(unnest([b1, b2]), 6) + 0.0 AS beta FROM b"


def line_fit(spark, sf_dir, **options):
    return fit_exact(D.line(spark, sf_dir), "y", "provider", **(TIGHT | options))


@query(GAMMA)
def fit_exact_gamma(spark, sf_dir):
    return gammas(line_fit(spark, sf_dir))


@query(BETA)
def fit_exact_beta(spark, sf_dir):
    return betas(line_fit(spark, sf_dir))


@query(GAMMA)
def fit_exact_distributed_state(spark, sf_dir):
    """The path beyond MAX_LOCAL providers: no state on the driver."""
    from providerfx.sources.io import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return gammas(line_fit(spark, sf_dir, max_local=0, tol=1e-9))


@query(f"{O.fit(D.ORDERS, 1, 12)} SELECT pid, {s6('gamma', 'gamma')}, {s6('b1', 'beta')} FROM g, b")
def fit_exact_binomial(spark, sf_dir):
    f = fit_exact(D.orders(spark, sf_dir), "y", "provider", "n", clamp="absolute", **TIGHT)
    return f.gamma.select("pid", r6(F.col("gamma"), "gamma"), r6(F.lit(f.beta["price"]), "beta"))


@query(f"{O.fit(D.LABELS, 1, 25)}, totals AS (SELECT pid, sum(y)::BIGINT AS events FROM rec GROUP BY pid) SELECT pid, events, {s6('gamma', 'gamma')}, {s6('b1', 'beta')} FROM g JOIN totals USING (pid), b")
def fit_exact_rare(spark, sf_dir):
    f = fit_exact(D.labels(spark, sf_dir), "y", "provider", **TIGHT)
    return f.info.select("pid", F.col("y").cast("long").alias("events"), r6(F.col("gamma"), "gamma"), r6(F.lit(f.beta["length"]), "beta"))


@query(f"{O.fit(D.EVENTS, 1, 12)} SELECT pid, {s6('gamma', 'gamma')}, {s6('b1', 'beta')} FROM g, b")
def fit_exact_events(spark, sf_dir):
    f = fit_exact(D.events(spark, sf_dir), "y", "provider", **TIGHT)
    return f.gamma.select("pid", r6(F.col("gamma"), "gamma"), r6(F.lit(f.beta["value"]), "beta"))


@query(BETA)
def fit_damped(spark, sf_dir):
    return betas(line_fit(spark, sf_dir, damping=True, clamp="absolute"))


@query(f"{FIT} SELECT unnest(['beta', 'relch', 'ratch', 'all', 'or']) AS stop, {s6('b1', 'quantity')}, {s6('b2', 'discount')} FROM b")
def fit_stop_rules(spark, sf_dir):
    rows = []
    for rule in ("beta", "relch", "ratch", "all", "or"):
        f = line_fit(spark, sf_dir, stop=rule, tol=1e-10)
        rows.append((rule, *f.slopes.tolist()))
        f.close()
    return spark.createDataFrame(rows, "stop string, quantity double, discount double").select("stop", r6(F.col("quantity"), "quantity"), r6(F.col("discount"), "discount"))


SOFT = "greatest(eta, 0) + ln(1 + exp(-abs(eta)))"


def ll(k="") -> str:
    return f"(SELECT sum(eta * y - n * ({SOFT})) FROM r{k})"


def det(k="") -> str:
    return f"((SELECT sum(logw) FROM a{k}) + (SELECT logdet FROM s{k}))"


LL, DET = ll(), det()
STEPS = 5
TRACE = O.fit(GLOBAL, 2, STEPS) + ", trace AS (" + " UNION ALL ".join(f"SELECT {k} AS iter, {ll(i)} + 0.5 * {det(i)} AS value FROM (SELECT 1)" for k, i in enumerate([*map(str, range(STEPS)), ""])) + ")"


@query(f"{TRACE} SELECT iter, {s6('value', 'loglik')} FROM trace")
def fit_trace(spark, sf_dir):
    """The penalised likelihood at the start and after each of STEPS iterations."""
    f = line_fit(spark, sf_dir, trace=True, tol=0.0, max_iter=STEPS)
    return f.history_table().select("iter", r6(F.col("loglik"), "loglik"))


MOVES = ", moves AS (" + " UNION ALL ".join(f"SELECT {k + 1} AS iter, greatest(abs(d1), abs(d2)) AS step FROM d{k}" for k in range(STEPS)) + ")"
RULES = f"""{TRACE}{MOVES}, crit AS (SELECT t.iter AS iter, step, abs((t.value - p.value) / t.value) AS relch, abs((t.value - p.value) / (t.value - f.value)) AS ratch
FROM trace t JOIN trace p ON p.iter = t.iter - 1 JOIN moves ON moves.iter = t.iter, (SELECT value FROM trace WHERE iter = 0) f)
SELECT stop, min(iter)::BIGINT AS iterations FROM (SELECT iter, unnest(['beta', 'relch', 'ratch', 'all', 'or']) AS stop, unnest([step, relch, ratch, greatest(step, relch, ratch), least(step, relch, ratch)]) AS x FROM crit) WHERE x <= 1e-5 GROUP BY stop"""


@query(RULES)
def fit_iterations(spark, sf_dir):
    """Iterations until each stop rule holds."""
    rows = []
    for rule in ("beta", "relch", "ratch", "all", "or"):
        f = line_fit(spark, sf_dir, stop=rule, tol=1e-5)
        rows.append((rule, f.iterations))
        f.close()
    return spark.createDataFrame(rows, "stop string, iterations long")


AT = ", ".join(["b0 AS MATERIALIZED (SELECT 0 AS block, 0.1::DOUBLE AS b1, -0.2::DOUBLE AS b2)", "rec AS MATERIALIZED (" + GLOBAL + ")", "g0 AS MATERIALIZED (SELECT pid, -0.5 - 0.01 * (pid % 7) AS gamma FROM rec GROUP BY pid)", *O.state(2, "g0", "b0", "")])


@query(f"WITH {AT} SELECT {s6(LL, 'loglik')}, {s6(f'-2 * {LL}', 'neg2_loglik')}, {s6(DET, 'log_det')}, {s6(f'{LL} + 0.5 * {DET}', 'penalised')}")
def likelihood_at_given(spark, sf_dir):
    df = D.line(spark, sf_dir)
    gamma = df.select(F.col("provider").alias("pid")).distinct().withColumn("gamma", -0.5 - 0.01 * (F.col("pid") % 7))
    return one(spark, **likelihood_at(df, "y", "provider", gamma, [0.1, -0.2]))


@query(f"{FIT} SELECT {s6(LL, 'loglik')}, {s6(f'-2 * {LL}', 'neg2_loglik')}, {s6(DET, 'logdet_info')}, {s6(f'{LL} + 0.5 * {DET}', 'loglik_penalised')}")
def likelihoods(spark, sf_dir):
    f = line_fit(spark, sf_dir)
    return one(spark, loglik=-0.5 * f.neg2_loglik, neg2_loglik=f.neg2_loglik, logdet_info=f.log_det, loglik_penalised=f.loglik)


QUANTILES = ", ".join(s6(f"quantile_cont(gamma, {q})", n) for q, n in ((0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (1, "q100")))


@query(f"{FIT} SELECT {QUANTILES}, {s6('median(gamma)', 'median')}, count(*) AS n_providers, (SELECT count(*) FROM rec) AS n_records, (SELECT round(avg(y), 4) FROM rec) AS event_rate, (SELECT count(*) FROM (SELECT pid FROM rec GROUP BY pid HAVING sum(y) = 0)) AS no_events FROM g")
def gamma_summary(spark, sf_dir):
    f = line_fit(spark, sf_dir)
    q = F.percentile("gamma", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("q0", "q25", "q50", "q75", "q100")
    s = f.info.agg(q.alias("q"), r6(F.median("gamma"), "median"), F.count("*").alias("n_providers"), F.sum("n_records").cast("long").alias("n_records"), F.round(F.sum("y") / F.sum("n"), 4).alias("event_rate"), F.sum((F.col("y") == 0).cast("long")).alias("no_events"))
    return s.select(*(r6(F.col("q")[k], n) for k, n in enumerate(names)), "median", "n_providers", "n_records", "event_rate", "no_events")


@query(f"{FIT} (SELECT 'lowest' AS side, pid, {s6('gamma', 'gamma')} FROM g ORDER BY g.gamma, pid LIMIT 5) UNION ALL (SELECT 'highest', pid, {s6('gamma', 'gamma')} FROM g ORDER BY g.gamma DESC, pid LIMIT 5)")
def gamma_extremes(spark, sf_dir):
    g = line_fit(spark, sf_dir).gamma
    side = lambda name, order: g.orderBy(order, "pid").limit(5).select(F.lit(name).alias("side"), "pid", r6(F.col("gamma"), "gamma"))
    return side("lowest", F.asc("gamma")).union(side("highest", F.desc("gamma")))


def tested(fit, **options):
    return test_providers(fit, **options).select("pid", r6(F.col("gamma_est"), "gamma_est"), r6(F.col("stat"), "stat"), r6(F.col("p"), "p"), "flag", "verdict")


def two_sided(z: str) -> str:
    """p of |z| by the series of positive terms of the error function; 0 to six places beyond 8."""
    terms = f"[exp(-({z}) * ({z}) / 2 + 2 * k * ln(2) + (2 * k + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2)) + lgamma(k + 1) - lgamma(2 * k + 2)) FOR k IN range(0, 150)]"
    return f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum({terms}) END"


def flagged(stat: str, sign: str, limit: str, source: str) -> str:
    flag = f"CASE WHEN {limit} THEN CASE WHEN {sign} > 0 THEN 1 ELSE -1 END ELSE 0 END"
    words = "CASE flag WHEN 1 THEN 'above the null value' WHEN -1 THEN 'below the null value' ELSE 'no clear difference' END"
    p = two_sided("stat") if limit == Z else f"CASE WHEN stat <= 0 THEN 1.0 ELSE {two_sided('sqrt(greatest(stat, 0))')} END"
    return f" SELECT pid, {s6('gamma', 'gamma_est')}, {s6('stat', 'stat')}, {s6(p, 'p')}, flag, {words} AS verdict FROM (SELECT *, {flag} AS flag FROM (SELECT *, {stat} AS stat FROM {source}))"


Z = "abs(stat) > 1.959963984540054"
LRT = "stat > 3.841458820694124"
MEDIAN = ", med AS MATERIALIZED (SELECT median(gamma) AS g0 FROM g)"
PER = ", per AS MATERIALIZED (SELECT pid, any_value(gamma) AS gamma, any_value(g0) AS g0, sum(y - n * p0) AS res, sum(n * p0 * (1 - p0)) AS w0, sum(w) AS w, sum((e0 - eta) * y - n * (greatest(e0, 0) + ln(1 + exp(-abs(e0))) - (greatest(eta, 0) + ln(1 + exp(-abs(eta)))))) AS drop_, {sums} FROM (SELECT *, 1 / (1 + exp(-e0)) AS p0 FROM (SELECT r.*, g0, eta - gamma + g0 AS e0 FROM r, med)) GROUP BY pid)"
SUMS = ", ".join(f"sum({w} * {e}) AS {n}_{w[-1] if w == 'w' else 'o'}" for w in ("w", "n * p0 * (1 - p0)") for n, e in (("a", "z1"), ("b", "z2"), ("aa", "z1 * z1"), ("ab", "z1 * z2"), ("bb", "z2 * z2")))
TEST = FIT + MEDIAN + PER.format(sums=SUMS)


@query(f"{FIT}{MEDIAN}" + flagged("(gamma - g0) / sqrt(ig + i11 * j1 * j1 + 2 * i12 * j1 * j2 + i22 * j2 * j2)", "stat", Z, "(SELECT * FROM g JOIN a USING (pid), s, med)"))
def wald_all(spark, sf_dir):
    return tested(line_fit(spark, sf_dir), method="wald")


@query(TEST + flagged("res / sqrt(w0)", "stat", Z, "per"))
def score_all(spark, sf_dir):
    return tested(line_fit(spark, sf_dir), method="score")


@query(TEST + flagged("-2 * drop_", "gamma - g0", LRT, "per"))
def lrt_all(spark, sf_dir):
    return tested(line_fit(spark, sf_dir), method="lrt")


SWAP = "(SELECT per.*, " + ", ".join(f"s{k} - ({x}_w - {y}_w * {z}_w / w) + ({x}_o - {y}_o * {z}_o / w0) AS t{k}" for k, x, y, z in (("11", "aa", "a", "a"), ("12", "ab", "a", "b"), ("22", "bb", "b", "b"))) + ", logdet FROM per, s)"


@query(TEST + flagged("-2 * (drop_ + 0.5 * (ln(w0) - ln(w) + ln(t11 * t22 - t12 * t12) - logdet))", "gamma - g0", LRT, SWAP))
def lrt_firth_all(spark, sf_dir):
    return tested(line_fit(spark, sf_dir), method="lrt", firth=True)


def line_blocks(spark, sf_dir):
    return fit_one_shot(D.line(spark, sf_dir).withColumn("block", F.pmod("provider", F.lit(4))), "y", "provider", block="block", tol=1e-11)


SHOT = O.one_shot(D.LINE, 2)


@query(f"{SHOT} SELECT unnest(['quantity', 'discount']) AS feature, round(unnest([b1, b2]), 6) + 0.0 AS beta FROM beta")
def one_shot_beta(spark, sf_dir):
    f = line_blocks(spark, sf_dir)
    return spark.createDataFrame(list(f.beta.items()), "feature string, beta double").select("feature", r6(F.col("beta"), "beta"))


@query(f"{SHOT} SELECT pid, {s6('gamma', 'gamma')} FROM gamma")
def one_shot_gamma(spark, sf_dir):
    return line_blocks(spark, sf_dir).gamma.select("pid", r6(F.col("gamma"), "gamma"))


@query()
def simulate_summary(spark, sf_dir):
    data, truth = simulate.simulate_providers(spark)
    return data.groupBy("id").agg(F.count("*").alias("n_records"), F.sum("y").alias("events")).join(truth.withColumnRenamed("gamma", "true_gamma"), "id")


MAPPING = f"""WITH rec AS (SELECT l_suppkey AS provider, (l_returnflag = 'R')::INTEGER AS y, l_quantity / 50 AS quantity, l_discount * 10 AS discount FROM lineitem),
s AS (SELECT count(*) AS n, count(DISTINCT y) = 2 AND bool_and(y IN (0, 1)) AND count(y) = count(*) AS is_binary, count(DISTINCT provider) AS ids FROM rec)
SELECT CASE WHEN is_binary THEN 'y' END AS y, 'quantity,discount' AS z, CASE WHEN ids > 1 AND ids < n / 2 THEN 'provider' END AS id FROM s"""


@query(MAPPING)
def inspect_mapping(spark, sf_dir):
    found = tools.inspect_data(D.line(spark, sf_dir))
    m = found["mapping"]
    return spark.createDataFrame([(m["y_expr"], m["z_expr"], m["id_expr"])], "y string, z string, id string")


@query("SELECT unnest([1, 4])::INTEGER AS partitions, true AS estimates_agree")
def benchmark_partitions(spark, sf_dir):
    found = tools.benchmark_partitions(D.line(spark, sf_dir), "y", "provider", partitions=(1, 4))
    return spark.createDataFrame([(r["partitions"], found["estimates_agree"]) for r in found["runs"]], "partitions int, estimates_agree boolean")
