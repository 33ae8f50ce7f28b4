"""SQL for the estimators: Newton iterations unrolled into CTEs, by centred sums (another route than the engine's moments)."""

from __future__ import annotations


def dot(p: int, a: str, b: str) -> str:
    return " + ".join(f"{a}{k} * {b}{k}" for k in range(1, p + 1)) or "0"


def inverse(p: int) -> str:
    if p == 0:
        return ""
    if p == 1:
        return ", 1 / s11 AS i11, ln(s11) AS logdet"
    d = "(s11 * s22 - s12 * s12)"
    return f", s22 / {d} AS i11, -s12 / {d} AS i12, s11 / {d} AS i22, ln({d}) AS logdet"


def pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(1, p + 1) for b in range(a, p + 1)]


def form(p: int, x: str) -> str:
    return " + ".join(f"{1 if a == b else 2} * i{a}{b} * {x}{a} * {x}{b}" for a, b in pairs(p)) or "0"


def cell(a: int, b: int) -> str:
    return f"i{min(a, b)}{max(a, b)}"


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


def state(p: int, g: str, b: str, k: str) -> list[str]:
    """r: rows with prob and weight; a: ig and J; c: centred; s: Schur and its inverse by block; u: adjusted residuals."""
    zs = range(1, p + 1)
    eta = "gamma" + "".join(f" + b{i} * z{i}" for i in zs)
    return [
        cte(f"r{k}", f"SELECT *, n * prob * (1 - prob) AS w FROM (SELECT rec.*, gamma, {eta} AS eta, 1 / (1 + exp(-({eta}))) AS prob FROM rec JOIN {g} USING (pid) JOIN {b} USING (block))"),
        cte(f"a{k}", "SELECT pid, 1 / sum(w) AS ig, ln(sum(w)) AS logw" + "".join(f", sum(w * z{i}) / sum(w) AS j{i}" for i in zs) + f" FROM r{k} GROUP BY pid"),
        cte(f"c{k}", "SELECT *" + "".join(f", z{i} - j{i} AS x{i}" for i in zs) + f" FROM r{k} JOIN a{k} USING (pid)"),
        cte(f"s{k}", f"SELECT *{inverse(p)} FROM (SELECT block" + "".join(f", sum(w * x{a} * x{b}) AS s{a}{b}" for a, b in pairs(p)) + f" FROM c{k} GROUP BY block)"),
        cte(f"u{k}", f"SELECT *, w * (ig + {form(p, 'x')}) AS h, (y - n * prob) + w * (ig + {form(p, 'x')}) * (0.5 - prob) AS u FROM c{k} JOIN s{k} USING (block)"),
    ]


def fit(records: str, p: int, steps: int = 9, refit: int = 0) -> str:
    """CTEs rec, g (pid, gamma), b (block, b1..), and of the last state r, a, c, s, u; blocks are fitted on their own."""
    zs = range(1, p + 1)
    out = [cte("rec", records), cte("start", "SELECT ln(sum(y) / (sum(n) - sum(y))) AS g FROM rec"), cte("g0", "SELECT DISTINCT pid, g AS gamma FROM rec, start"), cte("b0", "SELECT DISTINCT block" + "".join(f", 0.0::DOUBLE AS b{i}" for i in zs) + " FROM rec")]
    for k in range(steps):
        out += state(p, f"g{k}", f"b{k}", str(k))
        move = ", ".join([f"{' + '.join(f'any_value({cell(i, m)}) * sum(x{m} * u)' for m in zs)} AS d{i}" for i in zs])
        out.append(cte(f"d{k}", f"SELECT block{', ' + move if p else ''} FROM u{k} GROUP BY block"))
        out.append(cte(f"b{k + 1}", "SELECT block" + "".join(f", b{i} + d{i} AS b{i}" for i in zs) + f" FROM b{k} JOIN d{k} USING (block)"))
        out.append(cte(f"g{k + 1}", f"SELECT pid, any_value(gamma) + any_value(ig) * sum(u)" + "".join(f" - any_value(j{i}) * any_value(d{i})" for i in zs) + f" AS gamma FROM u{k} JOIN d{k} USING (block) GROUP BY pid"))
    out += state(p, f"g{steps}", f"b{steps}", "")
    out += [f"g AS (SELECT * FROM g{steps})", f"b AS (SELECT * FROM b{steps})"]
    return "WITH " + ",\n".join(out)


def one_shot(records: str, p: int, steps: int = 9, refits: int = 12) -> str:
    """fit() of each block, then CTEs beta (b1, b2) and gamma (pid, gamma) of the combination; p is 2."""
    out = [fit(records, p, steps)]
    out.append(cte("sums", "SELECT sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22, sum(s11 * b1 + s12 * b2) AS t1, sum(s12 * b1 + s22 * b2) AS t2 FROM s JOIN b USING (block)"))
    out.append(cte("beta", "SELECT (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM sums"))
    out.append(cte("bb", "SELECT DISTINCT block, b1, b2 FROM rec, beta"))
    out.append(cte("q0", "SELECT * FROM g0"))
    for k in range(refits):
        out += state(p, f"q{k}", "bb", f"q{k}")
        out.append(cte(f"q{k + 1}", f"SELECT pid, any_value(gamma) + any_value(ig) * sum(u) AS gamma FROM uq{k} GROUP BY pid"))
    out.append(f"gamma AS (SELECT * FROM q{refits})")
    return ",\n".join(out)
