"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

The sketch of a group is a table of logarithmic bins with counts (relative error of a quantile: 1 %). Partial
sketches merge by adding counts, so it is one map-side combined aggregation, and a coarser group's sketch is the
sum of its parts' sketches. Fences are read off the sketches and joined back to the rows: a group's quantile EXTREME,
or its quartile plus a width where that is nearer, as where junk is more than the rest beyond EXTREME.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm import words as W

RANGE_BYTES = 1 << 19
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
#: Ratio of neighbouring bin edges: a quantile is off by 1 % at most.
GAMMA = 1.01 / 0.99
#: Metrics with the least width of the fence beyond the quartile.
UPPER = {"symbol_share": 0.05, "dup_share": 0.35, "repeat_share": 0.3, "word_length": 2.0}
LOWER = {"word_length": 1.0}
#: What a fence allows in any case, so that a metric that is zero nearly everywhere does not reject the first trace.
FLOOR = {"symbol_share": 0.01, "dup_share": 0.05, "repeat_share": 0.05, "word_length": 0.0}
#: The share of a group's documents up to the upper fence, and from the lower one, at most.
EXTREME = 0.99
#: A group with fewer documents (that pass the base rules) takes the fences of its language, and that those of all documents.
LEAST_GROUP = 50
FENCE = 3.0


def features(col) -> list[np.ndarray]:
    """FIELDS of each text."""
    B.release()
    buf, offs = W.flat(col)
    out = [np.zeros(len(offs) - 1, np.int64) for _ in FIELDS]
    for lo, hi in W.runs_of_docs(offs, RANGE_BYTES):
        own = offs[lo : hi + 1] - offs[lo]
        n = int(own[-1])
        b = np.concatenate([buf[offs[lo] : offs[hi]], np.zeros(16, np.uint8)])
        starts, ends, woffs = W.spans(b, own, W.NOT_WHITE)
        words = np.diff(woffs)
        of = lambda flags, at=own: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        chars = of(W.NOT_WHITE[b[:n]] & ((b[:n] & 0xC0) != 0x80))
        symbols = of(SYMBOL[b[:n]])
        # lines
        ls, le, loffs = W.spans(b, own, NOT_NEWLINE)
        k = np.searchsorted(starts, ls)
        has = (k < len(starts)) & (starts[np.minimum(k, max(0, len(starts) - 1))] < le) if len(starts) else np.zeros(len(ls), bool)
        doc = np.repeat(np.arange(hi - lo), np.diff(loffs))[has]
        h = W.span_hash(b, ls[has], le[has])
        lines = np.bincount(doc, minlength=hi - lo)
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        dups = np.bincount(doc[order][1:][same], minlength=hi - lo)
        # words in 8-word windows that occur twice
        r = W.rolling(W.span_hash(b, starts, ends), 8)
        ok = np.flatnonzero(W.inside(woffs, 8, len(starts)))
        wdoc = np.searchsorted(woffs, ok, "right") - 1
        key = W.mix(r[ok] ^ (wdoc.astype(np.uint64) * W.SEEDS[0]))
        order = np.argsort(key, kind="stable")
        eq = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(ok), bool)
        twice[order[1:][eq]] = True
        twice[order[:-1][eq]] = True
        d = np.zeros(len(starts) + 9, np.int64)
        np.add.at(d, ok[twice], 1)
        np.add.at(d, ok[twice] + 8, -1)
        covered = of(np.cumsum(d)[: len(starts)] > 0, woffs)
        for o, v in zip(out, (words, chars, symbols, dups, covered, lines)):
            o[lo:hi] = v
    return out


NOT_NEWLINE = np.array([b != 0x0A for b in range(256)])


def features_udf():
    @F.arrow_udf("struct<" + ",".join(f"{f}:long" for f in FIELDS) + ">")
    def measured(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in features(text)], names=FIELDS)

    return measured


def metrics() -> dict:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketch(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, bin, n) of the documents that pass the base rules: bin k holds values in (GAMMA**(k-1), GAMMA**k], the null bin holds zeros."""
    kinds = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("x")) for m, v in metrics().items())))
    rows = df.filter(~failed()).select(*groups, kinds.alias("m")).select(*groups, "m.metric", F.when(F.col("m.x") > 0, F.ceil(F.round(F.ln("m.x") / math.log(GAMMA), 6))).cast("int").alias("bin"))
    return rows.groupBy(*groups, "metric", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "metric", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, size, q1, q3, low, high): low and high are the outer edges of the bins of 1 - EXTREME and EXTREME, so a value there is not beyond; a window holds the bins of one sketch, at most a few thousand."""
    by = Window.partitionBy(*groups, "metric")
    upto = by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA))
    edge = lambda k: F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") + k))
    r = sketches.select("*", F.sum("n").over(by).alias("size"), F.sum("n").over(upto).alias("upto"), value.alias("value"), edge(-1.00001).alias("lower"), edge(0.00001).alias("upper"))
    q = lambda p, v="value": F.min(F.when(F.col("upto") >= F.ceil(F.col("size") * p), F.col(v)))
    return r.groupBy(*groups, "metric").agg(F.max("size").alias("size"), q(0.25).alias("q1"), q(0.75).alias("q3"), q(round(1 - EXTREME, 6), "lower").alias("low"), q(EXTREME, "upper").alias("high"))


def fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, size, <metric>_max, <metric>_min): the quantiles of EXTREME, or the quartiles plus or minus FENCE times their distance where nearer."""
    q = quartiles(sketches, groups)
    width = lambda least: F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(least))
    pick = lambda m, e: F.max(F.when(F.col("metric") == m, e))
    high = [pick(m, F.greatest(F.least("high", F.col("q3") + width(w)), F.lit(FLOOR[m]))).alias(f"{m}_max") for m, w in UPPER.items()]
    low = [pick(m, F.greatest("low", F.col("q1") - width(w))).alias(f"{m}_min") for m, w in LOWER.items()]
    return q.groupBy(*groups).agg(F.max("size").alias("size"), *high, *low)


def quality_rules(df: DataFrame, groups: tuple[str, str] = ("lang", "source"), text: str = "text") -> DataFrame:
    """df without its text, with FIELDS, base_failed, the fences that held (fence_size, fence_*_max, fence_*_min) and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. A document that passes is
    kept unless a metric lies beyond its group's fences: the quantile EXTREME of the documents that pass, or the
    quartile plus the larger of FENCE times their distance and a constant (UPPER, LOWER) if that is nearer, but not
    below FLOOR. Of fewer than LEAST_GROUP such documents, the fences are those of the language, or of all. Null and empty texts have no words and fail. A null
    language or source is a group of its own. Repeated rows count each time. An empty df gives an empty result;
    columns of df named like a result column are replaced.
    """
    B.small_batches(df.sparkSession)
    outer, inner = groups
    names = ["size", *(f"{m}_max" for m in UPPER), *(f"{m}_min" for m in LOWER)]
    made = [*FIELDS, "base_failed", "kept", *(f"fence_{n}" for n in names)]
    f = features_udf()(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rest = [F.col(f"`{c}`") for c in df.columns if c != text and c not in made]
    base = B.written(df.select(*rest, f.alias("_f")).select(*rest, "_f.*"), "features")
    by_group = B.written(sketch(base, [outer, inner]), "sketch")
    by_outer = merge(by_group, [outer])
    whole = fences(merge(by_outer, []), [])
    outer_f, group_f = fences(by_outer, [outer]), fences(by_group, [outer, inner])
    mark = lambda d, p, keys: d.select(*(F.col(k).alias(f"_{p}_{k}") for k in keys), *(F.col(n).alias(f"_{p}_{n}") for n in names))
    g, o, w = mark(group_f, "g", groups), mark(outer_f, "o", [outer]), mark(whole, "w", [])
    # the thresholds of a group are settled among sketches, before the join to the rows
    t = g.join(o, F.col(f"_g_{outer}").eqNullSafe(F.col(f"_o_{outer}")), "left").join(F.broadcast(w))
    big = lambda p: F.col(f"_{p}_size") >= LEAST_GROUP
    held = [F.when(big("g"), F.col(f"_g_{n}")).when(big("o"), F.col(f"_o_{n}")).otherwise(F.col(f"_w_{n}")).alias(f"_t_{n}") for n in names]
    t = t.select(F.col(f"_g_{outer}").alias("_k1"), F.col(f"_g_{inner}").alias("_k2"), *held)
    t = B.written(t, "fences")  # a table of known size: broadcast if small, else Spark can split the rows of a large group
    x = base.join(t, F.col(f"`{outer}`").eqNullSafe(F.col("_k1")) & F.col(f"`{inner}`").eqNullSafe(F.col("_k2")), "left").drop("_k1", "_k2")
    beyond = F.lit(False)
    for m, v in metrics().items():
        if m in UPPER:
            beyond |= v > F.col(f"_t_{m}_max")
        if m in LOWER:
            beyond |= v < F.col(f"_t_{m}_min")
    x = x.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))
    return x.withColumnsRenamed({f"_t_{n}": f"fence_{n}" for n in names})
