"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours and pairs with one word between, hashed. Training
takes at most `max_labels` labels, those of the smallest hashes of their ids, in one task of bounded
size; per-coordinate rates and L1 leave a sparse weight vector of at most 2**BITS entries, broadcast for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm import words as W

BITS = 20
RANGE_BYTES = 1 << 20
#: Most labelled rows that training reads.
MAX_LABELS = 10_000
KINDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all texts; a feature repeats as often as its words do."""
    low = np.concatenate([W.LOWER[buf[: offs[-1]]], np.zeros(16, np.uint8)])
    starts, ends, woffs = W.spans(low, offs, W.ALNUM)
    h = W.span_hash(low, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    docs, feats = [doc], [h]
    for gap, k in zip((1, 2), KINDS):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            feats.append(W.mix(h[:-gap][same] * k + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_lists(col) -> list[bytes]:
    """The distinct features of each text, as little-endian unsigned 32-bit numbers."""
    buf, offs = W.flat(col)
    out = []
    for lo, hi in W.runs_of_docs(offs, RANGE_BYTES):
        own = np.concatenate([buf[offs[lo] : offs[hi]], np.zeros(16, np.uint8)])
        doc, f = features(own, offs[lo : hi + 1] - offs[lo])
        both = np.unique((doc << BITS) | f)
        cut = np.searchsorted(both >> BITS, np.arange(1, hi - lo))
        out += [x.tobytes() for x in np.split((both & ((1 << BITS) - 1)).astype("<u4"), cut)]
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.01, epochs: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over rows of distinct features of value 1."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = bias = 0.0
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            i = rows[k]
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -bz / ((beta + np.sqrt(bn)) / alpha + l2)
            g = 1.0 / (1.0 + np.exp(-np.clip(wi.sum() + bias, -35, 35))) - labels[k]
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-bz / ((beta + np.sqrt(bn)) / alpha + l2))


def train(labelled: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias, from rows (key, text, label 0 or 1).

    Rows whose label is null are left out; without any row all weights are 0. Texts become lists of features where
    they are; the one task that trains gets at most max_labels of these, each of at most 2**BITS features.
    """

    def listed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(feature_lists(b.column("text")), pa.binary())], names=["key", "label", "feats"])

    def fitted(table):
        rows = [np.frombuffer(x.as_buffer(), "<u4") for chunk in table["feats"].chunks for x in chunk]
        w, bias = ftrl(rows, table["label"].to_numpy().astype(float))
        i = np.flatnonzero(w)
        return pa.table({"idx": pa.array([i.astype("<u4").tobytes()], pa.binary()), "val": pa.array([w[i].tobytes()], pa.binary()), "bias": [bias]})

    known = labelled.filter("label is not null").select(F.col("key").cast("string"), F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    some = known.mapInArrow(listed, "key string, label int, feats binary").orderBy(F.xxhash64("key", "feats"), "key", "feats", "label").limit(max_labels)
    got = some.groupBy().applyInArrow(fitted, "idx binary, val binary, bias double").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(got[0]["idx"], "<u4").astype(np.int64), np.frombuffer(got[0]["val"]), got[0]["bias"]


def score_udf(model: tuple[np.ndarray, np.ndarray, float]):
    idx, val, bias = model

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        w = np.zeros(1 << BITS)
        w[idx] = val
        B.release()
        buf, offs = W.flat(text)
        out = np.full(len(offs) - 1, bias)
        for lo, hi in W.runs_of_docs(offs, RANGE_BYTES):
            own = np.concatenate([buf[offs[lo] : offs[hi]], np.zeros(16, np.uint8)])
            doc, f = features(own, offs[lo : hi + 1] - offs[lo])
            some = w[f] != 0
            both = np.unique((doc[some] << BITS) | f[some])
            out[lo:hi] += np.bincount(both >> BITS, weights=w[both & ((1 << BITS) - 1)], minlength=hi - lo)
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return score


def toxicity(df: DataFrame, labels: DataFrame, held_out=None, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_labels: int = MAX_LABELS) -> DataFrame:
    """df with score, 0 to 1: the higher, the likelier `label` is 1; only the text enters it.

    held_out: a condition on the id whose rows never train. Null and empty texts get the bias's score. A label row
    of an unknown id has no effect; an id with several labels trains with each. Training takes at most max_labels
    labels, those of the smallest hashes of their ids. Repeated rows and other columns stay as they are; a column named score is replaced.
    """
    B.small_batches(df.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("label")).filter("label is not null")
    if held_out is not None:
        marks = marks.filter(~held_out(F.col("_id")))
    ids = df.select(F.col(f"`{id_col}`").alias("_id"))
    # labels of unknown ids don't count; at most max_labels are left, so this side is small by construction and texts need no shuffle
    marks = marks.filter("_id is not null").join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "label").limit(max_labels)
    docs = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text}`").alias("text"))
    model = train(docs.join(F.broadcast(marks), F.col("key") == F.col("_id")).select("key", "text", "label"), max_labels)
    return df.withColumn("score", score_udf(model)(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
