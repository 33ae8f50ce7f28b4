"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted over all documents.

Spark counts the windows by two 64-bit hashes over two independent hashes of their words. A window can only repeat if
the smallest of its inner gram hashes is chosen at two places, so the few chosen grams are counted first, and windows
whose gram stands alone are not sent. Windows that repeat merge into maximal removal intervals. Texts move once, into
blocks.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from providerfx.llm import blocks as B
from providerfx.llm import words as W

RANGE_BYTES = 1 << 19
#: Rows of hashes in an Arrow batch on their way to Spark.
SEND_ROWS = 1 << 16
GRAMS, WINDOWS = "part int, gram long, n long", "part int, a long, b long, n long"


class Windows:
    """The windows of one block: per byte range, the words and hashes; over the block, the distinct hashes."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.gram = window, (window + 1) // 2
        self.table = B.from_ipc(table["blob"].to_pylist())
        self.buf, self.offs = W.flat(self.table["text"])

    def parts(self):
        """For each range: its documents, word offsets, two hashes of each word (the second made on call) and the valid window starts as flags."""
        for lo, hi in W.runs_of_docs(self.offs, RANGE_BYTES):
            own = self.offs[lo : hi + 1] - self.offs[lo]
            b = np.concatenate([self.buf[self.offs[lo] : self.offs[hi]], np.zeros(16, np.uint8)])
            starts, ends, woffs = W.spans(b, own, W.NOT_WHITE)
            valid = W.inside(woffs, self.window, len(starts))
            yield lo, hi, woffs, W.span_hash(b, starts, ends), lambda b=b, s=starts, e=ends: W.span_hash(b, s, e, 1), valid

    def minimal(self, h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest gram of each window, and the chosen grams."""
        gram = W.rolling(h, self.gram)
        low, chosen = W.minimizers(gram, self.window - self.gram + 1, valid)
        return low, gram[chosen]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return B.sorted_unique(np.concatenate([np.zeros(0, np.uint64), *(self.minimal(h, valid)[1] for *_, h, _, valid in self.parts())]))

    def pairs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of the windows whose gram is among these, and how often the block has each."""
        got, seen = [np.zeros((2, 0), np.uint64)], B.sieve(grams)
        for *_, h, second, valid in self.parts():
            at = np.flatnonzero(valid)
            at = at[B.sifted(self.minimal(h, valid)[0][at], grams, seen)] if len(at) else at
            if len(at):
                got.append(np.stack([W.rolling(h, self.window, 0)[at], W.rolling(second(), self.window, 1)[at]]))
        return B.pairs_unique(*np.concatenate(got, axis=1))

    def gone(self, a: np.ndarray, b: np.ndarray):
        """For each range: its documents, word offsets, and which words the windows with one of these pairs of a hash and half of the other cover."""
        seen = B.sieve(a)
        for lo, hi, woffs, h, second, valid in self.parts():
            d, total = np.zeros(len(h) + self.window + 1, np.int64), len(h)
            at = np.flatnonzero(valid) if len(a) else np.zeros(0, np.int64)
            if len(at):
                first = W.rolling(h, self.window, 0)[at]
                some = B.sifted(first, a, seen)
                if len(some):
                    at = at[some][B.sifted_pairs(first[some], W.rolling(second(), self.window, 1)[at[some]] >> np.uint64(32), a, b, seen)]
                    np.add.at(d, at, 1)
                    np.add.at(d, at + self.window, -1)
            yield lo, hi, woffs, np.cumsum(d)[:total] > 0


def unsigned(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of hashes, in the order of the first, then the second."""
    cols = [x.view(np.uint32 if x.dtype == np.int32 else np.uint64).astype(np.uint64) for x in (table[c].to_numpy() for c in names)]
    order = np.lexsort(cols[::-1])
    return [c[order] for c in cols]


def dedup_substrings(df: DataFrame, window: int = 35, text: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """df with n_words, n_removed and the words kept: each word is removed that a window covers whose words also start elsewhere.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one document; "elsewhere" is any other place, in
    the same document too, and windows are judged on the input. The text of a document that loses words becomes
    its kept words, joined by one space; other texts, and nulls, stay as they are. With digest, kept_sha256 (of the
    kept words joined by one space) takes the place of the text. Repeated rows are documents of their own, so they
    lose their long passages. Columns named like a result column are replaced; an empty df gives an empty result.
    """
    n = B.parts_of(df, text)
    rest = [c for c in df.columns if c not in (text, "n_words", "n_removed", *(["kept_sha256"] if digest else []))]
    named = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(f"`{text}`").alias("text"))
    key = [f"c{rest.index(id_col)}"] if id_col in rest else []
    blocks = B.to_blocks(B.dealt(named, n, *key, "text"), n)
    kept_name = "kept_sha256" if digest else "text"
    types = [df.schema[c].dataType for c in rest]
    schema = T.StructType([*(T.StructField(f"c{i}", t) for i, t in enumerate(types)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def rows_of(part: int, names: list[str], *cols: np.ndarray) -> pa.Table:
        whole = pa.table({"part": pa.array(np.full(len(cols[0]), part, np.int32)), **{c: pa.array(x.astype(np.uint64).view(np.int64)) for c, x in zip(names, cols)}})
        return pa.Table.from_batches(whole.to_batches(max_chunksize=SEND_ROWS), whole.schema)

    def grams_of(key, table):
        return rows_of(key[0].as_py(), ["gram", "n"], *Windows(table, window).grams())

    def windows_of(key, table, grams):
        got = Windows(table, window).pairs(*unsigned(grams, "gram")) if table.num_rows and grams.num_rows else [np.zeros(0, np.uint64)] * 3
        return rows_of(key[0].as_py(), ["a", "b", "n"], *got)

    def remove(key, table, pairs):
        w = Windows(table, window)
        texts, n_words, n_removed, kept = w.table["text"], [], [], []
        for lo, hi, woffs, gone in w.gone(*unsigned(pairs, "a", "b")):
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[woffs])
            n_words.append(np.diff(woffs))
            n_removed.append(lost)
            for i, t in enumerate(texts[lo:hi].to_pylist()):
                if lost[i]:
                    t = b" ".join(compress(t.encode().split(), (~gone[woffs[i] : woffs[i + 1]]).tolist())).decode()
                elif digest:
                    t = b" ".join((t or "").encode().split()).decode()
                kept.append(hashlib.sha256(t.encode()).hexdigest() if digest else t)
        made = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (n_words, n_removed)]
        out = w.table.drop_columns(["text"])
        for name, col in zip(("n_words", "n_removed", "kept"), (*made, pa.array(kept, pa.string()))):
            out = out.append_column(name, col)
        return out

    grams = B.repeated(blocks.groupBy("part").applyInArrow(grams_of, GRAMS), "gram")
    windows = B.repeated(blocks.groupBy("part").cogroup(grams.groupBy("part")).applyInArrow(windows_of, WINDOWS), "a", "b")
    windows = windows.select("part", "a", F.shiftright("b", 32).cast("int").alias("b"))  # 96 of the 128 bits go back to the blocks
    out = blocks.groupBy("part").cogroup(windows.groupBy("part")).applyInArrow(remove, schema)
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(rest)]
    return out.select(*cols, "n_words", "n_removed", F.col("kept").alias(kept_name))
