"""Suffix-array dedup: bytes go that a fixed-length string covers which also starts in a document of a smaller id.

Only strings whose smallest inner gram hash is chosen at two places can repeat, so these grams are counted first. Runs of
strings with a repeated gram become segments, dealt by that gram to shards. Equal segments are one; the distinct ones
are sorted, a bounded number at a time, by an induced suffix array, and its permuted common prefixes tell which strings
are equal across segments. Strings of a gram with many occurrences are dealt by more bytes than the gram's, see hot_keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from providerfx.llm import blocks as B
from providerfx.llm import words as W
from providerfx.llm.suffix_array import permuted_prefixes, suffix_array

RANGE_BYTES = 1 << 18
#: Bytes of distinct segments in one suffix array; segments of one key stay together.
ARRAY_BYTES = 1 << 19
#: Most strings of a segment: longer runs (of one character, say) become several, mostly equal ones.
RUN = 64
#: A gram chosen at more places is dealt by hot_keys.
HOT = 2000
LAST = np.iinfo(np.int64).max
#: Chosen grams are small numbers, being the smallest ones; times an odd number modulo the range of keys they fill it evenly.
ODD = 0x9E3779B97F4B
SPREAD, GATHER, KEYS = np.uint64(ODD), np.uint64(pow(ODD, -1, 1 << B.KEY_BITS)), np.uint64((1 << B.KEY_BITS) - 1)
#: Shards of segments for each block of text.
SHARDS = 4
FOUND = "part int, starts binary, runs binary"


class Segments:
    """One block's texts, the grams that stand for their strings, and the segments of repeated grams."""

    def __init__(self, table: pa.Table, size: int):
        self.size, self.gram = size, 8 * max(1, size // 16)
        self.table = B.from_ipc(table["blob"].to_pylist())
        self.buf, self.offs = W.flat(self.table["text"])
        self.docs = self.table["_id"].combine_chunks().fill_null(LAST).to_numpy()

    def parts(self):
        """For each range: its first byte, the hash of each gram, the smallest of each string, and which strings are whole."""
        for lo, hi in W.runs_of_docs(self.offs, RANGE_BYTES):
            base, end = int(self.offs[lo]), int(self.offs[hi])
            n = end - base
            eight = W.load(self.buf[base : end + 16])
            m = max(0, n - self.gram + 1)
            g = np.zeros(m, np.uint64)
            for k in range(0, self.gram, 8):
                g = (g ^ eight[k : k + m]) * W.SEEDS[0]
                g ^= g >> np.uint64(29)
            yield base, W.mix(g) >> np.uint64(64 - B.KEY_BITS), W.inside(self.offs[lo : hi + 1] - base, self.size, n)

    def minimal(self, g: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return W.minimizers(g, self.size - self.gram + 1, valid)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the chosen grams in order, and how often the block has each."""
        return B.sorted_unique(np.concatenate([np.zeros(0, np.uint64), *(g[self.minimal(g, valid)[1]] for _, g, valid in self.parts())]) * SPREAD & KEYS)

    def hot_keys(self, base: int, at: np.ndarray, g: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Keys of strings by the bytes that all strings share whose gram stands at about the same place.

        Places are classed by how near to either end the gram is: 0, 1, 2-3, 4-7 and so on. A string at the edge of a
        common passage differs from others like it in the bytes on one side; a class knows about half of these.
        """
        last = self.size - self.gram
        place = np.full(len(at), -1)
        for k in range(last, -1, -1):  # the first of equal grams holds
            place[g[at + k] == low] = k
        edges = sorted({0, last + 1, last // 2 + 1, *(x for k in range(last.bit_length()) for x in (1 << k, last + 1 - (1 << k)))})
        k = np.searchsorted(edges, place, "right") - 1
        first, end = np.array(edges[:-1])[k], np.array(edges[1:])[k] - 1
        q = base + at + place
        return W.mix(W.span_hash(self.buf, q - first, q + self.size - end) + k.astype(np.uint64)) >> np.uint64(64 - B.KEY_BITS)

    def segments(self, grams: np.ndarray, hot: np.ndarray) -> None:
        """Sets, from the keys of repeated and of hot grams, for each occurrence of a segment: start, length, document id and group; groups are in order of (key, hashes)."""
        grams, hot = (np.sort(x * GATHER & KEYS) for x in (grams, hot))
        starts, lens, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        seen = B.sieve(grams)
        for base, g, valid in self.parts() if len(grams) else ():
            low = self.minimal(g, valid)[0]
            at = np.flatnonzero(valid)
            at = at[B.sifted(low[at], grams, seen)] if len(at) else at
            if len(at):
                key = low[at] * SPREAD & KEYS
                if len(some := np.flatnonzero(B.member(low[at], hot))):
                    key[some] = self.hot_keys(base, at[some], g, low[at[some]])
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])
                first = np.flatnonzero(new)
                new |= (np.arange(len(at)) - first[np.cumsum(new) - 1]) % RUN == 0
                first = np.flatnonzero(new)
                starts.append(at[first] + base)
                lens.append(np.diff(np.append(first, len(at))) - 1 + self.size)
                keys.append(key[first])
        s, n_bytes, k = np.concatenate(starts), np.concatenate(lens), np.concatenate(keys)
        order, group, new = grouped(self.buf, s, n_bytes, k)
        self.starts, self.lens, self.keys, self.group, self.first = s[order], n_bytes[order], k[order], group, new
        self.doc = self.docs[np.searchsorted(self.offs, self.starts, "right") - 1]


def grouped(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (gram, content hashes), the group of each in that order, and each group's first."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z
    a, b = W.span_hash(buf, starts, starts + lens, 0), W.span_hash(buf, starts, starts + lens, 1)
    order = np.lexsort((b, a, grams))
    a, b, g = a[order], b[order], grams[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (g[1:] != g[:-1])])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def least_per_string(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, grams: np.ndarray, least: np.ndarray, size: int):
    """(segment, offset, strings, smallest document) of runs of strings, for distinct segments sorted by gram.

    Within a gram of one segment, its own smallest document holds for all strings. Other grams' segments are
    sorted together, in arrays of about ARRAY_BYTES.
    """
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    alone = np.diff(np.append(new, len(grams))) == 1
    one = new[alone]
    out = [np.stack([one, np.zeros_like(one), lens[one] - size + 1, least[one]])]
    bounds = np.append(new, len(grams))
    many = np.flatnonzero(~alone)
    i = 0
    while i < len(many):
        j, total, take = i, 0, []
        while j < len(many) and (not take or total < ARRAY_BYTES):
            seg = np.arange(bounds[many[j]], bounds[many[j] + 1])
            take.append(seg)
            total += int(lens[seg].sum())
            j += 1
        i, seg = j, np.concatenate(take)
        n = lens[seg]
        at = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        s = np.full(int((n + 1).sum()), 0xFF, np.uint8)  # no byte of UTF-8
        s[W.gathered(at, n)] = buf[W.gathered(starts[seg], n)]
        order = suffix_array(s)
        owner = np.repeat(np.arange(len(seg)), n + 1)
        whole = np.zeros(len(s), bool)
        whole[W.gathered(at, n - size + 1)] = True
        order = order[whole[order]]
        equal = permuted_prefixes(s, order, size)[order] >= size
        head = np.flatnonzero(~equal)
        small = np.minimum.reduceat(least[seg][owner[order]], head)
        value = np.zeros(len(s), np.int64)
        value[order] = small[np.cumsum(~equal) - 1]
        pos = np.flatnonzero(whole)
        cut = np.flatnonzero(np.concatenate([[True], (owner[pos][1:] != owner[pos][:-1]) | (value[pos][1:] != value[pos][:-1])]))
        p = pos[cut]
        out.append(np.stack([seg[owner[p]], p - at[owner[p]], np.diff(np.append(cut, len(pos))), value[p]]))
    return np.concatenate(out, axis=1)


def dedup_bytes(df: DataFrame, size: int = 50, text: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """df with n_bytes, n_removed, n_spans (maximal removed runs) and the remaining bytes.

    Removed is each byte that a string of `size` bytes covers which also starts in a document with a smaller id;
    strings never cross documents and are judged on the input; `size` is 16 or more. Without digest the remaining bytes are the column
    `kept` (binary: a cut may fall inside a character), else kept_sha256. A null text is an empty one. A null id
    is larger than all ids; rows that share an id, or have none, never remove from each other. Columns named like a
    result column are replaced; an empty df gives an empty result.
    """
    if size < 16:
        raise ValueError("size must be at least 16")
    n = B.parts_of(df, text)
    last = "kept_sha256" if digest else "kept"
    rest = [c for c in df.columns if c not in (text, "n_bytes", "n_removed", "n_spans", last)]
    named = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("text"))
    blocks = B.to_blocks(B.dealt(named, n, "_id", "text"), n)
    types = [df.schema[c].dataType for c in rest]
    schema = T.StructType([*(T.StructField(f"c{i}", t) for i, t in enumerate(types)), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if digest else T.BinaryType())])

    buckets, shards = n, SHARDS * n

    def grams_of(key, table):
        return B.send_keys(key[0].as_py(), *Segments(table, size).grams(), buckets)

    def segments_of(key, table, counted):
        if not table.num_rows or not counted.num_rows:
            return B.info([])
        x = Segments(table, size)
        x.segments(*B.key_answers(x.grams()[0], counted, buckets))
        s, k, keys = x.starts[x.first], x.lens[x.first], x.keys[x.first]
        each, rows = np.append(x.first, len(x.starts)), []
        own, at = B.bucket_bounds(keys, shards)
        for shard, lo, hi in zip(own.tolist(), at.tolist(), at[1:].tolist()):
            raw = binaries(x.buf[W.gathered(s[lo:hi], k[lo:hi])], np.concatenate([[0], np.cumsum(k[lo:hi])]))
            occ = slice(each[lo], each[hi])
            places = [pa.ListArray.from_arrays(pa.array((each[lo : hi + 1] - each[lo]).astype(np.int32)), pa.array(v)) for v in (x.starts[occ], x.doc[occ])]
            rows.append((shard, 0, key[0].as_py(), B.to_ipc(pa.table([pa.array(keys[lo:hi]), raw, *places], names=["gram", "bytes", "starts", "docs"]))))
        return B.info(rows)

    def compared(key, table):
        """Runs of strings that also start in a smaller document, from the segments of one shard."""
        got = [B.from_ipc([blob]) for blob in table["blob"].to_pylist()]
        part = np.repeat(table["key"].to_numpy(), [len(x) for x in got])
        t = pa.concat_tables(got).append_column("part", pa.array(part))
        del got, table
        return pa.Table.from_batches(list(answers(t.combine_chunks(), size)), FOUND_TYPE)

    def remove(key, table, found):
        x = Segments(table, size)
        d = np.zeros(int(x.offs[-1]) + 1, np.int32)
        for starts, runs in zip(found["starts"].to_pylist(), found["runs"].to_pylist()):
            a = np.frombuffer(starts, np.int64)
            np.add.at(d, a, 1)
            np.add.at(d, a + np.frombuffer(runs, np.int64) + size - 1, -1)
        gone = np.cumsum(d[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        full = x.offs[:-1][x.offs[:-1] < x.offs[1:]]
        rise[full] = gone[full]
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[x.offs])
        spans = np.diff(np.concatenate([[0], np.cumsum(rise)])[x.offs])
        kept = []
        for a, z, k in zip(x.offs.tolist(), x.offs[1:].tolist(), lost.tolist()):
            raw = x.buf[a:z][~gone[a:z]].tobytes() if k else x.buf[a:z].tobytes()
            kept.append(hashlib.sha256(raw).hexdigest() if digest else raw)
        out = x.table.drop_columns(["text", "_id"])
        for name, col in zip(("n_bytes", "n_removed", "n_spans", "kept"), (pa.array(np.diff(x.offs)), pa.array(lost), pa.array(spans), pa.array(kept, pa.string() if digest else pa.binary()))):
            out = out.append_column(name, col)
        return out

    hot = HOT
    counted = blocks.groupBy("part").applyInArrow(grams_of, B.INFO).groupBy("part").applyInArrow(lambda table: B.count_keys(table, hot), B.INFO)
    sent = blocks.groupBy("part").cogroup(B.written(counted, "grams").groupBy("part")).applyInArrow(segments_of, B.INFO)
    found = sent.groupBy("part").applyInArrow(compared, FOUND)
    out = blocks.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(last))


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in an array, from their byte offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


FOUND_TYPE = pa.schema([("part", pa.int32()), ("starts", pa.binary()), ("runs", pa.binary())])


def answers(t: pa.Table, size: int):
    """FOUND rows for segments with whole keys: where, in each block, runs of strings start that also start in a smaller document."""
    if not t.num_rows:
        return
    buf, offs = W.flat(t["bytes"])
    lens, keys, part = np.diff(offs), t["gram"].to_numpy(), t["part"].to_numpy()
    lists = t["starts"].combine_chunks()
    start, many, doc = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), t["docs"].combine_chunks().flatten().to_numpy()
    low = np.minimum.reduceat(doc, np.cumsum(many) - many)
    order, group, first = grouped(buf, offs[:-1], lens, keys)
    rep = order[first]
    seg, off, run, small = least_per_string(buf, offs[:-1][rep], lens[rep], keys[rep], np.minimum.reduceat(low[order], first), size)
    by = np.argsort(seg, kind="stable")
    off, run, small = off[by], run[by], small[by]
    edge = np.searchsorted(seg[by], np.arange(len(first) + 1))
    g = np.empty(len(order), np.int64)
    g[order] = group
    g = g.repeat(many)  # of each occurrence
    count = edge[g + 1] - edge[g]
    i, own = W.gathered(edge[g], count), np.repeat(np.arange(len(g)), count)
    use = small[i] < doc[own]
    i, own = i[use], own[use]
    p = part.repeat(many)[own]
    by = np.argsort(p, kind="stable")
    i, own, p = i[by], own[by], p[by]
    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    each = 8 * np.append(cut, len(p))
    yield from pa.table({"part": p[cut], "starts": binaries(start[own] + off[i], each), "runs": binaries(run[i], each)}).cast(FOUND_TYPE).to_batches()
