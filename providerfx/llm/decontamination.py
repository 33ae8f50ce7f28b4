"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Training words stream through the automaton, which keeps the length of the longest suffix that occurs in any
item. Stretches of words that cannot hold a whole window, since two neighbours never stand side by side in an
item, are skipped by vectorised look-ups first; that changes no result. The driver builds an automaton of a bounded
number of items, one at a time, and broadcasts it as arrays.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm import words as W

RANGE_BYTES = 1 << 19
#: Most bytes of item texts in one automaton, about, or one longer item; more items make more automata. A broadcast holds some 20 times that.
AUTOMATON_BYTES = 1 << 20
FOUND = "n_words long, hits array<struct<start:long,end:long,from:long,to:long>>, items array<string>, rest string"
FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string())), ("rest", pa.string())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split(b" ") if text else []


#: A-Z to a-z, bytes of words kept, all others a space.
TO_WORDS = bytes(int(W.LOWER[b]) if W.ALNUM[W.LOWER[b]] else 0x20 for b in range(256))


def without(raw: bytes, hits: list[dict]) -> str:
    """The text without the stretches, a space in the place of each."""
    at, kept = 0, []
    for h in sorted(hits, key=lambda h: h["from"]):
        kept.append(raw[at : h["from"]].rstrip())
        at = max(at, h["to"])
    return b" ".join(x for x in [*kept, raw[at:].lstrip()] if x).decode()


class Builder:
    """Generalised suffix automaton over sequences of word numbers, while it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self.extend(last, c)

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self.clone(last, c, q)
        new = self.state({}, self.len[last] + 1, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            q = self.next[last][c]
            self.link[new] = q if self.len[q] == self.len[last] + 1 else self.clone(last, c, q)
        return new

    def state(self, edges: dict, length: int, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def clone(self, p: int, c: int, q: int) -> int:
        new = self.state(dict(self.next[q]), self.len[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new


class Automaton:
    """A built automaton as arrays, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        vocabulary: dict[bytes, int] = {}
        sequences = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text) if w]) for name, text in items]
        sequences = [(name, s) for name, s in sequences if s]
        built = Builder()
        for _, s in sequences:
            built.add(s)
        self.window, self.v = window, max(1, len(vocabulary))
        self.short = sorted({len(s) for _, s in sequences if len(s) < window})
        self.need = min([window, *self.short])
        edges = np.array([(state * self.v + c, to) for state, own in enumerate(built.next) for c, to in own.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.edges, self.to = edges[:, 0].copy(), edges[:, 1].astype(np.int32)
        self.link, self.len = np.array(built.link, np.int32), np.array(built.len, np.int32)
        del built
        self.ready()
        # items of the windows, by (state, size)
        found, self.names = set(), sorted({name for name, _ in sequences})
        number = {name: i for i, name in enumerate(self.names)}
        for name, s in sequences:
            size, state, length = min(window, len(s)), 0, 0
            for c in s:
                state, length = self.step(state, length, c)
                if length >= size:
                    found.add((self.at(state, size) * (window + 1) + size, number[name]))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.windows, self.owners = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.pairs = np.array(sorted({a * self.v + b for _, s in sequences for a, b in zip(s, s[1:])}), np.int64)
        raw = pa.array(list(vocabulary), pa.large_binary())
        buf, offs = W.flat(raw)
        h = W.span_hash(buf, offs[:-1], offs[1:]) if len(raw) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], order

    def ready(self) -> None:
        """Views that give numbers to single look-ups."""
        self._edges, self._to, self._link, self._len = (memoryview(x) for x in (self.edges, self.to, self.link, self.len))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.ready()

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and the length of the longest matching suffix after one more word."""
        while True:
            i = bisect_left(self._edges, state * self.v + c)
            if i < len(self._edges) and self._edges[i] == state * self.v + c:
                return self._to[i], length + 1
            state = self._link[state]
            if state < 0:
                return 0, 0
            length = self._len[state]

    def at(self, state: int, size: int) -> int:
        """The state of the suffix of `size` words of what `state` matches."""
        while self._len[self._link[state]] >= size:
            state = self._link[state]
        return state

    def scan(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal stretches [a, z) of words inside windows, and the items of these windows."""
        state = length = 0
        stretches: list[list[int]] = []
        found: set[int] = set()
        for i, c in enumerate(numbers):
            state, length = self.step(state, length, c)
            for size in (*self.short, self.window):
                if length >= size:
                    key = self.at(state, size) * (self.window + 1) + size
                    lo, hi = np.searchsorted(self.windows, (key, key + 1))
                    if lo == hi:
                        continue
                    found.update(self.owners[lo:hi].tolist())
                    a = i + 1 - size
                    while stretches and stretches[-1][1] >= a:
                        a = min(a, stretches.pop()[0])
                    stretches.append([a, i + 1])
        return [(a, z) for a, z in stretches], {self.names[k] for k in found}

    def search(self, col) -> pa.Array:
        """FOUND_TYPE of each text: words, stretches (in words and in bytes), items, and the text without the stretches, if any."""
        B.release()
        buf, offs = W.flat(col)
        total, hits, names = np.zeros(len(offs) - 1, np.int64), {}, {}
        for lo, hi in W.runs_of_docs(offs, RANGE_BYTES):
            part = offs[lo : hi + 1] - offs[lo]
            low = W.LOWER[buf[offs[lo] : offs[hi]]]
            low = np.concatenate([low, np.zeros(16, np.uint8)])
            starts, ends, woffs = W.spans(low, part, W.ALNUM)
            total[lo:hi] = np.diff(woffs)
            if not len(starts) or not len(self.hashes):
                continue
            h = W.span_hash(low, starts, ends)
            near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            number = np.where(self.hashes[near] == h, self.numbers[near], -1)
            linked = np.zeros(len(number) + 1, bool)  # [i]: words i-1 and i stand side by side in an item
            both = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
            linked[both + 1] = B.member(number[both] * self.v + number[both + 1], self.pairs)
            linked[woffs] = False
            first = np.flatnonzero(~linked[:-1])
            size = np.diff(np.append(first, len(number)))
            for a, n in zip(first[(size >= self.need) & (number[first] >= 0)].tolist(), size[(size >= self.need) & (number[first] >= 0)].tolist()):
                stretches, who = self.scan(number[a : a + n].tolist())
                if stretches:
                    d = int(np.searchsorted(woffs, a, "right")) - 1
                    w0, b0 = int(woffs[d]), int(part[d])
                    hits.setdefault(lo + d, []).extend({"start": a + s - w0, "end": a + e - w0, "from": int(starts[a + s]) - b0, "to": int(ends[a + e - 1]) - b0} for s, e in stretches)
                    names.setdefault(lo + d, set()).update(who)
        n = len(offs) - 1
        rest = [without(buf[offs[i] : offs[i + 1]].tobytes(), hits[i]) if i in hits else None for i in range(n)]
        return pa.StructArray.from_arrays([pa.array(total), pa.array([hits.get(i, []) for i in range(n)], FOUND_TYPE[1].type), pa.array([sorted(names.get(i, ())) for i in range(n)], FOUND_TYPE[2].type), pa.array(rest, pa.string())], fields=list(FOUND_TYPE))


def item_rows(items: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """(item, text, part) of the items with an id, and in how many groups of about AUTOMATON_BYTES they are."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("item is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    n = -(-2 * size // AUTOMATON_BYTES) if size > AUTOMATON_BYTES else 1
    return rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def found_udf(spark, items: list[tuple[str, bytes]], window: int):
    built = spark.sparkContext.broadcast(Automaton(items, window))

    @F.arrow_udf(FOUND)
    def found(text: pa.Array) -> pa.Array:
        return built.value.search(text)

    # else a filter on the result would have the texts searched twice, by more workers
    return found.asNondeterministic()


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matches(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "found") -> DataFrame:
    """df with the struct `into`: n_words, hits (maximal stretches inside windows, in words and in bytes), items and rest.

    rest: the text without the stretches, each of them a space, or null without hits. A null text has no words; an
    empty benchmark hits nothing; items that share an id count as one; an item with a null id or without words is left
    out. A column named `into` is replaced; other columns of df and repeated rows stay as they are. Beyond
    AUTOMATON_BYTES of items, documents stream through one automaton after another, with a table between them; the
    driver holds the items of one automaton at a time.
    """
    spark = df.sparkSession
    B.small_batches(spark)
    rows, n = item_rows(items, item_id, item_text)
    col = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    more, out = free_name(df, "_more"), df
    for k in range(n):
        group = sorted((r["item"], r["text"].encode()) for r in rows.filter(F.col("part") == k).collect())
        found = found_udf(spark, group, window)
        if not k:
            out = df.withColumn(into, found(col))
            continue
        out = B.written(out, "found").withColumn(more, found(col))
        hits, names = F.concat(f"{into}.hits", f"{more}.hits"), F.array_union(f"{into}.items", f"{more}.items")
        out = out.withColumn(into, F.struct(F.col(f"{into}.n_words").alias("n_words"), merged(hits).alias("hits"), names.alias("items"), F.lit(None).cast("string").alias("rest"))).drop(more)
    return with_rest(out, text, into) if n > 1 else out


def with_rest(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the text without the merged stretches as `into`.rest."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([without(t.as_py().encode(), h) if h else None for t, h in zip(texts, hits.to_pylist())], pa.string())

    return df.withColumn(into, F.col(into).withField("rest", cut(F.coalesce(F.col(f"`{text}`"), F.lit("")), f"{into}.hits")))


def merged(hits):
    """Maximal stretches of overlapping ones."""
    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<start:long,end:long,from:long,to:long>>")
    return F.aggregate(F.array_sort(hits), empty, add)


def n_hit(found: str = "found"):
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def decontaminate(df: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", **kw) -> DataFrame:
    """df without contaminated spans: documents with more than max_coverage of their words hit go whole.

    From the others all stretches of hit words are cut out, with one space in their place; the rest of the text is
    unchanged. Null texts stay null, untouched rows and all other columns stay as they are. Further arguments are
    those of matches().
    """
    found = free_name(df, "_found")
    m, hit = matches(df, items, window, text, into=found, **kw), n_hit(found)
    keep = m.filter((hit == 0) | (hit <= F.lit(max_coverage) * F.col(f"{found}.n_words")))
    return keep.withColumn(text, F.when(F.size(f"{found}.hits") == 0, F.col(f"`{text}`")).otherwise(F.col(f"{found}.rest"))).drop(found)
