"""MinHash near-dedup by an LSH forest.

Documents with equal shingle sets are one class. Each tree orders the classes by a sequence of minhashes; a class
is compared with its neighbours in the order, as far as they share a prefix: the longest-prefix neighbour always,
others only if the prefix is as deep as the region is crowded. Candidates are confirmed on their full sets, which
are made anew from the text blocks; components of confirmed links are found with distributed stars.

That joins most of what belongs together at little cost. What it leaves apart is compared in full: in a region that
holds several components, first all classes with the best linked one, then every two classes of different components.
Two classes that share a region are so either compared or known to be connected, however crowded the region is. Large
regions do the latter in cells of a bounded number of classes, inside of tasks: only links leave them, no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from providerfx.llm import blocks as B
from providerfx.llm import words as W
from providerfx.llm.graphs import components

RANGE_BYTES = 1 << 19
TREES, LEVELS, LEVEL_BITS = 20, 6, 16
#: Least percent that the trees are made for.
LEAST_PERCENT = 50
#: A region (classes of one tree with a common base prefix) of up to so many classes compares all of them.
SMALL_REGION = 4
#: Classes of a region on each side of a cell, in which every two are compared.
CELL = 256
#: A region of several components and up to so many classes gives its few pairs to the same confirmation as neighbours.
PAIRED_REGION = 16
#: Columns of a cell's table of sets at a time.
CELL_COLUMNS = 8192
SET_BYTES = 6
_RNG = np.random.default_rng(20260101)
XORS = _RNG.integers(0, 2**63, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODDS = _RNG.integers(0, 2**63, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(col, k: int):
    """For each range of documents: first and last document, distinct shingle hashes in order, and offsets by document."""
    buf, offs = W.flat(col)
    for lo, hi in W.runs_of_docs(offs, RANGE_BYTES):
        low = np.concatenate([W.LOWER[buf[offs[lo] : offs[hi]]], np.zeros(16, np.uint8)])
        starts, ends, woffs = W.spans(low, offs[lo : hi + 1] - offs[lo], W.NOT_WHITE)
        h, n = W.span_hash(low, starts, ends), np.diff(woffs)
        r, at = W.rolling(h, k), np.flatnonzero(W.inside(woffs, k, len(h)))
        doc, sh = np.searchsorted(woffs, at, "right") - 1, r[at]
        few = np.flatnonzero((n > 0) & (n < k))
        if few.size:  # the whole sequence is the one shingle
            own = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = n[few] > j
                own[has] = W.mix((own[has] + W.SEEDS[0]) ^ h[woffs[:-1][few[has]] + j])
            doc, sh = np.concatenate([doc, few]), np.concatenate([sh, W.mix(own ^ W.SEEDS[1])])
        order = np.lexsort((sh, doc))
        doc, sh = doc[order], sh[order]
        if len(sh):
            new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])])
            doc, sh = doc[new], sh[new]
        yield lo, hi, sh, np.searchsorted(doc, np.arange(hi - lo + 1))


def signatures(sh: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums that stand for each set, and its TREES * LEVELS minhashes of LEVEL_BITS bits (0 where empty)."""
    n = len(offs) - 1
    out, sums = np.zeros((n, TREES * LEVELS), np.uint16), [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        at = offs[:-1][full]
        for s, seed in zip(sums, W.SEEDS):
            s[full] = np.add.reduceat(W.mix(sh ^ seed), at)
        work = np.empty_like(sh)
        for j in range(TREES * LEVELS):
            np.bitwise_xor(sh, XORS[j], out=work)
            np.multiply(work, ODDS[j], out=work)
            out[full, j] = (W.mix(np.minimum.reduceat(work, at)) >> np.uint64(64 - LEVEL_BITS)).astype(np.uint16)
    return sums[0].view(np.int64), sums[1].view(np.int64), out


def common_levels(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Equal leading levels, from the xor of both parts of two keys."""
    out = np.zeros(len(k1), np.int64)
    going = np.ones(len(k1), bool)
    for level in range(LEVELS):
        x, s = (k1, 64 - LEVEL_BITS * (level + 1)) if level < 4 else (k2, 64 - LEVEL_BITS * (level - 3))
        going &= (x >> np.uint64(s)) & np.uint64((1 << LEVEL_BITS) - 1) == 0
        out += going
    return out


def base_depth(percent: int) -> int:
    """Least common prefix of candidates, in levels: the most that a pair just similar enough shares in about half of the trees (3 for 80)."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    return max(d for d in range(1, LEVELS + 1) if percent**d >= 0.5 * 100**d)


def region_depth(size: np.ndarray, base: int) -> np.ndarray:
    """Levels that a neighbour beyond the nearest must share, by how many classes the region holds."""
    return np.minimum(base + (size > 64).astype(np.int64) + (size > 4096), LEVELS)


NODE = ["node", "home", "mark", "size"]
ENTRY = "tree int, k1 long, k2 long, " + ", ".join(f"{c} long" for c in NODE)
PAIR = "edge int, at int, " + ", ".join(f"{p}_{c} long" for p in "ab" for c in NODE) + ", tree int, k1 long, k2 long"


def neighbours(batches, percent: int):
    """Candidate pairs of one partition of the sorted entries, and its first and last entry (edge 0 and 1)."""
    t, base = pa.Table.from_batches(list(batches)), base_depth(percent)
    if not t.num_rows:
        return
    t = t.combine_chunks()
    tree, k1, k2 = (t[c].to_numpy() for c in ("tree", "k1", "k2"))
    size = t["size"].to_numpy()
    u1, u2 = k1.view(np.uint64), k2.view(np.uint64)
    m = len(tree)

    def shared(gap):
        x = common_levels(u1[gap:] ^ u1[:-gap], u2[gap:] ^ u2[:-gap])
        x[tree[gap:] != tree[:-gap]] = 0
        a, b = size[gap:], size[:-gap]
        return x, 100 * np.minimum(a, b) >= percent * np.maximum(a, b)

    pairs = [np.zeros((0, 2), np.int64)]
    if m > 1:
        near, fits = shared(1)
        region = np.concatenate([[0], np.cumsum(near < base)])
        count = np.bincount(region)[region]
        before, after = np.concatenate([[0], near]), np.concatenate([near, [0]])
        best = near >= np.minimum(np.maximum(before, after)[1:], np.maximum(before, after)[:-1])
        ok = (near >= base) & fits & (best | (near >= region_depth(count[1:], base)))
        i = np.flatnonzero(ok)
        pairs.append(np.stack([i, i + 1], 1))
        for gap in range(2, SMALL_REGION):
            if m > gap:
                far, fits = shared(gap)
                i = np.flatnonzero((far >= base) & fits & (count[gap:] <= SMALL_REGION))
                pairs.append(np.stack([i, i + gap], 1))
        # a neighbour of another size can't be linked; the next of a fitting size takes its place
        i = np.flatnonzero((near >= base) & ~shared(1)[1])
        if len(i):
            order = np.lexsort((np.arange(m), size, region))
            r, s = region[order], size[order]
            j = np.flatnonzero((r[1:] == r[:-1]) & (100 * s[:-1] >= percent * s[1:]) & np.isin(r[1:], region[i]))
            pairs.append(np.stack([order[j], order[j + 1]], 1))
    p = np.concatenate(pairs)
    pid = TaskContext.get().partitionId()
    a, b = np.concatenate([p[:, 0], [0, m - 1]]), np.concatenate([p[:, 1], [0, m - 1]])
    edge = pa.array(np.concatenate([np.full(len(p), -1), [0, 1]]).astype(np.int32))
    cols = [edge, pa.array(np.full(len(a), pid, np.int32))]
    cols += [t[c].take(pa.array(i)).combine_chunks() for i in (a, b) for c in NODE]
    cols += [t[c].take(pa.array(a)).combine_chunks() for c in ("tree", "k1", "k2")]
    names = ["edge", "at", *(f"{q}_{c}" for q in "ab" for c in NODE), "tree", "k1", "k2"]
    yield from pa.table(cols, names=names).to_batches()


def levels(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, TREES, LEVELS).astype(np.uint64)


def ordered(both: DataFrame) -> DataFrame:
    """The distinct pairs with a_node < b_node."""
    swap = F.col("a_node") > F.col("b_node")
    cols = [F.when(swap, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in ("ab", "ba") for c in NODE]
    return both.filter("a_node <> b_node").select(*cols).distinct()


def candidates(nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a_*, b_*) of distinct pairs of neighbours, a_node < b_node, from nodes (node, home, mark, size, sig)."""

    def entries(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            sig = levels(b)
            k1 = sum(sig[:, :, j] << np.uint64(48 - 16 * j) for j in range(4))
            k2 = sum(sig[:, :, j] << np.uint64(48 - 16 * (j - 4)) for j in range(4, LEVELS))
            rep = pa.array(np.repeat(np.arange(m), TREES))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), pa.array(k1.ravel().view(np.int64)), pa.array(k2.ravel().view(np.int64)), *(b.column(c).take(rep) for c in NODE)], names=["tree", "k1", "k2", *NODE])

    keys = ["tree", "k1", "k2", "node", "mark"]
    rows = nodes.mapInArrow(entries, ENTRY).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    found = B.written(rows.mapInArrow(lambda batches: neighbours(batches, percent), PAIR), "pairs")
    # neighbours on both sides of a partition's end
    end = found.filter("edge = 1").select((F.col("at") + 1).alias("at"), "tree", F.col("k1").alias("e1"), *(F.col(f"a_{c}") for c in NODE))
    first = found.filter("edge = 0").select("at", "tree", F.col("k1").alias("s1"), *(F.col(f"b_{c}") for c in NODE))
    shift = 64 - min(base_depth(percent), 3) * LEVEL_BITS
    across = end.join(first, ["at", "tree"]).filter(F.shiftrightunsigned("e1", shift) == F.shiftrightunsigned("s1", shift))
    names = [f"{p}_{c}" for p in "ab" for c in NODE]
    return ordered(found.filter("edge = -1").select(*names).union(across.select(*names)))


def places(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes with the hashes of their regions, one for each tree, in place of sig."""

    def placed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = levels(b)
            h = np.tile(W.mix(np.arange(1, TREES + 1, dtype=np.uint64)), (b.num_rows, 1))
            for j in range(depth):
                h = W.mix(h * W.SEEDS[0] + sig[:, :, j])
            regions = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TREES), pa.array(h.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in NODE), regions], names=[*NODE, "regions"])

    return nodes.mapInArrow(placed, ", ".join(f"{c} long" for c in NODE) + ", regions array<long>")


def in_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")


def apart(placed: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(region, tree, NODE, regions, component): the classes of each region that holds several components."""
    at = in_component(placed, roots)
    several = at.select(F.explode("regions").alias("region"), "component").groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("region")
    several = few(several, "several", n)  # a table, so that both sides of the join are dealt and Spark can split a large region's rows
    keys = at.select("node", "mark", F.posexplode("regions").alias("tree", "region")).join(several, "region", "left_semi")
    return keys.join(at, ["node", "mark"]).select("region", "tree", *NODE, "regions", "component")


def side(p: str):
    return [F.col(c).alias(f"{p}_{c}") for c in [*NODE, "component"]]


def linkable(percent: int):
    return (F.col("a_component") != F.col("b_component")) & (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))


def with_hubs(members: DataFrame, links: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs of each region's class of the most links (a) with the classes of other components (b)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    best = F.max(F.struct(F.coalesce("n_links", F.lit(0)).alias("n_links"), *NODE, "component")).alias("h")
    hubs = members.join(ends, "node", "left").groupBy("region").agg(best).select("region", "h.*").select("region", *side("a"))
    hubs = few(hubs, "hubs", n)
    pairs = members.select("region", *side("b")).join(hubs, "region").filter(linkable(percent))
    return pairs.select(*(f"{p}_{c}" for p in "ab" for c in NODE)).distinct()


def regions_apart(members: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """members of regions that still hold several components, with their component now, the region's largest one (main), and rows and cols of cells."""
    at = in_component(members.drop("component"), roots)
    of = at.groupBy("region", "component").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("m"))
    of = of.filter("all > m.n").select("region", "all", F.col("m.component").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / CELL).alias("rows"), F.ceil(F.col("all") / CELL).alias("cols"))
    return at.join(few(of, "regions", n), "region")


def paired(at: DataFrame, percent: int) -> DataFrame:
    """Every two classes of a region in different components, once, in the first tree that has them together."""
    a = at.select("region", "tree", *side("a"), F.col("regions").alias("a_regions"))
    b = at.select("region", *side("b"), F.col("regions").alias("b_regions"))
    first = F.expr("array_position(zip_with(a_regions, b_regions, (x, y) -> x = y), true) = tree + 1")
    return ordered(a.join(b, "region").filter("a_node < b_node").filter(linkable(percent)).filter(first))


CELL_KEY = ["region", "row", "col"]
CLASS = ["node", "size", "component", "main", "tree", "regions"]
WANTED = [*CELL_KEY, "left", *CLASS]


def in_cells(at: DataFrame) -> DataFrame:
    """The classes of a region outside of its main component meet all classes in cells of some CELL x CELL."""
    cell = lambda n: F.pmod(F.xxhash64("node", "mark"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = [F.col("home").cast("int").alias("part"), "mark", "region"]
    a = at.filter("component <> main").select(*cols, cell("rows").alias("row"), every("cols").alias("col"), F.lit(True).alias("left"), *CLASS)
    b = at.select(*cols, every("rows").alias("row"), cell("cols").alias("col"), F.lit(False).alias("left"), *CLASS)
    return a.union(b)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets of sorted distinct values, one from each list."""
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    entries = []
    for sets, v in ((a, va), (b, vb)):
        own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        hit = np.flatnonzero(B.member(v, both))
        col = np.searchsorted(both, v[hit])
        by = np.argsort(col, kind="stable")
        entries.append((own[hit][by], col[by]))
    for lo in range(0, len(both), CELL_COLUMNS):
        tables = []
        for (own, col), n in zip(entries, out.shape):
            i, j = np.searchsorted(col, (lo, lo + CELL_COLUMNS))
            t = np.zeros((n, min(CELL_COLUMNS, len(both) - lo)), np.float32)
            t[own[i:j], col[i:j] - lo] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def links_of_cell(t: pa.Table, percent: int) -> pa.Table:
    """(a, b) of the linked classes of different components in one cell."""
    no_links = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    col = lambda c: t[c].to_numpy()
    left = np.flatnonzero(t["left"].to_numpy())
    right = np.flatnonzero(~t["left"].to_numpy())
    if not len(left) or not len(right):
        return no_links
    node, size, component = col("node"), col("size"), col("component")
    regions = np.stack(t["regions"].to_numpy())
    a, b = size[left][:, None], size[right][None]
    ok = (component[left][:, None] != component[right][None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    ok &= (component[right] == col("main")[0])[None] | (node[left][:, None] < node[right][None])
    i, j = np.nonzero(ok)
    first = (regions[left[i]] == regions[right[j]]).argmax(1) == col("tree")[0]  # else they meet in the cell of an earlier tree
    i, j = i[first], j[first]
    if not len(i):
        return no_links
    x, y = np.unique(i), np.unique(j)
    raw = t["set"].combine_chunks()
    sets = lambda at: [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in at.tolist()]
    both = overlaps(sets(left[x]), sets(right[y]))[np.searchsorted(x, i), np.searchsorted(y, j)]
    link = 100 * both >= percent * (size[left[i]] + size[right[j]] - both)
    return pa.table({"a": node[left[i[link]]], "b": node[right[j[link]]]})


def cell_links(blocks: DataFrame, wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) of all links in the cells; the sets of the classes travel to their cells, and nothing else leaves a cell."""
    fields = "region long, row long, col long, left boolean, node long, size long, component long, main long, tree int, regions array<long>, set binary"
    schema = pa.schema([(c, {"left": pa.bool_(), "tree": pa.int32(), "regions": pa.list_(pa.int64()), "set": pa.binary()}.get(c, pa.int64())) for c in [*WANTED, "set"]])

    def with_sets(key, table, asked):
        if not asked.num_rows:
            return schema.empty_table()
        node, mark = asked["node"].to_numpy(), asked["mark"].to_numpy()
        own, own_mark, _ = (x.view(np.int64) for x in B.pairs_unique(node.view(np.uint64), mark.view(np.uint64)))
        sets = pa.array([np.ascontiguousarray(x).tobytes() for x in sets_of(table, own, own_mark, shingle)], pa.binary())
        of = place_of(node, mark, own, own_mark)
        return asked.select(WANTED).append_column("set", sets.take(pa.array(of))).cast(schema)

    def compared(batches):
        held = []
        for b in batches:
            held.append(b)
            key = [b.column(c) for c in CELL_KEY]
            if b.num_rows and any(k[0] != k[-1] for k in key) or len(held) > 1 and any(held[0].column(c)[0] != b.column(c)[-1] for c in CELL_KEY):
                t = pa.Table.from_batches(held).combine_chunks()
                cut = cells(t)
                for lo, hi in zip(cut, cut[1:]):
                    yield from links_of_cell(t.slice(lo, hi - lo).combine_chunks(), percent).to_batches()
                held = t.slice(cut[-1]).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from links_of_cell(t.combine_chunks(), percent).to_batches()

    def cells(t):
        k = np.stack([t[c].to_numpy() for c in CELL_KEY])
        return [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]

    sent = blocks.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(with_sets, fields)
    return sent.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY).mapInArrow(compared, "a long, b long")


def few(df: DataFrame, name: str, n: int, blocks: int = 8) -> DataFrame:
    """A table of distinct small rows, in a file for so many of the n blocks of text: tables of pairs and links are small against the texts."""
    return B.written(df.distinct().coalesce(max(1, n // blocks)), name)


def rest_of_links(blocks: DataFrame, nodes: DataFrame, links: DataFrame, n: int, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the components of links and of all further links between classes that share a region."""
    chains = lambda roots, more: few(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "chains", n)
    roots = few(components(links), "roots", n)
    members = few(apart(places(nodes, base_depth(percent)), roots, n), "members", n, 2)
    if members.isEmpty():
        return roots
    hubs = few(with_hubs(members, links, n, percent), "hubs", n)
    more = few(confirmed(blocks, hubs, shingle, percent), "links", n)
    if not more.isEmpty():
        roots = few(components(chains(roots, more)), "roots", n)
    at = few(regions_apart(members, roots, n), "apart", n, 2)
    rest = few(paired(at.filter(F.col("all") <= PAIRED_REGION), percent), "rest", n)
    more = confirmed(blocks, rest, shingle, percent).union(cell_links(blocks, in_cells(at.filter(F.col("all") > PAIRED_REGION)), shingle, percent))
    more = few(more, "links", n)
    return roots if more.isEmpty() else components(chains(roots, more))


def sets_of(table: pa.Table, ids: np.ndarray, marks: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sets of a block's documents with these ids and set sums."""
    t = B.from_ipc(table["blob"].to_pylist())
    doc = t["_id"].combine_chunks().fill_null(0).to_numpy()
    rows = np.flatnonzero(np.isin(doc, ids) & t["_id"].is_valid().to_numpy())
    t, doc, got = t.take(pa.array(rows)), doc[rows], {}
    for lo, hi, sh, offs in shingle_sets(t["text"], shingle):
        full = np.flatnonzero(np.diff(offs))
        if len(full):
            sums = np.add.reduceat(W.mix(sh ^ W.SEEDS[0]), offs[:-1][full]).view(np.int64)
            for i, s in zip(full.tolist(), sums.tolist()):
                got[int(doc[lo + i]), s] = sh[offs[i] : offs[i + 1]] >> np.uint64(64 - 8 * SET_BYTES)
    return [got[i, m] for i, m in zip(ids.tolist(), marks.tolist())]


def confirmed(blocks: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough.

    The set of a travels to the block of b, once for all its pairs there, so a class with very many partners is best a.
    """
    def send(key, table, asked):
        t = asked.sort_by([("b_home", "ascending"), ("a_node", "ascending"), ("a_mark", "ascending")]).combine_chunks()
        if not t.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "sets": pa.array([], pa.binary())})
        node, mark, home = (t[c].to_numpy() for c in ("a_node", "a_mark", "b_home"))
        node_of, mark_of, _ = B.pairs_unique(node.view(np.uint64), mark.view(np.uint64))
        sets = sets_of(table, node_of.view(np.int64), mark_of.view(np.int64), shingle)
        raw = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes() for x in sets]
        at = place_of(node, mark, node_of.view(np.int64), mark_of.view(np.int64))
        cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        rows = [B.to_ipc(pa.table({"node": node[lo:hi], "mark": mark[lo:hi], "set": pa.array([raw[i] for i in at[lo:hi].tolist()], pa.large_binary())})) for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(home)])]
        return pa.table({"part": pa.array(home[cut].astype(np.int32)), "sets": pa.array(rows, pa.binary())})

    def compare(key, table, both):
        sent = B.from_ipc([x for x in both["sets"].to_pylist() if x is not None] or [B.to_ipc(NO_SETS)])
        p = both.filter(both["a_node"].is_valid())
        a, a_mark, b, b_mark = (p[c].to_numpy() for c in ("a_node", "a_mark", "b_node", "b_mark"))
        at = np.lexsort((sent["mark"].to_numpy(), sent["node"].to_numpy()))
        of = at[place_of(a, a_mark, sent["node"].to_numpy()[at], sent["mark"].to_numpy()[at])]
        node_of, mark_of, _ = B.pairs_unique(b.view(np.uint64), b_mark.view(np.uint64))
        own = sets_of(table, node_of.view(np.int64), mark_of.view(np.int64), shingle)
        sets, linked, last, other = sent["set"], [], None, None
        order = np.argsort(of, kind="stable")
        mine_of = place_of(b, b_mark, node_of.view(np.int64), mark_of.view(np.int64))
        for k in order.tolist():
            if of[k] != last:
                last, raw = of[k], np.frombuffer(sets[int(of[k])].as_buffer(), np.uint8).reshape(-1, SET_BYTES)
                other = np.zeros((len(raw), 8), np.uint8)
                other[:, :SET_BYTES] = raw
                other = other.view(np.uint64).ravel()
            mine = own[mine_of[k]]
            common = int(B.member(other, mine).sum())
            if 100 * common >= percent * (len(mine) + len(other) - common):
                linked.append(k)
        return pa.table({"a": a[linked], "b": b[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    asked = pairs.select(F.col("a_home").cast("int").alias("part"), "a_node", "a_mark", "b_home").distinct()
    sent = blocks.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(send, "part int, sets binary")
    none = F.lit(None).cast("long")
    pairs = pairs.select(F.col("b_home").cast("int").alias("part"), F.lit(None).cast("binary").alias("sets"), "a_node", "a_mark", "b_node", "b_mark")
    both = sent.select("part", "sets", *(none.alias(c) for c in ("a_node", "a_mark", "b_node", "b_mark"))).union(pairs)
    return blocks.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(compare, "a long, b long")


NO_SETS = pa.table({"node": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "set": pa.array([], pa.large_binary())})


def place_of(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where each pair (a, b) is among the distinct pairs (first, second), all of which are there."""
    both = np.concatenate([first, a]), np.concatenate([second, b])
    order = np.lexsort((np.arange(len(both[0])) >= len(first), both[1], both[0]))
    new = order < len(first)
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out[len(first) :]


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """df (or these columns of it) with n_shingles, component_id (smallest id reachable by links) and kept (the id is that one).

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z became a-z; a set holds the distinct runs of `shingle` words, or the
    whole sequence of a shorter text. Linked are sets with 100 * intersection >= percent * union; percent is from 50
    to 100, and below 80 there are fewer, larger regions, which cost more. A null or empty
    text has an empty set and no links. A row with a null id links with nothing, has a null component and is kept;
    rows that share an id are documents of their own with that id. Columns named like a result column are
    replaced; an empty df gives an empty result.
    """
    base_depth(percent)  # refuses others
    n = B.parts_of(df, text)
    made = ["n_shingles", "component_id", "kept"]
    rest = [c for c in (df.columns if columns is None else columns) if c not in made]
    name = {c: "text" if c == text else f"c{i}" for i, c in enumerate(rest)}  # texts are in the blocks once
    named = df.select(*(F.col(f"`{c}`").alias(a) for c, a in name.items() if c != text), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("text"))
    blocks = B.to_blocks(B.dealt(named, n, "_id", "text"), n)

    def signed(key, table):
        t = B.from_ipc(table["blob"].to_pylist())
        sizes, one, two, sig = [], [], [], []
        for _, _, sh, offs in shingle_sets(t["text"], shingle):
            x, y, z = signatures(sh, offs)
            sizes.append(np.diff(offs))
            one.append(x)
            two.append(y)
            sig += [r.tobytes() for r in z]
        cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        return pa.table({"node": t["_id"], "home": pa.array(np.full(len(t), key[0].as_py(), np.int64)), "row": pa.array(np.arange(len(t))), "mark": cat(one), "mark2": cat(two), "size": cat(sizes), "sig": pa.array(sig, pa.binary())})

    sets = B.written(blocks.groupBy("part").applyInArrow(signed, "node long, home long, row long, mark long, mark2 long, size long, sig binary"), "sets")
    kinds = B.written(sets.filter("size > 0 and node is not null").groupBy("mark", "mark2", "size").agg(F.min("node").alias("rep")).coalesce(max(1, n // 4)), "classes")
    reps = kinds.select(F.col("rep").alias("node"), "mark", "mark2", "size")
    nodes = B.written(sets.join(reps, ["node", "mark", "mark2", "size"], "left_semi").dropDuplicates(["node", "mark", "mark2"]).select(*NODE, "sig").coalesce(max(1, n // 2)), "nodes")
    pairs = few(candidates(nodes, n, percent), "candidates", n, 2)
    roots = rest_of_links(blocks, nodes, few(confirmed(blocks, pairs, shingle, percent), "links", n), n, shingle, percent)
    settled = kinds.join(roots, F.col("rep") == F.col("node"), "left").select("mark", "mark2", "size", F.coalesce("root", "rep").alias("component"))
    rows = sets.select("node", "home", "row", "mark", "mark2", "size").join(settled, ["mark", "mark2", "size"], "left")
    verdict = rows.select(F.col("home").cast("int").alias("part"), "row", "size", F.when(F.col("node").isNotNull(), F.coalesce("component", "node")).alias("component"))
    schema = T.StructType([*(T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(rest)), T.StructField("n_shingles", T.LongType()), T.StructField("component_id", T.LongType()), T.StructField("kept", T.BooleanType())])

    def attach(key, table, found):
        t, found = B.from_ipc(table["blob"].to_pylist()), found.sort_by("row")
        node, component = t["_id"].combine_chunks(), found["component"].combine_chunks()
        kept = pc.fill_null(pc.equal(node, component), True)
        return pa.Table.from_arrays([*(t[a] for a in name.values()), found["size"], component, kept], names=[*(f"c{i}" for i in range(len(rest))), *made])

    out = blocks.groupBy("part").cogroup(verdict.groupBy("part")).applyInArrow(attach, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), *made)
