"""Whole contracts against brute force, on small inputs with hot keys, long runs, odd rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from providerfx.llm import blocks, byte_spans, decontamination, near_duplicates, packing, quality, substrings, toxicity, token_file

BYTES = public_tokenizers.path("byte_bpe_50k.json")
R = random.Random(11)
VOCAB = [a + b for a in ("ka", "lo", "mé", "ti", "su", "ñe") for b in ("ra", "no", "ß", "ple", "x")]


def say(n):
    return " ".join(R.choice(VOCAB) + str(R.randrange(50)) for _ in range(n))


def test_labels_fill_every_partition(spark):
    for n in (1, 2, 7, 60):
        got = spark.createDataFrame([(int(x),) for x in blocks.labels(n)], "part int").repartition(n, "part").rdd.glom().map(len).collect()
        assert got == [1] * n


def test_pairs_need_both_hashes():
    first, second = np.array([1, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 7, 0], np.uint64)
    a, b = np.array([5, 5, 5, 9, 1, 4], np.uint64), np.array([7, 3, 1, 1, 1, 0], np.uint64)
    assert blocks.sifted_pairs(a, b, first, second, blocks.sieve(first)).tolist() == [0, 2, 4]


def brute_bytes(rows, size):
    """(n_bytes, n_removed, n_spans, kept) by id; an equal id removes nothing from itself."""
    smallest, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            smallest[b[p : p + size]] = min(i, smallest.get(b[p : p + size], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if smallest[b[p : p + size]] < i:
                gone[p : p + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.setdefault(i, []).append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_byte_spans_of_common_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(byte_spans, "HOT", hot)
    passage, other = say(12), say(9)
    texts = [say(R.randrange(3, 20)) + passage + say(R.randrange(0, 8)) for _ in range(60)] + [other + say(5) + other + passage[5:] for _ in range(10)]
    texts += ["x" * 3000 + say(2), "y" + "x" * 700, "xy" * 400, "yx" * 300, passage, passage, "", None, passage[:49], "é" * 60, "é" * 40]
    rows = list(enumerate(texts)) + [(3, passage), (3, passage)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gram int").repartition(3)
    got = {}
    for r in byte_spans.dedup_bytes(df, digest=True).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute_bytes(rows, 50)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_substrings_of_common_passages(spark):
    passage = say(40)
    texts = [say(R.randrange(1, 60)) + " " + passage + " " + say(R.randrange(1, 30)) for _ in range(50)] + ["w " * 90, "w " * 34, "w " * 35, "w " * 36, passage]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, part int, n int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["part"], r["n"]) for r in substrings.dedup_substrings(df, digest=True).collect()}
    words, seen = [t.split() for t in texts], {}
    for k, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((k, p))
    for k, w in enumerate(words):
        gone = {q for places in seen.values() if len(places) > 1 for j, p in places if j == k for q in range(p, p + 35)}
        assert got[k] == (len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest(), 1, 2)


def test_several_automata(spark, monkeypatch):
    items = [(f"i{k}", say(25)) for k in range(40)] + [("short", "kara1 zz"), ("empty", "..."), ("i3", say(12))]
    texts = [say(8) + ", " + " ".join(items[k][1].split()[3:18]) + "; " + say(6) + "\n" + " ".join(items[(k * 7) % 40][1].split()[:11]) for k in range(40)] + ["KARA1 ZZ", "kara1 zz kara1", say(30), None, ""]
    df = spark.createDataFrame([(k, t, True, 5) for k, t in enumerate(texts)], "doc_id long, text string, _hit boolean, found int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = {r["doc_id"]: r for r in decontamination.matches(df, bench, into="m").collect()}
    left = {r["doc_id"]: (r["text"], r["_hit"], r["found"]) for r in decontamination.decontaminate(df, bench).collect()}
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 1500)
    many = {r["doc_id"]: r for r in decontamination.matches(df, bench, into="m").collect()}
    assert {k: (r["m"]["n_words"], r["m"]["hits"], sorted(r["m"]["items"]), r["m"]["rest"]) for k, r in one.items()} == {k: (r["m"]["n_words"], r["m"]["hits"], sorted(r["m"]["items"]), r["m"]["rest"]) for k, r in many.items()}
    assert {r["doc_id"]: (r["text"], r["_hit"], r["found"]) for r in decontamination.decontaminate(df, bench).collect()} == left
    fold = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    for k, t in enumerate(texts):
        w, hit, names = fold(t), set(), set()
        for name, x in items:
            x = fold(x)
            n = min(10, len(x))
            wins = {tuple(x[p : p + n]) for p in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names.add(name)
        m = one[k]["m"]
        assert (m["n_words"], sum(h["end"] - h["start"] for h in m["hits"]), sorted(m["items"])) == (len(w), len(hit), sorted(names))
        assert (k in left) == (len(hit) <= 0.5 * len(w))


def rule(lengths, size):
    """Bins by the rule itself: the sum of squares after each choice, in order of falling length."""
    gaps, sums = [], []
    count = [0] * (size + 1)
    total = lambda: sum(c * c for c in count[1:size])
    for s in sorted(lengths, reverse=True):
        best = None
        for g in sorted({g for g in gaps if g >= s}) + [size]:
            new = g == size
            if not new:
                count[g] -= 1
            if 0 < g - s < size:
                count[g - s] += 1
            cost = total()
            if 0 < g - s < size:
                count[g - s] -= 1
            if not new:
                count[g] += 1
            if best is None or cost < best[0]:
                best = cost, g
        g = best[1]
        if g != size:
            gaps.remove(g)
            count[g] -= 1
        if g - s:
            gaps.append(g - s)
            count[g - s] += 1
        sums.append(total())
    return sorted(gaps)


def test_packing_follows_the_rule():
    rng = np.random.default_rng(4)
    for size in (7, 30, 64):
        for _ in range(20):
            lengths = rng.integers(1, size + 1, rng.integers(1, 120))
            bins, offset, n = packing.sum_of_squares(lengths, size)
            fill = np.bincount(bins, weights=lengths, minlength=n).astype(int)
            assert sorted(size - f for f in fill if f < size) == rule(lengths.tolist(), size)


def test_packing_pieces(spark):
    texts = [None, "", *(say(R.randrange(1, 400)) for _ in range(60)), "a b", "a b"]
    rows = [(i if i != 20 else None, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), BYTES, size=256, end_id=7).toPandas()
    lib, want = Tokenizer.from_file(BYTES), []
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 7]
        cuts = [0] if len(ids) <= 256 else [0, *range(len(ids) % 256 or 256, len(ids), 256)]
        for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want.append((-1 if i is None else i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"] == g["offset"]).all() and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= got["length"].sum() / 256 + 4


def test_packing_stops_without_gain(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 500)
    got = packing.pack_sequences(spark.range(1000).selectExpr("id", "1100L as length", "'x' as item")).toPandas()
    assert got["sequence_id"].nunique() == 1000 and (got["offset"] == 0).all()
    mixed = packing.pack_sequences(spark.range(2000).selectExpr("id", "1 + pmod(id * 7919, 2048) as length")).toPandas()
    assert mixed["sequence_id"].nunique() <= mixed["length"].sum() / 2048 * 1.03 + 1 and len(mixed) == 2000
    with pytest.raises(Exception, match="length is not in"):
        packing.pack_sequences(spark.createDataFrame([(0,)], "length long")).collect()


def test_quality_verdict(spark):
    """kept from the metrics and the fences of the row, and fences from all rows of the group."""
    rows = [(i, "aa" if i % 3 else None, "s1" if i % 5 else "s2", say(R.randrange(15, 90)) + " #" * R.choice([0, 0, 0, 1, 2, 9]), 4.0) for i in range(400)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, fence_size double")).toPandas()
    assert len(got) == 400
    words = lambda r: max(r["n_words"], 1)
    metric = {"symbol_share": lambda r: r["n_symbols"] / max(r["word_chars"], 1), "dup_share": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1), "repeat_share": lambda r: r["n_repeat_words"] / words(r), "word_length": lambda r: r["word_chars"] / words(r)}
    for _, r in got.iterrows():
        inside = all(f(r) <= r[f"fence_{m}_max"] for m, f in metric.items()) and metric["word_length"](r) >= r["fence_word_length_min"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and r["kept"] == (not r["base_failed"] and inside)
    for (lang, source), g in got.fillna({"lang": "-"}).groupby(["lang", "source"]):
        ok = g[~g["base_failed"]]
        if len(ok) < quality.LEAST_GROUP:
            ok = got[~got["base_failed"] & (got["lang"].fillna("-") == lang)]
        assert (g["fence_size"] == len(ok)).all()
        for m, f in metric.items():
            x = np.sort(ok.apply(f, axis=1).to_numpy())
            q = lambda p: x[int(np.ceil(len(x) * p)) - 1]
            high = max(min(q(quality.EXTREME), q(0.75) + max(quality.FENCE * (q(0.75) - q(0.25)), quality.UPPER[m])), quality.FLOOR[m])
            assert abs(g[f"fence_{m}_max"].iloc[0] - high) <= 0.05 * max(high, 0.01)


def test_toxicity_of_rare_words_and_repeats(spark):
    rows = [(i, say(12) + (" vile scum" if i < 3 else "")) for i in range(400)] + [(500, "vile scum"), (500, "vile scum"), (501, "word " * 30000)]
    labels = [(i, int(i < 3)) for i in range(400)] + [(7, 0), (7, 1)]
    df = spark.createDataFrame([(*r, 9.0, 1) for r in rows], "doc_id long, text string, score double, key int")
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["key"] == 1 for r in got)
    assert score[500] > 2 * max(score[i] for i in range(8, 400))


def test_token_file_of_repeated_and_null_ids(spark):
    rows = [(None if i % 3 else i // 6, say(R.randrange(0, 20)), 1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, ids int").repartition(5)
    path, lib = blocks.new_path(spark, "t"), Tokenizer.from_file(BYTES)
    token_file.write_token_file(df, path, BYTES, end_id=9)
    got = token_file.read_token_file(spark, path).orderBy("start").collect()
    key = lambda i, ids: (i is not None, i or 0, ids)
    assert sorted(key(r["doc_id"], list(r["ids"])) for r in got) == sorted(key(i, [*lib.encode(t, add_special_tokens=False).ids, 9]) for i, t, *_ in rows)
    ids, at = [r["doc_id"] for r in got], 0
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]


def test_near_duplicates_of_odd_rows(spark):
    base = [say(60) for _ in range(8)]
    texts = [None, "", " \n", "one", "ONE", "a b c", "A b\nc", "a b c d", "x " * 200, "x " * 100, *base, *(t.upper() for t in base), *(" ".join(t.split()[1:]) for t in base), " ".join(base)]
    rows = list(enumerate(texts)) + [(12, base[2]), (None, base[3]), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, kept string").repartition(3)
    got = near_duplicates.near_duplicates(df, shingle=4, percent=80).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    sets = [{tuple(w[p : p + 4]) for p in range(len(w) - 3)} if len(w := low(t)) >= 4 else {tuple(w)} if w else set() for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, _), a in zip(rows, sets):
            for (j, _), b in zip(rows, sets):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert len(got) == len(rows) and all(r["size"] == 1 for r in got)
    assert sorted((r["doc_id"] or -1, r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i or -1, root[i], len(s)) for (i, _), s in zip(rows, sets) if i is not None)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
