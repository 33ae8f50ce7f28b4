"""Stages of the pipeline one by one, each on its own input and held against brute force."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
import public_tokenizers

R = random.Random(3)
NAMES = [name for name, _ in P.STAGES]


def say(n, tag="w"):
    return " ".join(f"{tag}{R.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's documents before and after it, as rows by id."""
    sf = str(tmp_path_factory.mktemp("sf"))
    passage, item = say(70, "p"), say(14, "q")
    base = say(300, "b").split()
    near = [" ".join(f"n{i}x{j}" if j in at else w for j, w in enumerate(base)) for i, at in ((i, set(R.sample(range(5, 295), 3))) for i in range(220))]
    texts = [say(R.randrange(60, 200)) for _ in range(120)]
    texts += [say(40) + " vile scum " + say(10) for _ in range(60)]
    texts += [" ".join(base), *near, *texts[:10], *(t.upper() for t in texts[10:14])]
    texts += [say(30) + " " + passage + " " + say(30) for _ in range(8)] + [passage + " " + passage]
    texts += [say(50) + ", " + item.upper().replace(" ", ", ") + ". " + say(20) for _ in range(6)] + [item, " ".join(item.split()[:11]) + " and", None, "", " \n ", say(9000)]
    rows = [(i, t, "en", "web", len(t or "") if i % 9 else None, "x") for i, t in enumerate(texts)] + [(None, say(80), None, None, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(4).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int("vile scum" in (t or ""))) for i, t in enumerate(texts) if i % 2 or "vile" in (t or "")] + [(10**6, 1), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs.collect()
        path = f"{sf}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before, docs.collect()
    return sf, out


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_toxicity_stage(stages):
    before, after = stages[1]["toxicity"]
    left = by_id(after)
    assert set(after[0].asDict()) == set(P.COLUMNS)
    assert set(by_id(before)) - set(left) == {i for i, t in by_id(before).items() if "vile scum" in (t or "")}
    assert all(left[i] == by_id(before)[i] for i in left)


def test_near_duplicates_stage(stages):
    before, after = (by_id(x) for x in stages[1]["near-duplicates"])
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    shingles = lambda w: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = {i: shingles(low(t)) for i, t in before.items() if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert set(after) == {i for i in root if top(i) == i} | {None}
    assert sum(top(i) != i for i in root) > 200


def test_substrings_stage(stages):
    before, after = (by_id(x) for x in stages[1]["substrings"])
    words, seen = {i: (t or "").split() for i, t in before.items()}, {}
    for i, w in words.items():
        for p in range(len(w) - P.PASSAGE + 1):
            seen.setdefault(tuple(w[p : p + P.PASSAGE]), []).append((i, p))
    gone = {}
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            gone.setdefault(i, set()).update(range(p, p + P.PASSAGE))
    assert len(gone) == 9
    for i, t in before.items():
        kept = [x for k, x in enumerate(words[i]) if k not in gone.get(i, ())]
        if i in gone and not kept:
            assert i not in after
        else:
            assert after[i] == (" ".join(kept) if i in gone else t)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in stages[1]["substrings"][1])


def test_decontamination_stage(stages):
    before, after = (by_id(x) for x in stages[1]["decontamination"])
    hit = {i for i in before if (before[i] or "").lower().replace(",", "").replace(".", "").count("q") >= 10}
    whole = {i for i in hit if len(before[i].split()) < 20}
    assert len(hit) == 8 - item_lost(before) and set(before) - set(after) == whole
    for i, t in before.items():
        if i not in hit:
            assert after[i] == t
        elif i not in whole:
            assert "q" not in after[i].lower() and re.findall(r"w\d+", after[i]) == re.findall(r"w\d+", t)


def item_lost(before):
    """Of the two short contaminated documents, those that went earlier as copies."""
    return 2 - sum(1 for t in before.values() if t and len(t.split()) < 20 and "q" in t)


def test_packing_stage(stages):
    before, after = stages[1]["packing"]
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in before:
        want[r["doc_id"]] = len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    total = {}
    for r in after:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == want
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(want.values()) / 2048 * 1.02 + 2


def test_run_is_its_stages(spark, stages):
    sf, out = stages
    got = P.run(spark, sf).collect()
    key = lambda rows: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(got) == key(out["packing"][1]) and NAMES == ["toxicity", "near-duplicates", "substrings", "decontamination", "packing"]


def test_stages_of_an_empty_table(spark, stages):
    sf, _ = stages
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
