import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from providerfx.llm import byte_spans, decontamination, huffman, near_duplicates, packing, quality, substrings, suffix_array, token_counts, token_file, tokens, toxicity, url_filters
from providerfx.llm.blocks import new_path
from providerfx.llm.graphs import components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(5)
VOCAB = [a + b for a in ("ka", "lo", "mé", "ti", "su", "ñe") for b in ("ra", "no", "ß", "ple", "x")]
say = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))
LONG, PASSAGE = say(3000), say(60)
TEXTS = [None, "", "  \n\t", "one", "a b c", "a b c", LONG, LONG + " end", say(50) + " " + PASSAGE + "\n" + say(40), PASSAGE + " " + say(30), "x " * 200, say(90), "tab\tand nbsp  <|endoftext|> don't", "ſ́ É  x\n\n", say(120).replace(" ", "\n")]
ROWS = [(i if i != 11 else None, t, f"extra{i}", 1.0) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, n_words string, kept double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + [ROWS[9]], SCHEMA).repartition(3)


def empty(docs):
    return docs.limit(0)


def by_extra(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counts_and_file(spark, docs):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(docs, BYTES, limit=100)
    assert got.count() == len(ROWS) + 1 and "n_words" in got.columns
    for r in got.collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty(docs), BYTES).count() == 0
    lib, path = Tokenizer.from_file(WORDS), new_path(spark, "t")
    token_file.write_token_file(docs, path, WORDS, end_id=2)
    rows = token_file.read_token_file(spark, path, digest=True).orderBy("start").collect()
    at, want = 0, {}
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(ROWS) + 1
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, *want[r["doc_id"]])
        at += r["n_tokens"]
    token_file.write_token_file(empty(docs), path + "e", WORDS)
    assert token_file.read_token_file(spark, path + "e").count() == 0


def test_huffman_round_trip():
    ids = np.minimum(np.random.default_rng(1).geometric(0.01, 20_000), 5000).astype(np.int64)
    for limit in (13, 20):
        lens = huffman.code_lengths(np.bincount(ids), limit)
        codes = huffman.canonical(lens)
        assert lens.max() <= limit and sum(2.0 ** -lens[lens > 0].astype(float)) <= 1
        payload, marks = huffman.pack(ids, codes, lens)
        assert (huffman.unpack(payload, marks, len(ids), huffman.decode_table(lens, codes)) == ids).all()


def test_packing(docs):
    got = packing.pack_documents(docs, BYTES, size=512).toPandas()
    lib = Tokenizer.from_file(BYTES)
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in [*ROWS, ROWS[9]])
    assert got["length"].sum() == total and got["length"].max() <= 512
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"] == g["offset"]).all() and g["length"].sum() <= 512
    assert got["sequence_id"].nunique() <= total // 512 + 3
    assert packing.pack_documents(empty(docs), BYTES).count() == 0


def test_substrings(docs):
    rows = [*ROWS, ROWS[9]]
    words = [(t or "").split() for _, t, *_ in rows]
    words = [[w.decode() for w in (t or "").encode().split()] for _, t, *_ in rows]
    seen = {}
    for k, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((k, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        for k, p in places if len(places) > 1 else ():
            gone[k].update(range(p, p + 35))
    want = sorted((str(r[2]), len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for r, w, g in zip(rows, words, gone))
    named = docs.withColumnRenamed("n_words", "e")
    got = substrings.dedup_substrings(named, digest=True)
    assert sorted((r["e"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want
    assert substrings.dedup_substrings(empty(docs)).count() == 0


def test_byte_spans(docs):
    got = {r["doc_id"]: r for r in byte_spans.dedup_bytes(docs, digest=True).collect()}
    seen = set()
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        own, gone = [b[p : p + 50] for p in range(len(b) - 49)], np.zeros(len(b), bool)
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + 50] = True
        seen.update(own)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())
    assert byte_spans.dedup_bytes(empty(docs)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, a in ((1, 1), (7, 1), (40, 2), (300, 3), (500, 250)):
        s = rng.integers(0, a, n).astype(np.uint8)
        assert suffix_array.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s.tobytes()[i:])


def test_near_duplicates(spark, docs):
    got = near_duplicates.near_duplicates(docs.drop("kept", "n_words"), columns=["doc_id"]).collect()
    root = {r["doc_id"]: r["component_id"] for r in got}
    assert root[4] == root[5] == 4 and root[6] == root[7] == 6 and root[None] is None and root[0] == 0 and root[1] == 1 and len(got) == len(ROWS) + 1
    assert near_duplicates.near_duplicates(empty(docs)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


UPPER = " ".join(PASSAGE.split()[:20]).translate({ord(c): c.upper() for c in "abcdefghijklmnopqrstuvwxyz"})


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, UPPER), (2, "One"), (3, None), (None, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: r["found"] for r in decontamination.matches(docs, items).collect()}
    assert got[9]["hits"][0]["end"] == 20 and got[9]["items"] == ["1"] and got[3]["items"] == ["2"] and not got[4]["hits"] and got[0]["n_words"] == 0
    left = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items).collect()}
    assert 3 not in left and left[9] == " ".join(PASSAGE.split()[20:]) + TEXTS[9][len(PASSAGE) :] and left[0] is None and left[6] == LONG
    assert decontamination.matches(empty(docs), items).count() == 0 and decontamination.decontaminate(docs, items.limit(0)).count() == len(ROWS) + 1


def test_quality(docs):
    named = docs.drop("n_words").withColumnsRenamed({"kept": "lang"}).selectExpr("*", "cast(null as string) source")
    got = {r["doc_id"]: r for r in quality.quality_rules(named).collect()}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        w = b.split()
        lines = [x for x in b.split(b"\n") if x.split()]
        win = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        cover = {q for p, x in enumerate(win) if win.count(x) > 1 for q in range(p, p + 8)} if len(w) < 500 else None
        assert (got[i]["n_words"], got[i]["n_dup_lines"], got[i]["word_chars"]) == (len(w), len(lines) - len(set(lines)), sum(len(x.decode()) for x in w))
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        if cover is not None:
            assert got[i]["n_repeat_words"] == len(cover) and got[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert quality.quality_rules(named.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, say(40) + (" vile scum" if i % 4 == 0 else "")) for i in range(200)] + [(None, None), (900, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(150, 200)) and all(0 <= s <= 1 for s in got.values())
    assert toxicity.toxicity(df.limit(0), labels).count() == 0 and toxicity.toxicity(df, labels.limit(0)).count() == len(rows)


def test_url_filters(spark):
    pages = spark.createDataFrame([("http://A.b.com/x", "2024-01-05"), ("https://u@a.b.com:1/", "2024-02-01"), (None, "2024-01-05"), ("nohost", "2024-01-05"), ("http://b.com", None), ("http://b.com", "2024-01-05")], "url string, d string").selectExpr("url", "cast(d as date) day", "1 blocked")
    entries = spark.createDataFrame([("a.b.com", "add", "2024-01-01"), ("a.b.com", "remove", "2024-01-10"), ("b.com", "add", "2024-01-03"), ("b.com", "add", "2024-01-03"), (None, "add", "2024-01-01")], "entry string, action string, d string").selectExpr("entry", "action", "cast(d as date) day")
    got = [(r["host"], r["n_active"], r["blocked"], r["entry"]) for r in url_filters.filter_urls(pages, entries).collect()]
    assert sorted(got, key=repr) == sorted([("a.b.com", 2, True, "a.b.com"), ("a.b.com", 1, True, "b.com"), (None, 0, False, None), (None, 0, False, None), ("b.com", 0, False, None), ("b.com", 1, True, "b.com")], key=repr)
    assert url_filters.filter_urls(pages, entries.limit(0)).filter("blocked").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joined_pieces(name):
    """Ids of odd texts, as the library gives them for each text alone."""
    rng = random.Random(5)
    marks = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "​", "́", "ͅ", "a", "B", "é", "中", "1", "23", "!", "'s", "<|endoftext|>", "</s>", "ﬁ", "İ", "\U0001f600"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "\n", "word " * 5000]
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    ids, offs = tokens.encoder(public_tokenizers.path(name)).encode(pa.array([*texts, None], pa.string()))
    got = [ids[a:z].tolist() for a, z in zip(offs, offs[1:])]
    assert got == [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)] + [[]]
