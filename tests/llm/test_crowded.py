import random

from providerfx.llm import near_duplicates


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}


def brute_force(texts, percent=80, k=5):
    """Smallest reachable index of each text."""
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def edited(words, places, mark):
    out = list(words)
    for p in places:
        out[p] = f"{mark}w{p}"
    return out


def crowded(seed, star=400, sparse=100):
    """An original with copies that link to it only, and pairs of copies that link to each other only."""
    r = random.Random(seed)
    one, two = ([f"{m}{r.randrange(10**6)}" for _ in range(404)] for m in "xy")
    texts = [one, *(edited(one, r.sample(range(4, 400), 7), f"a{i}") for i in range(star))]
    for i in range(sparse):
        at = r.sample(range(4, 400), 10)
        both = edited(two, at[:2], f"b{i}")
        texts += [edited(both, at[2:6], f"c{i}"), edited(both, at[6:], f"d{i}")]
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_crowded_groups(spark):
    texts = crowded(3)
    want = brute_force(texts)
    assert max(want.count(x) for x in set(want)) > 300 and len(set(want)) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, shingle=5, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == want
