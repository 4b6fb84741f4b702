import random

import numpy as np
from asterism.llm import near_duplicates as nd
from asterism.llm.passages import words_of


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts, ids, similarity=0.8):
    """The least id that each id reaches over pairs of texts with so similar sets of shingles, by all pairs."""
    sets, least = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        met = {j for g in s for j in holders.get(g, ())}
        for j in met:
            if len(s & sets[j]) >= similarity * len(s | sets[j]):
                least[find(i)] = find(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    best = {}
    for i in range(len(texts)):
        best[find(i)] = min(ids[i], best.get(find(i), ids[i]))
    return {ids[i]: best[find(i)] for i in range(len(texts))}


def test_sketches():
    texts = [f"a b c d e f g{i}" for i in range(3)] + ["x y", "", "X  y", "q " * 70_000]
    runs, starts = nd.shingles([words_of(t) for t in texts])
    parts = np.split(runs, starts[1:])
    assert [len(p) for p in parts] == [3, 3, 3, 1, 1, 1, 69_996] and len(set(parts[6].tolist())) == 1
    assert (parts[0][:2] == parts[1][:2]).all() and parts[0][2] != parts[1][2] and parts[3] == parts[5] != parts[4]
    fps = nd.prints(runs, starts)
    for p, fp in zip(parts, fps.tolist(), strict=True):
        bits = [sum(int(x) >> b & 1 for x in p[:50].tolist()) for b in range(64)]
        assert fp == sum(1 << b for b in range(64) if 2 * bits[b] > min(len(p), 50))


def test_near_copies_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        for k in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(k * len(base) // 90):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(120)]
    texts += [" ".join([*hot[:i], word(), *hot[i + 1 :]]) for i in range(120)]
    ids = list(range(len(texts)))
    rng.shuffle(texts)
    want = sorted(set(brute(texts, ids).values()))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for tile in (8, 256):
        got = sorted(r["doc_id"] for r in nd.keep_one(df, tile=tile).collect())
        assert set(want) <= set(got) and len(got) <= len(want) + 1  # a pair at the least similarity may be missed
    assert len(want) < len(texts) - 100


def test_every_row_is_accounted_for(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = text(50), text(60), text(70)
    rows = [(5, a, "x"), (5, b, "x"), (5, a, "x"), (3, b.upper(), "y"), (None, c, "z"), (None, c, "z"), (7, None, "q"), (6, "", "q"), (9, "  \n", "q"), (None, a, "x"), (8, "k " * 60_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(((r["doc_id"], r["text"]) for r in nd.keep_one(df).collect()), key=str)
    assert got == sorted([(5, a), (3, b.upper()), (None, c), (6, ""), (8, "k " * 60_000)], key=str)
    assert nd.keep_one(df.limit(0)).count() == 0


def test_prints_meet_by_bands_of_their_bits(spark):
    rng = np.random.default_rng(3)
    sets = []
    for n in rng.integers(4, 200, 600).tolist():
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        near = np.append(base[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))
        sets += [base, near if len(sets) % 3 else rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    found = nd.wide_prints(*nd.shingle_sets(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])))
    apart = np.bitwise_count(found[:, None] ^ found[None]).sum(axis=2)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    near = [i for i in range(0, len(sets), 2) if alike(i, i + 1)]
    assert len(near) > 300 and all(apart[i, i + 1] <= nd.radius_at(0.8) for i in near)
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(found.view(np.int64).tolist())], "h long, f0 long, f1 long, f2 long")
    for bucket in (1 << 12, 8, 300):
        met = {(min(r), max(r)) for r in map(tuple, nd.near_prints(df, bucket=bucket).collect())}
        assert all(apart[i, j] <= nd.radius_at(0.8) for i, j in met)
        assert sum((i, i + 1) in met for i in near) >= 0.99 * len(near)
    assert len(nd.bands_for(1200, 0.8, 8)) > 20 and nd.bands_for(1200, 0.8, 1 << 12).shape == (1, 0)


def test_words_repeated_at_length_do_not_part_equal_sets(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(1, " ".join([*base, *["q"] * 2000])), (2, " ".join([*base, *["q"] * 8])), (3, " ".join(["q"] * 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nd.keep_one(df).collect()) == [1, 3]
