import random

import numpy as np
import xxhash
from asterism.llm.simhash import fingerprint, near_links, simhash_components
from asterism.llm.components import connected_components


def brute(fps, ids, radius=3):
    n = len(fps)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return {ids[i]: least[find(i)] for i in range(n)}


def test_fingerprint_by_definition():
    text = "Aa bB cc\tdd\x0bee aa bb cc É"
    words = ["aa", "bb", "cc", "dd", "ee", "aa", "bb", "cc", "É"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(7)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 7)
    assert fingerprint(text) == want
    assert fingerprint("Ab c") == xxhash.xxh64_intdigest(b"ab c", 42)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_links_against_brute_force_in_small_tiles(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    for k in range(300):  # one band value that holds most rows
        fps.add((rng.getrandbits(48) << 16) | 7)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute(fps, signed)
    for tile in (16, 4096):
        got = {r["node"]: r["root"] for r in connected_components(near_links(df, 3, tile)).collect()}
        assert {k: got.get(k, k) for k in signed} == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_rows_and_odd_inputs(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text, 1), (9, text.upper(), 2), (7, text + " more", 1), (1, None, 0), (2, "", 0), (2, "", 0), (8, "alone here", 3), (None, "x " * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [(r["doc"], r["component"]) for r in simhash_components(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3), (7, 3), (1, 1), (2, 1), (2, 1), (8, 8), (None, None)], key=str)
    assert simhash_components(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    from asterism.llm.simhash import op8_simhash

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = list(docs)
    fps = [fingerprint(docs[i]) for i in ids]
    want = brute(fps, ids)
    got = op8_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps)}
    assert len(got) == len(ids)
