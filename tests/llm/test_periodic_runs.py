import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from asterism.llm.periodic_runs import kept_words, op12_periodic_runs, periodic_runs, run_digests, runs_of, runs_of_texts


def plain_runs(w, least_words=24, least_periods=3):
    """All maximal runs by comparing words at every distance."""
    out = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, length = i, j - i + q
            if length >= max(least_words, least_periods * q) and not any(all(w[x] == w[x + p] for x in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_every_run_of_random_words_is_found(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(6):
        kinds, parts = int(rng.integers(1, 4)), []
        for _ in range(int(rng.integers(1, 5))):
            unit = rng.integers(0, kinds, int(rng.integers(1, 14))).tolist()
            parts += unit * int(rng.integers(1, 9)) + rng.integers(0, kinds + 1, int(rng.integers(0, 5))).tolist()
        texts.append([str(x).encode() for x in parts])
    least = int(rng.choice([4, 24]))
    found = runs_of_texts(texts, least)
    for w, r in zip(texts, found, strict=True):
        assert [tuple(x) for x in r.tolist()] == plain_runs(w, least)
        drop = {i for s, length, q in plain_runs(w, least) for i in range(s + q, s + length)}
        assert np.flatnonzero(kept_words(len(w), r)).tolist() == [i for i in range(len(w)) if i not in drop]


def test_no_words_and_one_word_for_ever():
    assert len(runs_of(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    assert [len(r) for r in runs_of_texts([[], [b"a"] * 24, [], [b"a"] * 23])] == [0, 1, 0, 0]


def test_runs_do_not_cross_texts():
    assert [r.tolist() for r in runs_of_texts([[b"a", b"b"] * 12, [b"a", b"b"] * 12])] == [[[0, 24, 2]], [[0, 24, 2]]]


def test_a_long_period():
    w = [str(i).encode() for i in range(40_000)]
    assert runs_of_texts([w * 3 + [b"x"]])[0].tolist() == [[0, 120_000, 40_000]]


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)))


def test_query_equals_plain_comparison(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) < 1500]
    assert len(short) > 0.9 * len(rows)
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert {r["doc_id"]: got[r["doc_id"]] for r in short} == {r["doc_id"]: plain_digest(r["doc_id"], r["text"]) for r in short}
    assert sum(1 for r in got.values() if r[1]) > len(rows) / 20


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None), (2, ""), (3, "\t \n"), (None, "a " * 30), (4, "a b " * 12 + "x " + "c d " * 12), (4, "a b " * 12 + "x " + "c d " * 12), (5, "a\u00a0b " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_runs", "'z' AS collapsed")
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"], r["n_runs"]) for r in periodic_runs(docs).collect()]
    same = (4, [(0, 24, 2), (25, 24, 2)], "a b x c d", 2)
    assert found == [(1, [], "", 2), (2, [], "", 2), (3, [], "", 2), (None, [(0, 30, 1)], "a", 2), same, same, (5, [(0, 24, 1)], "a\u00a0b", 2)]
    got = {r["doc_id"]: r for r in run_digests(docs).collect()}
    assert (got[4]["start"], got[4]["length"], got[4]["period"], got[4]["exponent_milli"]) == (0, 24, 2, 12000)
    assert got[1]["start"] is None and got[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs(docs.limit(0)).count() == 0 and run_digests(docs.limit(0)).count() == 0
