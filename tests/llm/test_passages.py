import random
import re

import numpy as np
from asterism.llm import passages as p
from asterism.llm.components import connected_components
from asterism.llm.similar_sets import in_buckets, similar_links


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def one(text):
    found = p.cut([p.words_of(" ".join(text))])
    return found.starts, found.ends, found.whole, found.sets()


def test_cuts_depend_on_content_alone():
    rng = random.Random(1)
    passage = words(rng, 80)
    found = []
    for _ in range(2):
        before, after = words(rng, rng.randint(0, 40)), words(rng, rng.randint(0, 40))
        starts, ends, whole = one(before + passage + after)[:3]
        assert starts[0] == 0 and list(starts[1:]) == list(ends[:-1]) and ends[-1] == len(before + passage + after)
        found.append({(a - len(before), b - len(before), h) for a, b, h in zip(starts.tolist(), ends.tolist(), whole.tolist(), strict=True) if a - len(before) >= p.REACH and b - len(before) < 75})
    same = found[0] & found[1]
    assert sum(b - a for a, b, _ in same) >= 45
    assert len(one([])[0]) == 0 and len(one(["x"])[0]) == 1
    texts = [words(rng, n) for n in (0, 1, 3, 200, 0, 70)]
    many = p.cut([p.words_of(" ".join(t)) for t in texts])
    assert list(zip(many.text.tolist(), many.number().tolist(), many.whole.tolist(), map(tuple, many.sets()), strict=True)) == [(i, k, h, tuple(s)) for i, t in enumerate(texts) for k, (h, s) in enumerate(zip(one(t)[2].tolist(), one(t)[3], strict=True))]


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, 26) for _ in range(30)]
    docs, i = [], 0
    for b in base:
        for _ in range(8):
            w = list(b)
            if rng.random() < 0.8:
                w[rng.choice([0, 1, 24, 25])] = f"x{rng.randrange(10**6)}"
            docs.append((i, " ".join(w)))
            i += 1
    df = spark.createDataFrame(docs, "doc long, text string").selectExpr("*", "0L row")
    sets = {}
    for _, t in docs:
        _, _, whole, shingles = one(t.split())
        for h, s in zip(whole.view(np.int64).tolist(), shingles, strict=True):
            sets[h] = frozenset(s.tolist())
    hs = sorted(sets)
    want = {h: h for h in hs}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    pairs = 0
    for x in hs:
        for y in hs:
            if x < y and len(sets[x]) >= p.LEAST_SHINGLES and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                want[max(find(x), find(y))] = min(find(x), find(y))
                pairs += 1
    assert pairs > 20
    for tile in (3, 256):
        got = {r["node"]: r["root"] for r in connected_components(p.near_paragraphs(df, p.distinct_paragraphs(df), tile=tile)).collect()}
        wrong = [h for h in hs if got.get(h, h) != find(h)]
        assert len(wrong) <= 0.03 * len(hs)  # MinHash finds 0.992 of the pairs at the least similarity
        assert all(find(h) == find(got[h]) for h in got)  # and what is linked is verified


def test_passages_inside_texts_are_taken_out_once(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30) + passage + words(rng, 30)), "x") for i in (4, 7, 9, None)]
    clean = [(100 + i, " ".join(words(rng, 120)), "y") for i in range(20)]
    odd = [(50, None, "z"), (51, "", "z"), (52, "a b\nc", "z"), (53, "a b\nc", "z"), (60, " ".join(passage * 3), "z"), (161, clean[0][1], "z"), (4, rows[0][1], "x"), (70, "q " * 60_000, "z")]
    df = spark.createDataFrame(rows + clean + odd, "doc_id long, text string, removed string")
    got = p.remove_passages(df).collect()
    assert len(got) == len(rows + clean + odd)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[4]["removed_words"] == 0
    middle = " ".join(passage[20:40])
    for i in (7, 9, None):
        assert by[i]["removed_words"] >= 35 and by[i]["first_doc"] == 4 and middle not in by[i]["kept_text"]
        assert sum(s["words"] for s in by[i]["removed"]) == by[i]["removed_words"]
    assert by[60]["removed_words"] > 100 and by[161]["kept_text"] == "" and by[161]["first_doc"] == 100
    for i in [*range(100, 120), 51, 52, 53, 70]:
        assert by[i]["kept_text"] == by[i]["text"] and by[i]["removed_words"] == 0 and by[i]["first_doc"] is None
    assert by[50]["kept_text"] is None
    assert p.remove_passages(df.limit(0)).count() == 0


def test_query_keeps_one_of_each(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in p.op5_passages(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    first = {}
    for i in sorted(docs):
        w = WORD.findall(docs[i].lower())
        left = set(zip(*(WORD.findall(got[i]["text"].lower())[k:] for k in range(60)), strict=False))
        for g in set(zip(*(w[k:] for k in range(60)), strict=False)):
            if g in first and len(set(g)) > 30:
                assert g not in left
            else:
                first.setdefault(g, i)
        assert got[i]["removed_words"] > 0 or got[i]["text"] == docs[i]


def test_whole_passages_with_edits_are_taken_out(spark):
    rng = random.Random(5)
    rows, inside = [], {}
    for i in range(300):
        passage = words(rng, 60 if i % 3 else 51)
        copy = list(passage)
        if i % 3 == 1:
            copy[30] = "changed"
        elif i % 3 == 2:
            copy[20:21] = ["two", "more"]
        before = words(rng, 30)
        rows += [(i, " ".join(words(rng, 25) + passage + words(rng, 25))), (1000 + i, " ".join(before + copy + words(rng, 30)))]
        inside[1000 + i] = (len(before), len(copy))
    got = {r["doc_id"]: r for r in p.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = [[], [], []]
    for i, (_, n) in inside.items():
        share[(i - 1000) % 3].append(got[i]["removed_words"] / n)
        assert got[i]["removed_words"] <= n + 6 and got[i - 1000]["removed_words"] == 0
    assert all(np.mean(s) > 0.9 and np.mean(np.array(s) > 0.95) > 0.9 for s in share), [(np.mean(s), np.mean(np.array(s) > 0.95)) for s in share]


def test_mixing_is_undone():
    x = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    assert all((p._undone(p._mixed(x.copy(), k), k) == x).all() for k in range(9))


def test_rows_of_one_id_are_cut_for_themselves(spark):
    rng = random.Random(8)
    passage, one, two = words(rng, 80), words(rng, 300), words(rng, 120)
    rows = [(1, " ".join(words(rng, 20) + passage)), (5, " ".join(one)), (5, " ".join(two + passage + two[:5])), (5, " ".join(words(rng, 40))), (5, " ".join(one)), (9, " ".join(one))]
    got = p.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows)
    for r in got:
        if r["doc_id"] == 5 and passage[9] in r["text"]:
            assert 70 <= r["removed_words"] <= 90 and two[9] in r["kept_text"] and passage[30] not in r["kept_text"]
        elif r["doc_id"] != 9:
            assert r["removed_words"] == 0 and r["kept_text"] == r["text"]
    assert [r["kept_text"] for r in got if r["doc_id"] == 9] == [""]


def test_a_popular_shingle_loses_no_pair(spark):
    rng = random.Random(9)
    sets, keys = [], []
    for i in range(160):
        own = [rng.randrange(1 << 40) for _ in range(rng.randint(4, 12))]
        sets.append((3 * i, [7, *own]))
        sets.append((3 * i + 1, [7, *own, rng.randrange(1 << 40)][: len(own) + 1 + (len(own) > 4)]))
        sets.append((3 * i + 2, [7]))
    keys = [(h, 7) for h, _ in sets]
    got = similar_links(in_buckets(spark.createDataFrame(keys, "h long, value long")), spark.createDataFrame(sets, "h long, s array<long>"), 0.8, tile=8, split=True)
    roots = {r["node"]: r["root"] for r in connected_components(got).collect()}
    held = {h: frozenset(s) for h, s in sets}
    for i in range(160):
        a, b = held[3 * i], held[3 * i + 1]
        near = len(a & b) >= 0.8 * len(a | b)
        assert (roots.get(3 * i, -1) == roots.get(3 * i + 1, -2)) == near
        assert roots[3 * i + 2] == 2


def test_bounds_of_words():
    for text in ("", " ", "a", "  é\x0b\U0001f600b c\n", "a\u00a0b\u2003c d\x1fe"):
        assert list(zip(*map(np.ndarray.tolist, p.word_bounds(text)), strict=True)) == [m.span() for m in WORD.finditer(text)]


def test_growing_keeps_the_similarity():
    base = list(range(200))
    assert p.grow(base[:10], base[10:40], base[:8], [*base[10:30], 999, *base[31:60]], 20) == (8, 30)
    holes = [x if x % 7 else -x - 1 for x in base]
    assert p.grow([], base, [], holes, 10)[1] <= 7


def test_tiles_hold_what_rows_say():
    import pyarrow as pa
    from asterism.llm.similar_sets import _tiles

    kind = pa.list_(pa.struct([("h", pa.int64()), ("s", pa.list_(pa.int64())), ("fp", pa.list_(pa.int64()))]))
    rows = [[{"h": -1, "s": [5, -7], "fp": [1, -2]}, {"h": 2, "s": [], "fp": [3, 4]}], None, [], [{"h": 9, "s": [5], "fp": [-5, 6]}]]
    for begin in (0, 1):
        got = list(_tiles(pa.array(rows, kind).slice(begin)))
        assert len(got) == 4 - begin
        for row, tile in zip(rows[begin:], got, strict=True):
            assert (tile is None) == (row is None)
            if row:
                assert tile[0] == [x["h"] for x in row] and tile[1] == [frozenset(x["s"]) for x in row] and tile[2].view(np.int64).tolist() == [x["fp"] for x in row]


def test_words_are_hashed_alike_in_any_block():
    a, b = p._hashes([b"x", b"y", b"x", b""]), p._hashes([b"y", b"x"])
    assert a[0] == a[2] == b[1] and a[1] == b[0] and len(set(a.tolist())) == 3 and len(p._hashes([])) == 0 and p._hashes([]).dtype == np.uint64
