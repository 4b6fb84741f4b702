import itertools

import numpy as np
import pytest
from asterism.llm import noisy_channel as nc
from asterism.llm import toxicity as t


@pytest.fixture(scope="module")
def plain(spark):
    words = "the stupid idiot is a moron and a clown with trash on the lost road near the idiotic stupidity of morons".split()
    return nc.character_model(spark.createDataFrame([(" ".join(words),), (None,), ("",)] * 5, "text string")).tolist()


def test_model_is_normalised(plain):
    assert np.allclose(np.exp(np.array(plain)).sum(axis=2), 1)


@pytest.mark.parametrize("token", ["1d10t", "id!ot", "i.d.i.o.t", "idiooot", "i-d-i-o-t", "!d1ot", "iid10tt", "idiiot", "1d107"])
def test_disguises_are_seen_through(plain, token):
    assert "idiot" in nc.words_of(token, plain)


def test_spaced_letters_and_plain_words(plain):
    assert nc.spaced_words("you s t u p i d  m o r o n !", plain)
    assert nc.spaced_words("an i d i o t here", plain) == ["idiot"]
    assert nc.spaced_words("an i d\ni\n o t here", plain) == ["idiot"]
    assert nc.words_of("clown,", plain) == ("clown",)
    assert nc.words_of("th%%%", plain) == ("th",)
    assert nc.words_of("2024", plain) == ()


@pytest.mark.parametrize("token", ["1d10t", "m0r.on", "st!!pid", "aa1b"])
def test_decoding_against_all_paths(plain, token):
    best = (-1e9, "")
    for path in itertools.product(*(nc._choices(token, i) for i in range(len(token)))):
        word, score, a, b = "".join(x for x, _ in path), sum(c for _, c in path), 0, 0
        for k in [*(ord(x) - 96 for x in word), 0]:
            score += plain[a][b][k]
            a, b = b, k
        best = max(best, (score, word))
    assert nc.decode(token, plain) == best[1]


def test_learns_and_finds_disguised_words(spark):
    rng = np.random.default_rng(0)
    clean = "the and of with road near stone water light over under long green".split()
    bad = ["idiot", "moron"]
    rows = []
    for i in range(400):
        words = list(rng.choice(clean, 30))
        if i % 4 == 0:
            words[5] = bad[i // 4 % 2]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = t.fit_toxicity(docs, labels)
    new = [(1, "what an 1d10t over there"), (2, "m o r o n near water"), (3, "the road"), (4, None), (5, ""), (5, ""), (6, "water " * 40_000 + "moooron")]
    df = spark.createDataFrame([(*r, "x") for r in new], "doc_id long, text string, toxicity string")
    got = t.score_toxicity(df, model).collect()
    assert len(got) == len(new) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["doc_id"]) if r["toxicity"] >= 0.5] == [1, 2, 6]
    assert t.score_toxicity(df.limit(0), model).count() == 0
    assert t.fit_toxicity(docs, labels.limit(0)).weights == {}
    assert t.fit_toxicity(docs.limit(0), labels).bias == -30


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in t.op10_toxicity(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    assert right / len(labels) > 0.98


def test_an_id_of_many_rows_is_bounded(spark):
    from asterism.llm.labels import labelled_rows

    docs = spark.range(900).selectExpr("id % 3 id", "concat('t', id % 300) text")
    chosen = spark.createDataFrame([(0, 1), (1, 0)], "id long, label int")
    got = labelled_rows(docs, chosen, 40).collect()
    assert len(got) == len({(r["id"], r["text"]) for r in got}) == 40
    assert labelled_rows(docs, chosen, 4000).count() == 200
