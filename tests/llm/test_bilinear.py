import math
import zlib
from collections import Counter

import numpy as np
from asterism.llm import bilinear as b


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    at = np.unique(rng.integers(0, b.CLASSES**3 - 1, 500))
    at = at[at % b.CLASSES != b.START]
    model = b.train(at, rng.integers(1, 9, len(at)).astype(float), steps=20)
    assert np.allclose((10 ** model.log_probabilities()).sum(axis=2), 1, atol=1e-4)
    assert np.allclose((10 ** b.train(np.zeros(0, int), np.zeros(0)).log_probabilities()).sum(axis=2), 1, atol=1e-4)
    model.kinds, model.words, model.word_bias = rng.integers(0, 9, 300), rng.normal(size=(300, b.DIMENSIONS)).astype(np.float32), rng.normal(size=300).astype(np.float32)
    shares = 10 ** model.log_shares()
    assert all(np.allclose(shares[:, model.kinds == k].sum(axis=1), 1, atol=1e-4) for k in range(9))


def test_words_of_a_class_learn_their_company():
    """After class 3 word 0 is likely, after class 4 word 1; both are as common."""
    rng = np.random.default_rng(2)
    context, seen = rng.normal(size=(b.CLASSES, b.DIMENSIONS)).astype(np.float32), np.zeros((b.CLASSES, 4), np.float32)
    seen[3], seen[4] = (90, 10, 5, 0), (10, 90, 5, 0)
    after = seen.sum(axis=1, keepdims=True) * np.ones((1, 4), np.float32)
    share = (seen.sum(axis=0) + 0.5) / (seen.sum() + 2)
    vectors, bias = b.train_words(seen, share, after, context)
    scores = context @ vectors.T + bias
    apart = [b.train_words(seen[:, k : k + 1], share[k : k + 1], after[:, :1], context)[0][0] for k in range(4)]
    assert np.allclose(vectors, apart, atol=1e-3)
    assert scores[3, 0] > scores[3, 1] + 0.5 and scores[4, 1] > scores[4, 0] + 0.5 and scores[3, 3] < scores[3, 2]


def test_clusters_and_empty_input():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (50, 3)) for c in (0, 5, 9)])
    own = b.cluster(x, np.ones(150), 3, 1)
    assert sorted(len(set(own[i : i + 50])) for i in (0, 50, 100)) == [1, 1, 1] and len(set(own)) == 3
    assert b.cluster(x[:2], np.ones(2), 3, 1).tolist() == [0, 1] and len(set(b.cluster(np.zeros((9, 3)), np.zeros(9), 3, 1))) == 1


def test_training_learns_a_planted_grammar():
    """Class n is followed by n + 1 of ten classes, nine times in ten."""
    at, n = [], []
    for x in range(1, 11):
        for y in range(1, 11):
            for z in range(1, 11):
                at.append((x * b.CLASSES + y) * b.CLASSES + z)
                n.append(90.0 if z == y % 10 + 1 else 10 / 9)
    p = 10 ** b.train(np.array(at), np.array(n)).log_probabilities()
    assert np.mean([p[x, y, y % 10 + 1] for x in range(1, 11) for y in range(1, 11)]) > 0.8


def brute(docs, model):
    """Scores by definition, word by word."""
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 or i is None]
    c = Counter(w for t in train for w in [*b.tokens(t), "END"])
    total, distinct = sum(c.values()), len(c)
    table, shares, head = model.bilinear.log_probabilities(), model.bilinear.log_shares(), len(model.words)
    place = lambda w: model.words.get(w, head + b.ending(w))
    n_end, v_end = Counter(), Counter()
    for w, n in c.items():
        if w != "END" and w not in model.words:
            n_end[b.ending(w)] += n
            v_end[b.ending(w)] += 1
    out = []
    for i, t in docs:
        words = b.tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words, "END"])
        far, near, score = b.START, b.START, 0.0
        for w in [*words, None]:
            k = b.END if w is None else model.classes[place(w)]
            score += table[far, near, k]
            if k >= b.FIRST_KIND:
                score += shares[near, place(w)]
            if w is not None and w not in model.words:
                score += math.log10((c[w] + 0.5) / (n_end[b.ending(w)] + 0.5 * (v_end[b.ending(w)] + 1)))
            far, near = near, k
        out.append((i, len(words) + 1, sum(c[w] > 0 for w in [*words, "END"]), total, base, score))
    return out


def test_query_by_definition_and_better_than_single_words(spark):
    sf_dir = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    model = b.fit_language_model(frame.filter(~b.held_out()))
    got = {r["doc_id"]: r for r in b.op2_language_model(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, n, known, total, base, score in brute(docs, model):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-4)
    new = [r for r in got.values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in new) / sum(r["n_tokens"] for r in new)
    assert gain > 0.35, gain


def test_odd_rows_and_small_heads(spark):
    rows = [(1, "A b É", "x"), (1, "A b É", "x"), (2, None, None), (3, "", "y"), (None, "a b b c", "z"), (4, "w " * 50_000 + "rare", "z"), (5, "\x0b a\x0c\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for head in (0, 2, 100):
        model = b.fit_language_model(df, head_words=head)
        assert len(model.words) <= head
        got = b.score_texts(df, model).collect()
        assert len(got) == len(rows)
        assert all(math.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in got)
    empty = b.score_texts(df, b.fit_language_model(df.limit(0))).collect()
    assert len(empty) == len(rows) and all(r["n_known"] == 0 for r in empty)
