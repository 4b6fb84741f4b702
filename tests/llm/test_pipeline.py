from collections import Counter, defaultdict

import corpus_pipeline as cp
from asterism.llm import pseudonyms, toxicity
from asterism.llm.bpe import coder, default_vocabulary
from test_mixing import targets
from test_near_duplicates import brute


def test_each_stage_against_brute_force(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = cp.materialise(source)
    outs = []
    for name, stage in cp.STAGES:
        new = cp.materialise(stage(spark, docs, sf_dir))
        if name != "tokens":
            assert new.dtypes == source.dtypes
        outs.append((docs.collect(), new.collect()))
        docs = new
    (a, b), (c, d), (e, f), (g, h), (i, j) = outs

    model = toxicity.fit_toxicity(source.filter(~toxicity.held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score_toxicity(source, model).filter("toxicity >= 0.5").collect()}
    assert bad and {r["doc_id"] for r in b} == {r["doc_id"] for r in a} - bad

    ids = [r["doc_id"] for r in c]
    comp = brute([r["text"] for r in c], ids)
    assert sorted(r["doc_id"] for r in d) == sorted(set(comp.values())) and len(d) < len(c)

    key = pseudonyms.hashlib.sha256(pseudonyms.QUERY_KEY.encode()).digest()
    assert {r["doc_id"]: r["text"] for r in f} == {r["doc_id"]: pseudonyms.replaced(r["text"], key)[0] for r in e}
    assert all(r["n_chars"] == len(r["text"]) for r in f)

    copies = Counter(r["doc_id"] for r in h)
    assert max(copies.values()) <= 3 and {r["doc_id"] for r in h} <= {r["doc_id"] for r in g}
    size, taken = defaultdict(int), defaultdict(int)
    for r in g:
        n = len(r["text"].encode().split())
        size[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
    order = sorted(size)
    want = targets([size[s] for s in order], [1 + k % 3 for k in range(len(order))])
    assert all(abs(taken[s] - w) < 0.2 * w for s, w in zip(order, want, strict=True))

    code = coder(default_vocabulary())
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in j) == Counter((r["doc_id"], tuple(code.encode(r["text"]))) for r in i)
    assert all(r["exact"] and r["n_tokens"] == len(r["token_ids"]) for r in j)


def test_odd_rows_pass_all_stages(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "some text here", "en", "s", 3), (None, "some text here", "en", "s", 3), (2, "", "en", None, 0), (3, "word " * 50_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in cp.STAGES:
            now = cp.materialise(stage(spark, now, sf_dir))
        assert (now.count() > 0) == (start is docs)


def test_a_run_leaves_its_result_alone(spark, sf_dir):
    import os

    from asterism.shared import shared_dir

    held = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("asterism-")}
    before = held()
    got = cp.run(spark, sf_dir)
    assert got.count() > 0 and len(held() - before) == 1
