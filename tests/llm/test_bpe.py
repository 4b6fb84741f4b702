import hashlib
import random

import numpy as np
import pytest
from asterism.llm.bpe import BytePairCoder, decode_ids, default_vocabulary, encode_texts, op6_bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def code():
    return BytePairCoder(default_vocabulary())


ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endof", "  two  spaces \n\n\t\x0b", "it's I'LL we've", "1234 ½ ² ٣", "日本語テキスト 한국어 ไทย", "ᲀ₏՘꟎", "é ​　x", "🙂👩‍👩‍👧", "\x00\x1f\x7f\x85\xa0", "a" * 3000, "ab" * 2000 + "!" * 999]


def test_same_ids_and_text_as_the_library(code, library):
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(32, 256), 0x301, 0x558, 0x3B1, 0x416, 0x5D0, 0x661, 0x20AC, 0x3042, 0x1F600, 10, 9)]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert code.encode(t) == want, t
        assert code.decode(want) == library.decode(want, skip_special_tokens=False)
    few = [want[1:-1] for want in map(code.encode, texts[-300:])]  # cut characters
    for ids in few:
        assert code.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_in_no_token(code):
    word = "zqxj§\x00Ωwordß".encode()
    parts = code.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert [i for p in parts for i in code.merged(p)] == code.merged(word)


def test_frames_keep_rows_and_columns(spark, code):
    df = spark.createDataFrame([(1, "one two", "x"), (None, None, None), (1, "one two", "x"), (2, "", "y")], "doc_id long, text string, token_ids string")
    out = decode_ids(encode_texts(df, default_vocabulary()), default_vocabulary()).collect()
    assert sorted((r["text"] or "", r["decoded"]) for r in out) == [("", ""), ("", ""), ("one two", "one two"), ("one two", "one two")]
    assert encode_texts(df.limit(0), default_vocabulary()).count() == 0


def test_query_against_the_library(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op6_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
