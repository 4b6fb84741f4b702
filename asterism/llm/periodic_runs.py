"""Stretches of words that repeat with a period, found by a dictionary of basic factors."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts are worked on together up to so many words; a longer one alone.
TOGETHER = 1 << 19


def runs_of(words: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(k, 3) array of start, length, period of all maximal runs of (n,) word numbers, by start, then period.

    ``text`` numbers the text of each word (not decreasing); no run crosses
    texts. A run is a stretch of ``least_words`` words and ``least_periods``
    (2 or more) smallest periods at least that no neighbour extends.

    Level k of the dictionary names the factors of 2^k words, from two names of
    the level below; a factor that occurs once in its text has no name and is in
    no longer one. Two occurrences in a window of 2^(k+1) words lie at most 2^k
    apart, so they overlap or touch and everything between has the distance as a
    period; such occurrences form arithmetic progressions. A run of smallest
    period q is read at the level with 2^(k-1) < q <= 2^k alone, so it is
    proposed once: as a primitive word occurs in its square only at the ends, the
    successor of every factor in the run lies exactly q on, and it does so
    neither before its first word nor after its last factor. The positions of
    one distance that follow each other are then the whole run.
    """
    n = len(words)
    named = np.full(n, -1, np.int64)
    at, code = np.arange(n), text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    found = []
    longest = int(np.bincount(text - text[0]).max()) if n else 0
    k, size = 0, 1
    while len(at):
        order = np.argsort(code, kind="stable")  # by name, then position
        same = code[order[1:]] == code[order[:-1]]
        first, then = at[order[:-1][same]], at[order[1:][same]]
        gap = then - first
        near = (gap <= size) & (gap > size // 2)
        by = np.argsort(first[near])
        p, d = first[near][by], gap[near][by]
        if len(p):
            heads = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(d) != 0)])
            tails = np.r_[heads[1:] - 1, len(p) - 1]
            length = p[tails] - p[heads] + d[heads] + size
            long = length >= np.maximum(least_words, least_periods * d[heads])
            found.append(np.column_stack([p[heads], length, d[heads]])[long])
        if least_periods * (size + 1) > longest:
            break
        # names of this level, and the places where a pair of them makes a factor of the next
        ranks = np.empty(len(at), np.int64)
        ranks[order] = np.cumsum(np.r_[0, ~same])
        often = np.bincount(ranks)[ranks] > 1
        named[at] = -1
        at, ranks = at[often], ranks[often]
        named[at] = ranks
        right = at + size
        inside = right < n
        inside[inside] = (text[right[inside]] == text[at[inside]]) & (named[right[inside]] >= 0)
        code = ranks[inside] * (int(ranks.max(initial=0)) + 1) + named[right[inside]]
        held, at = at, at[inside]
        gone = np.ones(len(held), bool)
        gone[inside] = False
        named[held[gone]] = -1
        k, size = k + 1, 2 * size
    if not found:
        return np.zeros((0, 3), np.int64)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words, those that stay when every run keeps its first period alone (a mask)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; of equal ones that of least start, then period."""
    best = None
    for s, length, q in runs:  # by start, then period
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


Words = Callable[[int | None, list[bytes]], list[bytes]]


def _together(ids: list, texts: Iterator[list[bytes]], change: Words | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts that are worked on together."""
    some, words, n = [], [], 0
    for i, w in zip(ids, texts, strict=True):
        w = change(i, w) if change else w
        if some and n + len(w) > TOGETHER:
            yield some, words
            some, words, n = [], [], 0
        some.append(i)
        words.append(w)
        n += len(w)
    if some:
        yield some, words


def runs_of_texts(words: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """The runs of each of several texts, found together; starts count from the text's first word."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    number: dict = defaultdict(count().__next__)
    codes = np.fromiter((number[x] for w in words for x in w), np.int64, int(starts[-1]))
    text = np.repeat(np.arange(len(words)), sizes)
    runs = runs_of(codes, text, least_words, least_periods)
    cuts = np.searchsorted(runs[:, 0], starts)
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], starts[:-1], strict=True)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period, in words) and ``collapsed``: the words left when each run keeps its first period, joined by one space.

    One pass without a shuffle; rows may repeat. Null texts have no words: no
    runs and an empty text. Older columns of these names are replaced.
    """
    docs = docs.drop("runs", "collapsed")
    kind = "array<struct<start:long,length:long,period:long>>"
    schema = docs.select("*", F.lit(None).cast(kind).alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs, left = batch.schema.names.index(text_col), [], []
            texts = ((t.as_py() or "").encode().split() for t in batch.column(at))
            for _, words in _together([None] * batch.num_rows, texts, None):
                for w, r in zip(words, runs_of_texts(words, least_words, least_periods), strict=True):
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in r.tolist()])
                    left.append(b" ".join(w[i] for i in np.flatnonzero(kept_words(len(w), r))).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, arrow), pa.array(left, pa.string())], [*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by checksum of its id, repeats a period from some word on; rows without id stay as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * -(-(n - a) // p))[: n - a]


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, change: Words | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGESTS of each row's runs; ``change`` alters the words first (id, words)."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in DIGESTS.split(", ")]

    def digest(i: int | None, w: list[bytes], r: np.ndarray) -> tuple:
        runs = r.tolist()
        top = strongest(runs)
        best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        left = w if not runs else [w[j] for j in np.flatnonzero(kept_words(len(w), r))]
        return (i, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode().split() for t in batch.column(1))
            rows = [digest(i, w, r) for ids, words in _together(batch.column(0).to_pylist(), texts, change) for i, w, r in zip(ids, words, runs_of_texts(words), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, DIGESTS)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which are made periodic first."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
