"""Toxicity scores of text restored by the noisy-channel decoder."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .labels import labelled_rows
from .noisy_channel import character_model, spaced_words, words_of

#: The classifier is fitted on so many labelled rows at most, those of least hash.
SAMPLE_ROWS = 8_000
MAX_FEATURES = 512
PREFIXES = range(3, 8)
LEAST_ROWS = 3
CACHE_TOKENS = 200_000


def features_of(word: str) -> list[str]:
    """The whole word (with an end sign) and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class ToxicityModel:
    """A logistic regression over features of restored words."""

    characters: list
    weights: dict[str, float]
    bias: float


class _Features:
    """Features of whole texts, those in ``known`` alone if given, with a bounded memory of tokens."""

    def __init__(self, characters: list, known: dict[str, float] | None = None):
        self.characters, self.known, self.tokens = characters, known, {}

    def token(self, token: str) -> tuple[str, ...]:
        found = tuple(f for w in words_of(token, self.characters) for f in features_of(w) if self.known is None or f in self.known)
        if len(token) <= 64:
            if len(self.tokens) >= CACHE_TOKENS:
                self.tokens.clear()
            self.tokens[token] = found
        return found

    def text(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        out: set[str] = set()
        get = self.tokens.get
        tokens = set(text.split())
        for t in tokens:
            found = get(t)
            if found is None:
                found = self.token(t)
            if found:
                out.update(found)
        if any(len(t) == 1 for t in tokens):
            for w in spaced_words(text, self.characters):
                out.update(f for f in features_of(w) if self.known is None or f in self.known)
        return out


def _count_features(characters: list):
    """Rows with each feature, toxic and not, by blocks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features(characters)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                counts = (Counter(), Counter())
                for text, label in zip(part.column(0), part.column(1), strict=True):
                    counts[label.as_py()].update(make.text(text.as_py()))
                names = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], ["feature", "no", "yes"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a quadratic penalty; the bias is free."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """Learn from labelled rows of ``docs``; the caller leaves out what is held out.

    The character model counts all texts. The classifier sees the labelled rows
    of least hash, up to ``sample_rows``, equal rows once: features that toxic rows have more
    often are ranked by chi-square and the best ``max_features`` enter a
    logistic regression. An id with several labels counts as toxic if one says
    so; null ids and labels are left out. Without labels of both kinds every
    text gets the share of toxic labels, or 0 if there are none.
    """
    characters = character_model(docs, text_col).tolist()
    named = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label")).dropna()
    known = docs.select(F.col(id_col).alias("id")).distinct()
    chosen = named.groupBy("id").agg(F.max("label").alias("label")).join(known, "id").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = materialise(labelled_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, sample_rows).repartition(F.xxhash64("id", "text")))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    no, yes = sizes.get(0, 0), sizes.get(1, 0)
    if not no or not yes:
        return ToxicityModel(characters, {}, 30.0 if yes else -30.0)
    counts = rows.select("text", "label").mapInArrow(_count_features(characters), "feature string, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    a, b = F.col("yes") / yes, F.col("no") / no
    share = (F.col("yes") + F.col("no")) / (yes + no)
    best = counts.filter((F.col("yes") >= LEAST_ROWS) & (a > 2 * b)).withColumn("z", (a - b) * (a - b) / (share * (1 - share) + 1e-9)).orderBy(F.desc("z"), "feature").limit(max_features)
    names = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}
    if not names:
        return ToxicityModel(characters, {}, float(np.log(yes / no)))
    given = dict.fromkeys(names, 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features(characters, given)
        for batch in batches:
            lists = [[names[f] for f in make.text(t.as_py())] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["label", "on"])

    got = rows.select("text", "label").mapInArrow(vectors, "label int, on array<int>").collect()
    x = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        x[i, r["on"]] = 1
    w, bias = _fit(x, np.array([r["label"] for r in got], float))
    return ToxicityModel(characters, {f: float(w[i]) for f, i in names.items()}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1. Null and empty texts get the score of a text without any feature; an older column is replaced."""
    known, bias, characters = model.weights, model.bias, model.characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features(characters, known)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            z = np.array([bias + sum(sorted(known[f] for f in make.text(t.as_py()))) for t in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*batch.schema.names, "toxicity"])

    docs = docs.drop("toxicity")
    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("double").alias("toxicity")).schema)


def held_out(id_col: str = "doc_id"):
    """A fifth of the ids, by checksum; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, learnt from the labels of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs.filter(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
