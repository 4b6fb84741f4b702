"""A log-bilinear language model, trained by noise-contrastive estimation, that scores whole texts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialise

GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Classes: the end of a text, the commonest words one by one, KINDS clusters of all other words, and the start of a text.
OWN, KINDS = 62, 64
END, FIRST_KIND, START = 0, 1 + OWN, 1 + OWN + KINDS
CLASSES = START + 1
#: Words that the model has a vector for; all rarer words share one vector for each of so many endings.
HEAD_WORDS, ENDINGS = 1 << 15, 1 << 10
#: Numbers that describe in which company a word is found, for each side of it.
SKETCH = 32
DIMENSIONS, NOISE, STEPS, RATE = 32, 16, 200, 0.05
#: Observations that pull a word's vector to zero, steps of its training, and words that a task trains together.
RIDGE, WORD_STEPS, WORD_BLOCK = 4.0, 60, 256


def tokens(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def ending(word: bytes) -> int:
    """Bucket of a word's last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def _rough(word: bytes) -> int:
    """A first class of a word that has none of its own, to describe the company of others by."""
    return FIRST_KIND + zlib.crc32(word[-2:]) % KINDS


class _Adam:
    def __init__(self, parameters: list[np.ndarray]):
        self.p, self.m, self.v, self.t = parameters, [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters], 0

    def step(self, gradients, rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(self.p, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-10)


@dataclass
class Bilinear:
    """Predicted vector = sum over the two classes before of their vector times a matrix; score = product with a class's vector, plus its bias.

    ``words`` and ``word_bias``: the same for words within their class, from the class before alone.
    """

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray
    kinds: np.ndarray

    def log_probabilities(self) -> np.ndarray:
        """log10 of each class after each two classes, [second before, first before, class]; each row sums to one.

        The start is never predicted. One product for all contexts gives the
        scores, the sum over all classes normalises them.
        """
        context = (self.inputs @ self.far)[:, None] + (self.inputs @ self.near)[None]
        scores = context.reshape(-1, context.shape[2]) @ self.outputs.T + self.bias
        scores[:, START] = -np.inf
        top = scores.max(axis=1, keepdims=True)
        scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        return (scores / np.log(10)).reshape(CLASSES, CLASSES, CLASSES)

    def log_shares(self) -> np.ndarray:
        """log10 of each word's share of its class after each class, [before, word]; a class's words sum to one."""
        scores = (self.inputs @ self.near) @ self.words.T + self.word_bias
        if not scores.shape[1]:
            return scores
        order = np.argsort(self.kinds, kind="stable")
        kinds = self.kinds[order]
        first = np.append(0, np.nonzero(np.diff(kinds))[0] + 1)
        where = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(kinds))))
        scores = scores[:, order]
        scores -= np.maximum.reduceat(scores, first, axis=1)[:, where]
        scores -= np.log(np.add.reduceat(np.exp(scores), first, axis=1))[:, where]
        out = np.empty_like(scores)
        out[:, order] = scores / np.log(10)
        return out


def train(at: np.ndarray, counts: np.ndarray, seed: int = 7, steps: int = STEPS) -> Bilinear:
    """Fit to counts of class triples (``at`` = (far * CLASSES + near) * CLASSES + class) by noise-contrastive estimation.

    Every step passes over all triples, weighted by their counts, against NOISE
    words for each real one from the frequencies of classes, taken at their
    expected numbers; the model learns to tell them apart, its scores taken as
    normalised. Adam updates all parameters.
    """
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = [shape(CLASSES, DIMENSIONS), shape(CLASSES, DIMENSIONS), np.zeros(CLASSES, np.float32), shape(DIMENSIONS, DIMENSIONS) + np.eye(DIMENSIONS, dtype=np.float32), shape(DIMENSIONS, DIMENSIONS)]
    model = Bilinear(*p, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32), np.zeros(0, np.int64))
    if not len(at):
        return model
    rows, row = np.unique(at // CLASSES, return_inverse=True)
    seen = np.bincount(row * CLASSES + at % CLASSES, counts, len(rows) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
    share = seen.sum(axis=0) + 0.5
    share[START] = 0
    share /= share.sum()
    model.bias[:START] = np.log(share[:START])
    odds, often = NOISE * share[:START], seen.sum(axis=1, keepdims=True)
    known, total = seen[:, :START], seen.sum()
    far, near = rows // CLASSES, rows % CLASSES
    by_near = np.argsort(near, kind="stable")
    adam = _Adam(p)
    starts = lambda x: np.append(0, np.nonzero(np.diff(x))[0] + 1)
    far_at, near_at = starts(far), starts(near[by_near])
    for step in range(steps):
        context = (model.inputs @ model.far)[far] + (model.inputs @ model.near)[near]
        g = np.zeros_like(seen)
        real = 1 / (1 + odds * np.exp(-np.clip(context @ model.outputs[:START].T + model.bias[:START], -40, 40)))
        g[:, :START] = (odds * often * real - known * (1 - real)) / total
        g_context = g @ model.outputs
        g_far, g_near = np.zeros_like(model.inputs), np.zeros_like(model.inputs)
        g_far[far[far_at]] = np.add.reduceat(g_context, far_at)
        g_near[near[by_near][near_at]] = np.add.reduceat(g_context[by_near], near_at)
        g_in = g_far @ model.far.T + g_near @ model.near.T
        adam.step((g_in, g.T @ context, g.sum(axis=0), model.inputs.T @ g_near, model.inputs.T @ g_far), RATE * min(1.0, 2 * (1 - step / steps)))
    return model


def train_words(seen: np.ndarray, share: np.ndarray, after: np.ndarray, context: np.ndarray, steps: int = WORD_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and biases of words by the same estimation.

    ``seen``: counts after each class (classes by words); ``share``: each word's
    share of its own class; ``after``: how often its class comes after each
    class. Each word learns for itself, so any set of words can be trained apart.
    """
    n = (seen.sum(axis=0) + 0.5)[:, None].astype(np.float32)
    p = [np.zeros((seen.shape[1], context.shape[1]), np.float32), np.log(share).astype(np.float32)]
    odds = (NOISE * share).astype(np.float32)
    adam = _Adam(p)
    for step in range(steps):
        real = 1 / (1 + odds * np.exp(-np.clip(context @ p[0].T + p[1], -40, 40)))
        g = odds * after * real - seen * (1 - real)
        adam.step(((g.T @ context + RIDGE * p[0]) / n, g.sum(axis=0) / n[:, 0]), RATE * min(1.0, 2 * (1 - step / steps)))
    return p[0], p[1]


def cluster(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means of the rows of ``x``: the cluster of each."""
    if len(x) <= k:
        return np.arange(len(x))
    rng = np.random.default_rng(seed)
    near, centres = np.full(len(x), np.inf), []
    for _ in range(k):
        chance = weight * np.where(np.isinf(near), 1, near)
        centres.append(x[rng.choice(len(x), p=chance / chance.sum())] if chance.sum() > 0 else x[0])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        total = np.bincount(own, weight, k)
        sums = np.stack([np.bincount(own, weight * x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-12)[:, None], c)
    return own


@dataclass
class LanguageModel:
    """``words``: place of each head word; ``classes`` of head words and endings; ``logs``: log10 of a head word's count + 0.5; ``spread``: log10 of what the counts of an ending's rare words are divided by."""

    bilinear: Bilinear
    words: dict[bytes, int]
    classes: np.ndarray
    logs: np.ndarray
    spread: np.ndarray
    counts: DataFrame
    total: int
    distinct: int
    texts: int


def _places(words: list[bytes], known: dict[bytes, int], memory: dict[bytes, int]) -> np.ndarray:
    """Place of each word: in the head, or behind it by its ending."""
    at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    for i in np.nonzero(at < 0)[0].tolist():
        end = words[i][-3:]
        if (c := memory.get(end)) is None:
            c = memory[end] = len(known) + ending(end)
        at[i] = c
    return at


def _company(known: dict[bytes, int], rough: np.ndarray, axes: np.ndarray):
    """For each place, its occurrences, and sums of ``axes`` over the rough classes before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, memory, ends = len(known) + ENDINGS, {}, {}
        before, after = np.zeros(size * CLASSES, np.float32), np.zeros(size * CLASSES, np.float32)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                at, kinds = [], []
                for text in batch.column(0).slice(i, 1024):
                    words = tokens(text.as_py())
                    x = _places(words, known, memory)
                    k = np.concatenate([(START,), rough[x], (END,)])
                    for j in np.nonzero(x >= len(known))[0].tolist():
                        end = words[j][-2:]
                        if (c := ends.get(end)) is None:
                            c = ends[end] = _rough(end)
                        k[j + 1] = c
                    at.append(x)
                    kinds.append(k)
                x = np.concatenate(at)
                for out, side in ((before, [k[:-2] for k in kinds]), (after, [k[2:] for k in kinds])):
                    np.add.at(out, x * CLASSES + np.concatenate(side), np.float32(1))
        before, after = before.reshape(size, CLASSES), after.reshape(size, CLASSES)
        n = before.sum(axis=1)
        some = np.nonzero(n)[0]
        sums = np.hstack([before[some] @ axes[0], after[some] @ axes[1]])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.float64)), *(pa.array(c.astype(np.float64)) for c in sums.T)], ["place", "n", *(f"v{i}" for i in range(sums.shape[1]))])

    return run


def _counts(known: dict[bytes, int], classes: np.ndarray):
    """Counts of class triples (block -1), and of words after each class (by blocks of words), if they share a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, memory = np.zeros(CLASSES**3, np.int64), len(classes), {}
        pairs = np.zeros(CLASSES * size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                kinds, places = [], []
                for text in batch.column(0).slice(i, 1024):
                    x = _places(tokens(text.as_py()), known, memory)
                    kinds += [(START, START), classes[x], (END,)]
                    places += [(-1, -1), x, (-1,)]
                x, at = np.concatenate(kinds).astype(np.int64), np.concatenate(places).astype(np.int64)
                np.add.at(total, ((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:])[x[2:] != START], 1)
                np.add.at(pairs, (x[:-1] * size + at[1:])[at[1:] >= 0], 1)
        where, own = np.nonzero(total)[0], np.nonzero(pairs)[0]
        own = own[classes[own % max(size, 1)] >= FIRST_KIND]
        block = np.concatenate([np.full(len(where), -1), own % max(size, 1) // WORD_BLOCK]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate([where, own]).astype(np.int32)), pa.array(np.concatenate([total[where], pairs[own]]))], ["block", "at", "n"])

    return run


def fit_language_model(docs: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS, seed: int = 7) -> LanguageModel:
    """Learn from all rows of ``docs``; null texts are empty ones.

    Words are counted by Spark over every text; head words are at most
    ``head_words``, those above the lowest eighth of a power of two that keeps
    within it. A second pass over every text describes the company that each
    head word and each ending keeps, and the driver clusters them into classes
    by it. A third counts class triples and, for each class, its words after
    each class. The driver trains the classes' level on at most CLASSES cubed
    counts; words are trained in blocks by the tasks, on at most CLASSES counts
    each.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = docs.select(F.explode(F.split(text, GAP)).alias("word")).filter("word != ''")
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["level"], r["v"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for k, v, _ in levels:
        held += v
        if held > head_words:
            break
        least = k
    head = [] if least is None else sorted(((r["n"], bytes(r["w"])) for r in counts.filter(level >= least).select("n", F.col("word").cast("binary").alias("w")).collect()), key=lambda x: (-x[0], x[1]))
    known = {w: i for i, (_, w) in enumerate(head)}
    logs = np.log10(np.array([n for n, _ in head], float) + 0.5)
    bytes_ = F.col("word").cast("binary")
    rest = counts if least is None else counts.filter(level < least)
    spread = np.full(ENDINGS, np.log10(0.5))
    for r in rest.groupBy(F.pmod(F.crc32(F.substring(bytes_, -3, 3)), F.lit(ENDINGS)).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        spread[r["c"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))
    texts = docs.count()
    size = len(head) + ENDINGS
    own = min(OWN, len(head))

    rough = np.array([1 + i if i < own else _rough(w) for i, (_, w) in enumerate(head)] + [FIRST_KIND] * ENDINGS, np.int64)
    often = np.full(CLASSES, 0.5)
    often[[END, START]] += texts
    for i, (n, w) in enumerate(head):
        often[rough[i]] += n
    for r in rest.groupBy((FIRST_KIND + F.pmod(F.crc32(F.substring(bytes_, -2, 2)), F.lit(KINDS))).cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():
        often[r["c"]] += r["n"]
    often /= often.sum()
    axes = (np.random.default_rng(seed).normal(size=(2, CLASSES, SKETCH)) / np.sqrt(often)[None, :, None]).astype(np.float32)
    names = [f"v{i}" for i in range(2 * SKETCH)]
    company = docs.select(text_col).mapInArrow(_company(known, rough, axes), ", ".join(["place int", "n double", *(f"{c} double" for c in names)]))
    company = company.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toPandas().sort_values("place")
    n, x = np.zeros(size), np.zeros((size, 2 * SKETCH))
    place = company["place"].to_numpy()
    n[place], x[place] = company["n"], company[names]
    x = (x - n[:, None] * np.hstack([often @ axes[0], often @ axes[1]])) / (n[:, None] + 20)
    classes = np.arange(1, size + 1)
    classes[own:] = FIRST_KIND + cluster(x[own:], np.sqrt(n[own:]) + 1e-3, KINDS, seed)

    found = materialise(docs.select(text_col).mapInArrow(_counts(known, classes), "block int, at int, n long").groupBy("block", "at").agg(F.sum("n").alias("n")))
    triples = found.filter("block = -1").select("at", "n").toPandas().sort_values("at")
    at = triples["at"].to_numpy(np.int64)
    bilinear = train(at, triples["n"].to_numpy(np.float64), seed)
    context = bilinear.inputs @ bilinear.near
    after = np.bincount(at % CLASSES**2, triples["n"], CLASSES**2).reshape(CLASSES, CLASSES).astype(np.float32)
    share = ((n + 0.5) / np.bincount(classes, n + 0.5, CLASSES)[classes]).astype(np.float32)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        first = WORD_BLOCK * int(pdf["block"].iloc[0])
        places, at = np.arange(first, min(first + WORD_BLOCK, size)), pdf["at"].to_numpy(np.int64)
        seen = np.bincount(at // size * len(places) + at % size - first, pdf["n"], CLASSES * len(places)).reshape(CLASSES, -1).astype(np.float32)
        vectors, bias = train_words(seen, share[places], after[:, classes[places]], context)
        return pd.DataFrame({"place": places, "bias": bias.astype(float), "vector": [v.tobytes() for v in vectors]})

    bilinear.words, bilinear.word_bias, bilinear.kinds = np.zeros((size, DIMENSIONS), np.float32), np.log(share), classes
    for r in found.filter("block >= 0").groupBy("block").applyInPandas(block, "place long, bias double, vector binary").collect():
        bilinear.words[r["place"]], bilinear.word_bias[r["place"]] = np.frombuffer(r["vector"], np.float32), r["bias"]
    discard(found)
    return LanguageModel(bilinear, known, classes, logs, spread, counts, sum(x[2] for x in levels) + texts, sum(x[1] for x in levels) + (texts > 0), texts)


def _score(model: LanguageModel):
    """Row number, id, tokens, known head words, sums over head words, model part and rare words (each with its number) of each text."""
    known, classes, logs, spread, bilinear, texts = model.words, model.classes, model.logs, model.spread, model.bilinear, model.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, memory, head = TaskContext.get().partitionId() << 40, {}, len(known)
        probability, shares = bilinear.log_probabilities().reshape(-1), bilinear.log_shares()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = tokens(text.as_py())
                at = _places(words, known, memory)
                x = np.concatenate([(START, START), classes[at], (END,)])
                part = probability[(x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]].sum(dtype=np.float64)
                inner = x[2:-1] >= FIRST_KIND
                part += shares[x[1:-2][inner], at[inner]].sum(dtype=np.float64)
                rare = at >= head
                part -= spread[at[rare] - head].sum()
                base = logs[at[~rare]].sum() + np.log10(texts + 0.5)
                counted = Counter(words[i] for i in np.nonzero(rare)[0].tolist())
                out.append((row, doc.as_py(), len(words) + 1, int((~rare).sum()) + (texts > 0), base, part, [{"w": w, "k": k} for w, k in counted.items()]))
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("w", pa.binary()), ("k", pa.int64())])))
            columns = zip(*out, strict=True) if out else ([],) * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["row", "doc", "n_tokens", "n_known", "base", "part", "rare"])

    return run


def score_texts(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n_tokens, n_known, base_score, score`` of every row.

    score: log10 of the probability of the whole text: of each class after the
    two before it, times for words that share a class the word's share of it
    after the class before, times for words outside the head their share of
    their ending, (count + 0.5) over all counts of the ending + 0.5 * (words + 1).
    base_score: the same of single words. Counts of rare words are joined, each
    once for a row, however often it has it. Null texts count as empty and have
    the end alone; repeated rows stay; other columns are not read.
    """
    schema = "row long, doc long, n_tokens long, n_known long, base double, part double, rare array<struct<w:binary,k:bigint>>"
    found = materialise(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_score(model), schema))
    rare = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").cast("string").alias("word"), "r.k")
    joined = rare.join(model.counts, "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    whole = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return found.drop("rare").join(sums, "row", "left").select("doc", "n_tokens", (F.col("n_known") + seen).alias("n_known"), (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("part") + more).alias("score"))


def held_out(id_col: str = "doc_id"):
    """A fifth of the ids, by checksum; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_language_model(docs.filter(~held_out()))
    found = score_texts(docs, model).withColumnRenamed("doc", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
