"""Mixing sources to target weights: whole documents whose lengths sum to each source's budget."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: The dynamic programme covers budgets up to so many words, or twice the longest document; what lies above is filled before.
EXACT_WORDS = 1 << 16
#: With few lengths it covers more: so many words times lengths.
EXACT_WORK = 1 << 26
#: Documents of one source and length are ranked in parts, so many or one for so many documents of the table.
LEAST_PARTS, PART_ROWS = 256, 1 << 16


def word_count(text_col: str = "text"):
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``s, source_size, target`` of ``sources`` (s, late, source_size): the sum of sizes shared by weight.

    Sources in order of ``late, s`` have ``weights`` in turn. What exceeds
    ``most`` times a size is shared again among the others, in rounds: each is
    one sum over the table, so any number of sources will do.
    """
    spread = sources.repartitionByRange("late", "s").sortWithinPartitions("late", "s").withColumn("_at", F.monotonically_increasing_id())
    spread = materialise(spread)
    parts = sorted((r["part"], r["n"]) for r in spread.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, sum(n for q, n in parts if q < p)) for p, _ in parts]
    offsets = spread.sparkSession.createDataFrame(before, "part long, before long")
    spread = spread.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "part")
    place = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = materialise(spread.select("s", "source_size", weight.alias("w")))
    cap = F.lit(most) * F.col("source_size")
    left, total, level = 0.0, 0.0, None
    while True:
        over = F.lit(False) if level is None else F.lit(level[0]) * F.col("w") / F.lit(level[1]) > cap
        row = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("taken"), F.sum(F.when(~over, F.col("w"))).alias("open")).first()
        left, total = float(row["all"] or 0) - float(row["taken"] or 0), float(row["open"] or 0)
        if (left, total) == level or not total:
            break
        level = (left, total)
    shares = cap if level is None else F.least(F.lit(level[0]) * F.col("w") / F.lit(level[1]), cap)
    return weighed.select("s", "source_size", shares.cast("double").alias("target"))


def _bits(number: int) -> np.ndarray:
    """The places of the bits that are set."""
    parts = np.frombuffer(number.to_bytes(number.bit_length() // 8 + 1, "little"), np.uint8)
    at = np.nonzero(parts)[0]
    row, bit = np.nonzero(np.unpackbits(parts[at][:, None], axis=1, bitorder="little"))
    return 8 * at[row] + bit


def fit_lengths(lengths: list[int], counts: list[int], budget: int, seed: str, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take so that they sum to ``budget``, or as near below it as found.

    First an equal share of every length, rounded down; then single documents
    in seeded order until at most ``exact`` words are open, or twice the longest
    length, so that none is too long to be tried, or EXACT_WORK by the number of
    lengths, so that few are all tried together; these are settled by a
    bounded-knapsack programme over reachable sums, kept as bits of one number,
    each count split into powers of two. Of each sum, only the step that first
    reached it is kept.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = [i for i in sorted(range(len(lengths)), key=lambda i: hashlib.blake2b(f"{seed}|{lengths[i]}".encode(), digest_size=8).digest()) if lengths[i]]
    exact = max(exact, 2 * max((lengths[i] for i in order), default=0), EXACT_WORK // max(len(order), 1))
    for i in order:
        if left > exact and taken[i] < counts[i]:
            more = min(counts[i] - taken[i], (left - exact // 2) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    room = left
    reach, mask, steps, first = 1, (1 << room + 1) - 1, [], np.zeros(room + 1, np.int32)
    for i in order:
        free, k = min(counts[i] - taken[i], room // lengths[i]), 1
        while free > 0 and not reach >> room & 1:
            k = min(k, free)
            new = (reach << k * lengths[i]) & mask & ~reach
            if new:
                first[_bits(new)] = len(steps)
                steps.append((i, k))
                reach |= new
            free -= k
            k *= 2
    at = reach.bit_length() - 1
    while at:
        i, k = steps[first[at]]
        taken[i] += k
        at -= k * lengths[i]
    return taken


def _plan(seed: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        budget = int(np.rint(target))
        whole = min(MOST_COPIES, budget // size) if size else 0
        part = [0] * len(pdf)
        if size and whole < MOST_COPIES:
            part = fit_lengths(pdf["size"].tolist(), pdf["n"].tolist(), budget - whole * size, f"{seed}|{pdf['s'].iloc[0]}")
        return pdf[["s", "size"]].assign(whole=whole, part=part, source_size=size, target=target)

    return run


def mix_sources(docs: DataFrame, size: str, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies`` (how often the mix takes each row, up to three times).

    ``size`` names a column of whole numbers, null meaning 0. Sources in order
    of code points, null last, weigh ``weights`` in turn. Sources are counted by
    exact length; each source is planned from its lengths and their counts.
    Rows of one source and length are taken in the order of a seeded hash of id
    and content, ranked within parts by hash, so that no length is one task
    however many rows have it. Rows of length 0 get the whole copies alone.
    Older columns of these names are replaced; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    kinds = dict(docs.dtypes)
    tie = F.xxhash64(F.lit(seed), F.col(id_col), *(F.col(c) for c in own if c != id_col and not any(k in kinds[c] for k in ("map<", "variant"))))
    parts = max(LEAST_PARTS, 1 << (docs.count() // PART_ROWS).bit_length())
    rows = docs.select(*own, F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col))).alias("_s"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), tie.alias("_tie"))
    rows = rows.withColumn("_b", F.pmod("_tie", F.lit(parts)).cast("int"))
    cells = materialise(rows.groupBy(F.col("_s").alias("s"), F.col("_size").alias("size"), F.col("_b").alias("b")).agg(F.count("*").alias("n")))
    lengths = cells.groupBy("s", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("late", F.col("s") == "0")
    plan = lengths.join(source_targets(sources, weights), "s").groupBy("s").applyInPandas(_plan(seed), "s string, size long, whole int, part long, source_size long, target double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = cells.join(plan, ["s", "size"]).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("part") - before)))
    quota = quota.select("s", F.col("size").alias("q_size"), "b", "whole", "quota", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    joined = rows.join(quota, (F.col("_s") == F.col("s")) & (F.col("_size") == F.col("q_size")) & (F.col("_b") == F.col("b")))
    rank = F.row_number().over(Window.partitionBy("_s", "_size", "_b").orderBy("_tie"))
    return joined.withColumn("_rank", rank).select(*own, F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("whole") + (F.col("_rank") <= F.col("quota")).cast("int")).alias("copies"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Size, source, target and words taken of every document."""
    docs = materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count().alias("size")))
    return mix_sources(docs, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
