"""Subtraction of a field from a cluster, cell by cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, tidy

#: Stars of a block of a region, and pairs of a star and a draw that are sorted at once.
BLOCK, CELLS = 4096, 1 << 19
_WORD = (1 << 64) - 1


def region_counts(assigned: DataFrame) -> DataFrame:
    """``region, n``: points of each region; empty regions are left out."""
    return assigned.groupBy("region").agg(F.count("*").alias("n"))


def expected_rate(n: Column, fov_ratio: float | Column) -> Column:
    """Field stars that a region should hold inside the cluster's field of view."""
    return n * fov_ratio


def expected_membership(field_counts: DataFrame, cluster: DataFrame) -> DataFrame:
    """``id, membership`` in regions with both kinds of stars: the mean of the random subtraction.

    ``field_counts``: region, rate; ``cluster``: id, region. A region with n
    cluster stars loses floor(rate) or one more, n at most, all stars alike
    likely. A star in two regions gets the sum of both losses.
    """
    sizes = cluster.groupBy("region").agg(F.count("*").alias("c"))
    whole = F.floor("rate")
    part = F.col("rate") - whole
    loss = ((1 - part) * F.least(whole, F.col("c")) + part * F.least(whole + 1, F.col("c"))) / F.col("c")
    lost = sizes.join(field_counts, "region").select("region", loss.alias("loss"))
    return cluster.join(lost, "region").groupBy("id").agg((1 - F.sum("loss")).alias("membership"))


def _taken(draws: int, seed: int):
    """How often each star of one block of a region is drawn.

    How many a draw takes from the region is seeded by the region, how these
    part between the halves of its blocks by the region and the node, and which stars by the block:
    blocks agree without hearing of each other.
    """

    def run(rows: pa.Table) -> pa.Table:
        first = {c: rows[c][0].as_py() for c in ("region", "block", "rate", "n", "sizes")}
        key = [seed & _WORD, first["region"] & _WORD]
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rng = np.random.default_rng([*key, 0])
        k = np.minimum(np.floor(first["rate"]) + (rng.random(draws) < first["rate"] % 1), first["n"]).astype(np.int64)
        levels = len(first["sizes"])
        for level, (own, beside) in enumerate(first["sizes"], 1):
            node = first["block"] >> (levels - level)
            left, right = (own, beside) if node % 2 == 0 else (beside, own)
            low = np.random.default_rng([*key, 1, level, node >> 1]).hypergeometric(left, right, k)
            k = low if node % 2 == 0 else k - low
        n, count = rows.num_rows, np.zeros(rows.num_rows, np.int64)
        rng = np.random.default_rng([*key, 2, levels, first["block"]])
        for i in range(0, draws, step := max(1, CELLS // n)):
            asked = k[i : i + step]
            ranks = rng.random((len(asked), n)).argsort(axis=1)
            count += np.bincount(ranks[np.arange(n) < asked[:, None]], minlength=n)
        return pa.table({"id": rows["id"].combine_chunks().take(pa.array(order)), "taken": pa.array(count)})

    return run


@tidy
def sampled_membership(field_counts: DataFrame, cluster: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """``id, membership`` = 1 - share of draws that take the star out; only stars taken out at least once.

    Each draw takes floor(rate), or one more with the fraction's probability,
    of each region's stars without replacement. Regions are cut into blocks of some BLOCK
    stars, by hash; each block draws its share of a region's (hypergeometric, by
    halves), so tasks add up draws in place and no row is made for a star and a draw.
    Seeded, so results are the same however rows are dealt. ``region`` and ids are integers; regions have under a billion stars.
    """
    sizes = cluster.groupBy("region").agg(F.count("*").alias("n")).join(field_counts.filter("rate > 0"), "region")
    depth = F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(0)).cast("int")
    dealt = cluster.join(sizes.select("region", "n", "rate", depth.alias("depth")), "region")
    dealt = materialise(dealt.select("id", "region", "n", "rate", "depth", F.pmod(F.xxhash64("id"), F.expr("shiftleft(1L, depth)")).alias("block")))
    blocks = dealt.groupBy("region", "block", "depth").agg(F.count("*").alias("c"))
    nodes = blocks.filter("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(1), "depth")))
    nodes = nodes.withColumn("node", F.expr("shiftright(block, depth - level)"))
    held = materialise(nodes.groupBy("region", "level", "node").agg(F.sum("c").alias("c")))
    beside = held.select("region", "level", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("c").alias("beside"))
    path = nodes.select("region", "block", "level", "node").join(held, ["region", "level", "node"]).join(beside, ["region", "level", "node"], "left")
    pair = F.array(F.col("c"), F.coalesce("beside", F.lit(0).cast("long")))
    path = path.groupBy("region", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", pair.alias("p")))), lambda s: s["p"]).alias("sizes"))
    rows = dealt.join(path, ["region", "block"], "left").select("id", "region", "block", "rate", "n", F.coalesce("sizes", F.array().cast("array<array<bigint>>")).alias("sizes"))
    kind = cluster.schema["id"].dataType.simpleString()
    found = rows.groupBy("region", "block").applyInArrow(_taken(draws, seed), f"id {kind}, taken long")
    return materialise(found.filter("taken > 0").groupBy("id").agg((1 - F.sum("taken") / draws).alias("membership")))


def update_membership(stars: DataFrame, new: DataFrame) -> DataFrame:
    """``stars`` (with id, membership) with the new membership where there is one; all others keep the old."""
    fresh = new.select("id", F.col("membership").alias("_new"))
    return stars.join(fresh, "id", "left").withColumn("membership", F.coalesce("_new", "membership")).drop("_new")
