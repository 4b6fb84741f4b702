"""Links between sets of hashes that are similar enough, from buckets of candidates: exact Jaccard in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialise
from .simhash import near_pairs

TILE = 256
#: Hashes in a tile, on average; sets of long texts share a tile with fewer others.
TILE_HASHES = 1 << 18


def _find(root: dict, x):
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def _tiles(column: pa.ListArray) -> Iterator[tuple[list[int], list[frozenset], np.ndarray | None] | None]:
    """Hashes, sets and prints (if there are any) of each tile; None for a null one. Numbers are converted in stretches, one tile at a time."""
    ends, inside = column.offsets.to_numpy(), column.values
    h, sets = inside.field("h").to_numpy(), inside.field("s")
    at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    prints = inside.field("fp") if inside.type.get_field_index("fp") >= 0 else None
    for i, valid in enumerate(column.is_valid().to_pylist()):
        a, b = int(ends[i]), int(ends[i + 1])
        if not valid:
            yield None
            continue
        part, cuts = flat[at[a] : at[b]].tolist(), (at[a : b + 1] - at[a]).tolist()
        own = None if prints is None else prints.slice(a, b - a).flatten().to_numpy().view(np.uint64).reshape(b - a, -1 if a < b else 1)
        yield h[a:b].tolist(), [frozenset(part[x:y]) for x, y in pairwise(cuts)], own


def _verify(similarity: float, radius: int | None):
    """Exact Jaccard of the sets of one or two tiles; a link to the least hash that each reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(_tiles(batch.column(0)), _tiles(batch.column(1)), strict=True):
                rows = list(zip(left[0], left[1], strict=True))
                other = rows if right is None else list(zip(right[0], right[1], strict=True))
                root = {h: h for h, _ in (*rows, *other)}
                if radius is None:
                    pairs = ((i, j) for i in range(len(rows)) for j in range(i if right is None else len(other)))
                else:
                    pairs = zip(*(x.tolist() for x in near_pairs(left[2], None if right is None else right[2], radius)), strict=True)
                for i, j in pairs:
                    (h, s), (g, t) = rows[i], other[j]
                    if min(len(s), len(t)) >= similarity * max(len(s), len(t)) and (u := _find(root, h)) != (v := _find(root, g)):
                        both = len(s & t)
                        if both >= similarity * (len(s) + len(t) - both):
                            root[max(u, v)] = min(u, v)
                for h in root:
                    if (g := _find(root, h)) != h:
                        a.append(h)
                        b.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def in_buckets(keys: DataFrame) -> DataFrame:
    """``h, value, c``: the rows of ``keys`` (distinct h, value) whose value several have, and how many."""
    return keys.join(keys.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1"), "value").select("h", "value", "c")


def similar_links(keyed: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE, radius: int | None = None, split: bool = False) -> DataFrame:
    """``a, b``: links that join all ``sets`` (h, s, and fp if ``radius`` is given) that meet in a bucket and are similar enough.

    ``keyed`` comes from ``in_buckets``. With ``split`` a value is a hash that
    all sets of the bucket hold; a bucket of over ``tile`` sets is then dealt
    again by their next least hashes: two sets that are similar enough share
    one of the first n - ceil(similarity * n) + 1 others (n hashes in all), so
    no pair is lost, and sets with one common hash and nothing else part. What
    is still larger is cut into tiles by size and hash; tiles whose sizes can't
    be similar enough don't meet, the other pairs of tiles are spread over the
    tasks. With ``radius``, only pairs whose prints differ in so many bits at
    most are verified.
    """
    members = keyed.join(sets, "h").withColumn("n", F.size("s")).withColumn("sub", F.lit(0).cast("long"))
    if split:
        others = F.array_except(F.array_sort("s"), F.array("value"))
        subs = F.when(F.size(others) == 0, F.array("value")).otherwise(F.slice(others, 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")))
        large = members.filter(F.col("c") > tile).withColumn("sub", F.explode(subs))
        members = members.filter(F.col("c") <= tile).unionByName(large)
    members = materialise(members)
    cells = members.groupBy("value", "sub", "n").agg(F.count("*").alias("k"))
    whole = cells.groupBy("value", "sub").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("n")).alias("hashes"))
    cut = (F.col("k") > tile) | (F.col("hashes") > TILE_HASHES)
    whole = materialise(whole.filter("k > 1").withColumn("cut", cut))
    tiles = F.ceil(F.greatest(F.col("k") / tile, F.col("k") * F.col("n") / TILE_HASHES)).cast("int").alias("m")
    cells = materialise(cells.join(whole.filter("cut").select("value", "sub"), ["value", "sub"]).select("value", "sub", "n", tiles))
    row = F.struct(*(c for c in ("h", "s", "fp") if c in members.columns))
    small = members.join(whole.filter("not cut").select("value", "sub"), ["value", "sub"]).groupBy("value", "sub").agg(F.collect_list(row).alias("rows"))
    pairs = small.select("rows", F.lit(None).cast(small.schema["rows"].dataType).alias("other"))
    used = [members, whole, cells]
    if not cells.isEmpty():
        dealt = members.join(cells, ["value", "sub", "n"]).withColumn("t", F.pmod(F.xxhash64("h"), F.col("m")).cast("int"))
        parts = materialise(dealt.groupBy("value", "sub", "n", "t").agg(F.collect_list(row).alias("rows")))
        used.append(parts)
        reach = cells.withColumnRenamed("m", "m1").join(cells.select("value", "sub", F.col("n").alias("n2"), F.col("m").alias("m2")), ["value", "sub"]).filter(F.col("n2").between(F.col("n"), F.floor(F.col("n") / similarity + 1e-9)))
        left = parts.join(reach, ["value", "sub", "n"]).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("m2") - 1))).filter("n2 > n or t2 > t").select("value", "sub", "n2", "t2", "rows")
        right = parts.select("value", "sub", F.col("n").alias("n2"), F.col("t").alias("t2"), F.col("rows").alias("other"))
        pairs = pairs.union(parts.filter(F.size("rows") > 1).select("rows", F.lit(None).cast(parts.schema["rows"].dataType))).union(left.join(right, ["value", "sub", "n2", "t2"]).select("rows", "other"))
    links = materialise(pairs.mapInArrow(_verify(similarity, radius), "a long, b long").distinct())
    for t in used:
        discard(t)
    return links
