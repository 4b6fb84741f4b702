"""Nearest-neighbour and point-in-region joins by blocks and cells of the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import discard, materialise, tidy


#: A grid cell with more places is split into CUT x CUT, for the points in it.
CUT, DEEPEST = 4, 22
#: Places in a block, boxes in the directory (one for a FANth of a block, or more places if there would be too many), children of a node of the directory, bits of a coordinate along the curve.
BLOCK, DIRECTORY, FAN, BITS = 256, 1 << 18, 16, 31
#: Points that meet a block in one task, and pairs that are computed at once.
POINTS, PAIRS = 1 << 15, 1 << 19


def _cell(c: str, side: Column) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def cell_levels(points: DataFrame, places: DataFrame, side: float, crowd: int) -> DataFrame:
    """``points`` with ``level``: how often the cell around each is split until it holds at most ``crowd`` places.

    Each step counts places by cell and goes on with those in cells that hold
    too many, so a crowded part of the plane is counted anew and the rest is not.
    """
    left, crowded = places.select("rx", "ry"), []
    while len(crowded) < DEEPEST:
        now = F.lit(side / CUT ** len(crowded))
        left = left.withColumns({"cx": _cell("rx", now), "cy": _cell("ry", now)})
        full = materialise(left.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("cx", "cy"))
        if full.isEmpty():
            discard(full)
            break
        crowded.append(full)
        left = left.join(full, ["cx", "cy"], "left_semi").select("rx", "ry")
    out = points.withColumn("level", F.lit(0))
    for k, full in enumerate(crowded):
        now = F.lit(side / CUT**k)
        keyed = out.withColumns({"cx": F.when(F.col("level") == k, _cell("x", now)), "cy": _cell("y", now)})
        out = keyed.join(full.withColumn("in", F.lit(1)), ["cx", "cy"], "left").select("id", "x", "y", (F.col("level") + F.coalesce("in", F.lit(0))).alias("level"))
    out = materialise(out)
    for full in crowded:
        discard(full)
    return out


def _codes(x: np.ndarray, y: np.ndarray, low: tuple[float, float], side: float) -> np.ndarray:
    """Places along a Z-shaped curve through the square at ``low``: the bits of both coordinates in turn."""
    out = np.zeros(len(x), np.int64)
    for k, (v, least) in enumerate(((x, low[0]), (y, low[1]))):
        n = np.minimum((v - least) / side * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = (n | n << shift) & mask
        out |= n << k
    return out


def _blocks(places: DataFrame, low: tuple[float, float], side: float, n: int, size: int) -> DataFrame:
    """``places`` with ``block`` and ``leaf``: runs of at most ``size`` places along the curve, and of a FANth of them if the directory has room; ``code``: where along it."""
    leaf = min(size, max(size // FAN, -(-n // DIRECTORY), 1))
    size -= size % leaf

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(batch["rx"].to_numpy(), batch["ry"].to_numpy(), low, side)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "block"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            block, part = (head + (at + np.arange(batch.num_rows)) // s for s in (size, leaf))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block), pa.array(part), batch.columns[-1]], [*batch.schema.names, "leaf", "code"])

    schema = T.StructType([*places.schema.fields, T.StructField("block", T.LongType())])
    cut = T.StructType([*schema.fields, T.StructField("leaf", T.LongType()), T.StructField("code", T.LongType())])
    parts = -(-n // (64 * size))
    dealt = places.mapInArrow(coded, schema)
    dealt = dealt.coalesce(1) if parts == 1 else dealt.repartitionByRange(parts, "block", "rx", "ry")
    return materialise(dealt.sortWithinPartitions("block", "rx", "ry").mapInArrow(numbered, cut))


class _Directory:
    """Boxes and numbers of references of parts of blocks in order along the curve, with the boxes of FAN of them, of FAN such, and so on above."""

    def __init__(self, rows: list, low: tuple[float, float], side: float) -> None:
        self.codes, self.low, self.side = np.array([r["code"] for r in rows], np.int64), low, side
        self.names = np.array([r["block"] for r in rows], np.int64)
        level = np.array([(r["x0"], r["x1"], r["y0"], r["y1"], r["n"]) for r in rows], float).reshape(-1, 5)
        self.levels = [level]
        while len(level) > FAN:
            heads = np.arange(0, len(level), FAN)
            level = np.column_stack([f.reduceat(level[:, c], heads) for c, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum, np.add))])
            self.levels.append(level)

    def _home(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """A radius, squared, around each point that holds ``k`` references: those of the box that the curve passes nearest to it, or of one above."""
        code = _codes(*(np.clip(v, a, a + self.side) for v, a in zip((x, y), self.low, strict=True)), self.low, self.side)
        node, bound = np.maximum(np.searchsorted(self.codes, code, "right") - 1, 0), np.full(len(x), np.inf)
        for level in self.levels:
            x0, x1, y0, y1, n = level[node].T
            far = np.maximum(x - x0, x1 - x) ** 2 + np.maximum(y - y0, y1 - y) ** 2
            bound = np.where(np.isinf(bound) & (n >= k), far, bound)
            node = node // FAN
        return bound

    def asked(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of points and the blocks in which their ``k`` nearest references, and all as near as the last, can lie.

        The boxes that lie whole within a radius bound the distance to the k-th
        reference, and so does the box around the point; of each level only boxes that reach within the least such radius are opened.
        """
        bound = self._home(x, y, k)
        p, node = np.repeat(np.arange(len(x)), len(self.levels[-1])), np.tile(np.arange(len(self.levels[-1])), len(x))
        for depth in range(len(self.levels) - 1, -1, -1):
            x0, x1, y0, y1, n = self.levels[depth][node].T
            dx, dy = np.maximum(np.maximum(x0 - x[p], x[p] - x1), 0.0), np.maximum(np.maximum(y0 - y[p], y[p] - y1), 0.0)
            fx, fy = np.maximum(x[p] - x0, x1 - x[p]), np.maximum(y[p] - y0, y1 - y[p])
            least, most = dx * dx + dy * dy, fx * fx + fy * fy
            if k == 1:  # any box holds one
                first = np.flatnonzero(np.r_[True, np.diff(p) > 0])
                bound[p[first]] = np.minimum(bound[p[first]], np.minimum.reduceat(most, first))
            else:
                order = np.lexsort((most, p))
                held = np.cumsum(n[order])
                first = np.flatnonzero(np.r_[True, np.diff(p[order]) > 0])
                held -= np.repeat(held[first] - n[order][first], np.diff(np.r_[first, len(order)]))
                enough, sure = order[held >= k], np.full(len(x), np.inf)
                sure[p[enough[::-1]]] = most[enough[::-1]]  # the first of each point is written last
                bound = np.minimum(bound, sure)
            stay = least <= bound[p] * (1 + 1e-9)
            p, node = p[stay], node[stay]
            if depth:
                below = len(self.levels[depth - 1])
                width = np.minimum((node + 1) * FAN, below) - node * FAN
                first = np.cumsum(width) - width
                p, node = np.repeat(p, width), np.repeat(node * FAN - first, width) + np.arange(width.sum())
        block = self.names[node]
        new = np.r_[True, (np.diff(p) != 0) | (np.diff(block) != 0)][: len(p)]
        return p[new], block[new]


def _nearest_in_block(k: int, ties: bool):
    """The ``k`` nearest places of one block for each point that asks."""

    def run(points: pa.Table, places: pa.Table) -> pa.Table:
        x, y = points["x"].to_numpy(), points["y"].to_numpy()
        order = np.argsort(places["place"].to_numpy(), kind="stable")
        rx, ry = places["rx"].to_numpy()[order], places["ry"].to_numpy()[order]
        rows, cols, far = [], [], []
        for i in range(0, len(x), step := max(1, PAIRS // max(len(rx), 1))):
            d2 = (x[i : i + step, None] - rx) ** 2 + (y[i : i + step, None] - ry) ** 2
            if d2.shape[1] > k:
                last = d2.min(axis=1, keepdims=True) if k == 1 else np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
                near = d2 <= last
                if not ties:  # of equal distances those of least id
                    over = near & (d2 == last)
                    room = k - (near & ~over).sum(axis=1, keepdims=True)
                    near &= ~over | (np.cumsum(over, axis=1) <= room)
            else:
                near = np.ones(d2.shape, bool)
            r, c = np.nonzero(near)
            rows.append(r + i)
            cols.append(c)
            far.append(d2[r, c])
        r, c, d = (np.concatenate(v) if v else np.zeros(0, int) for v in (rows, cols, far))
        at = pa.array(order[c.astype(np.int64)])
        return pa.table({"id": points["id"].combine_chunks().take(pa.array(r.astype(np.int64))), "place": places["place"].combine_chunks().take(at), "refs": places["refs"].combine_chunks().take(at), "d2": pa.array(d, pa.float64())})

    return run


@tidy
def nearest(points: DataFrame, refs: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """``id, ref, d2, rank``: the ``k`` nearest references of every point (both: id, x, y; ids differ).

    References are cut into blocks along a curve through the plane, crowded
    parts into more. A directory of boxes and counts of parts of blocks, of DIRECTORY
    boxes at most, goes to all tasks; for each point it gives a radius that surely
    holds ``k`` references, and the point meets the few blocks that reach within
    it, wherever crowds lie. Blocks that very many points ask for meet them in
    parts. References at one place count as one there, with their ``k`` least
    ids. Ranks go by distance, then id; with ``ties`` all references as near as
    the ``k``-th have their rank. Points get fewer rows if there are fewer
    references; rows whose place is null, NaN or infinite are left out.
    """
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = lambda d: d.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(there("x") & there("y"))
    points, refs = good(points), good(refs).select(F.col("id").alias("ref"), (F.col("x") + 0.0).alias("rx"), (F.col("y") + 0.0).alias("ry"))
    first = refs.withColumn("_n", F.row_number().over(Window.partitionBy("rx", "ry").orderBy("ref"))).filter(F.col("_n") <= k)
    places = materialise(first.groupBy("rx", "ry").agg(F.min("ref").alias("place"), F.array_sort(F.collect_list("ref")).alias("refs")))
    n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    if not n:
        return refs.sparkSession.createDataFrame([], "id long, ref long, d2 double, rank int")
    low, side = (x0, y0), max(x1 - x0, y1 - y0) or 1.0
    blocks = _blocks(places, low, side, n, max(BLOCK, 4 * k, -(-n // DIRECTORY)))
    boxes = blocks.groupBy("block", "leaf").agg(F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"), F.sum(F.size("refs")).alias("n"), F.min("code").alias("code"))
    directory = refs.sparkSession.sparkContext.broadcast(_Directory(sorted(boxes.collect()), low, side))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                p, block = directory.value.asked(part["x"].to_numpy(), part["y"].to_numpy(), k)
                took = part.take(pa.array(p))
                yield pa.RecordBatch.from_arrays([pa.array(block), *took.columns], ["block", "id", "x", "y"])

    asked = materialise(points.mapInArrow(ask, T.StructType([T.StructField("block", T.LongType()), *points.schema.fields])))
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("m"))  # a row for each block of the directory at most
    dealt = asked.join(F.broadcast(parts), "block").select("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("t"), "id", "x", "y")
    met = blocks.join(F.broadcast(parts), "block").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("block", "t", "place", "refs", "rx", "ry")
    kinds = {f.name: f.dataType.simpleString() for f in (*points.schema.fields, *places.schema.fields)}
    near = dealt.groupBy("block", "t").cogroup(met.groupBy("block", "t")).applyInArrow(_nearest_in_block(k, ties), f"id {kinds['id']}, place {kinds['place']}, refs {kinds['refs']}, d2 double")
    if ties:
        # places as near as the k-th reference, then all references there
        out = near.withColumn("_r", F.rank().over(Window.partitionBy("id").orderBy("d2"))).filter(F.col("_r") <= k)
        if refs.count() > n:
            held = refs.join(places.select("rx", "ry", "place"), ["rx", "ry"]).select("place", "ref")
            each = out.select("id", "place", "d2").join(held, "place")
        else:  # one at every place
            each = out.select("id", "d2", F.explode("refs").alias("ref"))
        rank = F.rank().over(Window.partitionBy("id").orderBy("d2")) if k > 1 else F.lit(1)
    else:
        out = near.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("d2", "place"))).filter(F.col("_r") <= k)
        each = out.select("id", "d2", F.explode("refs").alias("ref"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "ref"))
    return materialise(each.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "ref", "d2", "rank"))


def assign_regions(points: DataFrame, generators: DataFrame, pad: float = 0.0) -> DataFrame:
    """``id, region``: the Voronoi cell of each point, as the nearest generator; a point on a shared edge is in both cells.

    Points beyond the generators' bounding box, widened by ``pad``, are in none.
    """
    x0, x1, y0, y1 = generators.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        return points.select("id", F.col("id").alias("region")).limit(0)
    inside = points.filter(F.col("x").between(x0 - pad, x1 + pad) & F.col("y").between(y0 - pad, y1 + pad))
    return nearest(inside, generators, 1, ties=True).select("id", F.col("ref").alias("region"))


def clipped_medians(neighbours: DataFrame, key: str, value: str, sigmas: float = 2.0) -> DataFrame:
    """``key, n_kept, median``: the median of what lies within ``sigmas`` population deviations of the median, strictly.

    Where nothing does (no spread), the plain median of all stands.
    """
    first = neighbours.groupBy(key).agg(F.percentile(value, 0.5).alias("m"), F.stddev_pop(value).alias("s"), F.collect_list(value).alias("v"))
    kept = F.filter("v", lambda x: F.abs(x - F.col("m")) < sigmas * F.col("s"))
    ordered = first.select(key, "m", F.array_sort(kept).alias("o"))
    n = F.size("o")
    middle = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    return ordered.select(key, n.cast("long").alias("n_kept"), F.coalesce(middle, "m").alias("median"))
