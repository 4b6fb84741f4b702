"""Regions of any outline: which hold a point, and the outlines of cells that were merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ring_area_centroid
from ..shared import materialise, tidy

#: Cells across a ring: as many as the root of its vertices, between these.
FEWEST, MOST = 4, 64
#: Pairs of an edge and a cell that are looked at together.
PAIRS = 1 << 18
RING = "array<struct<x:double,y:double>>"
CELLS = "region long, level int, cx long, cy long, whole boolean, edges array<struct<ax:double,ay:double,bx:double,by:double>>"


def cover(ring: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Level (cells have a side of 2 to its power) and cells (n, 2) that a ring of (v, 2) vertices reaches, whether each lies within it, and the (v, 4) edges.

    A cell is half open, as points belong to one by rounding down, which is exact
    for such sides. Cells that an edge comes near are not whole; of the others, those
    whose middle is inside are.
    """
    edges = np.column_stack([ring, np.roll(ring, -1, axis=0)])
    low, high = ring.min(axis=0), ring.max(axis=0)
    across = min(MOST, max(FEWEST, math.isqrt(len(ring))))
    extent = float((high - low).max())
    level = max(-1000, math.ceil(math.log2(extent / across))) if extent > 0 else 0
    side = 2.0**level
    first, last = (np.floor(v / side).astype(np.int64) for v in (low, high))
    width = last - first + 1
    a, b = edges[:, :2] / side - first, edges[:, 2:] / side - first
    touched = np.zeros(width, bool)
    lo, hi = (f(np.floor(a), np.floor(b)).astype(np.int64) for f in (np.minimum, np.maximum))
    counts = (hi - lo + 1).prod(axis=1)
    for part in np.split(np.arange(len(edges)), np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1):
        e = np.repeat(part, counts[part])
        k = np.arange(len(e)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        tall = (hi - lo + 1)[e, 1]
        cx, cy = lo[e, 0] + k // tall, lo[e, 1] + k % tall
        # a line passes a cell if the cell's corners are not all on one side of it
        d = b[e] - a[e]
        off = d[:, 0] * (cy + 0.5 - a[e, 1]) - d[:, 1] * (cx + 0.5 - a[e, 0])
        near = np.abs(off) <= (np.abs(d[:, 0]) + np.abs(d[:, 1])) * (0.5 + 1e-9)
        touched[cx[near], cy[near]] = True
    middle_y = np.arange(width[1]) + 0.5
    inside = np.zeros(width, bool)
    for j in range(width[1]):
        y = middle_y[j]
        cross = (a[:, 1] <= y) != (b[:, 1] <= y)
        at = np.sort(a[cross, 0] + (y - a[cross, 1]) * ((b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1])))
        inside[:, j] = np.searchsorted(at, np.arange(width[0]) + 0.5) % 2 == 1
    cells = np.argwhere(touched | inside)
    return level, cells + first, (inside & ~touched)[cells[:, 0], cells[:, 1]], edges


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for region, ring in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = np.array([(v["x"], v["y"]) for v in ring or () if v and v["x"] is not None and v["y"] is not None], float).reshape(-1, 2)
            if ring is None or len(p) != len(ring) or len(p) < 3 or not np.isfinite(p).all():
                continue
            level, cells, whole, edges = cover(p)
            side = 2.0**level
            rows = []
            for (cx, cy), all_ in zip(cells.tolist(), whole.tolist(), strict=True):
                met: np.ndarray = edges[:0]
                if not all_:  # a ray to the right of a point in the cell meets no other edges
                    y0, y1 = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
                    met = edges[(y1 >= cy * side) & (y0 <= (cy + 1) * side) & (np.maximum(edges[:, 0], edges[:, 2]) >= cx * side)]
                rows.append((region, level, cx, cy, all_, [{"ax": e[0], "ay": e[1], "bx": e[2], "by": e[3]} for e in met.tolist()]))
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["region", "level", "cx", "cy", "whole", "edges"])


def within(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point lies inside edges (even-odd rule) or on one of them."""

    def add(state: Column, e: Column) -> Column:
        at = e["ax"] + (y - e["ay"]) * F.try_divide(e["bx"] - e["ax"], e["by"] - e["ay"])
        crossed = ((y < e["ay"]) != (y < e["by"])) & (x < at)
        side = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        on = (side == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        return F.struct((state["odd"] != F.coalesce(crossed, F.lit(False))).alias("odd"), (state["on"] | on).alias("on"))

    found = F.aggregate(edges, F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on")), add)
    return found["odd"] | found["on"]


@tidy
def points_in_polygons(points: DataFrame, rings: DataFrame) -> DataFrame:
    """``region, id``: the regions (``rings``: region, ring of structs x, y; not closed, any outline) that hold each point (id, x, y), edges included.

    Each ring is cut into cells of its own size, some MOST across, so a huge one
    beside many small ones has no more cells than they. Points meet the cells
    that hold them by one equi-join over the sizes that occur; cells wholly
    inside need no test, the others bring only the edges that a ray from within
    can cross. A point in several regions, or regions of several rings, has a row for each ring. Rings of
    under three vertices or with a null or infinite one hold nothing, and so do points with such a place.
    """
    cells = materialise(rings.select(F.col("region").cast("long").alias("region"), F.col("ring").cast(RING).alias("ring")).mapInArrow(_covered, CELLS))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # powers of two between the least and the greatest ring
    at = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    if not levels:
        return at.select(F.lit(0).cast("long").alias("region"), "id").limit(0)
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.lit(2.0**n).alias("side")) for n in levels)))
    keyed = at.select("id", "x", "y", sides.alias("s")).select("id", "x", "y", "s.level", F.floor(F.col("x") / F.col("s.side")).cast("long").alias("cx"), F.floor(F.col("y") / F.col("s.side")).cast("long").alias("cy"))
    met = keyed.join(cells, ["level", "cx", "cy"])
    return met.filter(F.col("whole") | within(F.col("x"), F.col("y"), F.col("edges"))).select("region", "id")


def _snapped(corners: DataFrame, tolerance: float) -> DataFrame:
    """``x, y, sx, sy``: corners that lie nearer than half the tolerance to each other get one place, the least of them.

    Corners share a cell of one of four grids, each moved by half a cell along an axis or both, so a border between cells parts none.
    """
    now = corners.select("x", "y").distinct().select("x", "y", F.struct("x", "y").alias("s"))
    for dx in (0.0, 0.5):
        for dy in (0.0, 0.5):
            key = [F.floor(F.col("s.x") / tolerance + dx), F.floor(F.col("s.y") / tolerance + dy)]
            now = now.withColumn("s", F.min("s").over(Window.partitionBy(*key)))
    return now.select("x", "y", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))


@tidy
def dissolve(cells: DataFrame, mapped: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``region, part, ring, area``: the outlines of regions made of cells; holes run clockwise and have a negative area.

    ``cells``: id, ring; ``mapped``: cell, region. Cells of a region that share
    an edge bring it in both directions, and these cancel. At a corner where a region
    touches itself each edge goes on with the one that turns most to the left, so contacts at
    corners part rings. Rings find their least edge by jumps of doubled length,
    so the number of rounds grows with the logarithm of the longest ring. Corners that
    differ by less than half of ``tolerance`` are one. Cells of one region with equal rings count once.
    """
    rings = cells.join(mapped, F.col("id") == F.col("cell")).select("region", F.col("ring").cast(RING).alias("ring")).filter(F.size("ring") >= 3).distinct()
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    twice = F.aggregate(F.zip_with("ring", after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    rings = rings.withColumn("ring", F.when(twice < 0, F.reverse("ring")).otherwise(F.col("ring")))
    edges = rings.select("region", F.explode(F.arrays_zip(F.col("ring").alias("a"), after.alias("b"))).alias("e")).select("region", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    if tolerance > 0:
        edges = materialise(edges)
        to = materialise(_snapped(edges.select(F.col("ax").alias("x"), F.col("ay").alias("y")), tolerance))
        for c in "ab":
            own = to.select(F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("sx").alias(f"{c}u"), F.col("sy").alias(f"{c}v"))
            edges = edges.join(own, [f"{c}x", f"{c}y"]).drop(f"{c}x", f"{c}y").withColumnsRenamed({f"{c}u": f"{c}x", f"{c}v": f"{c}y"})
    ahead = F.struct("ax", "ay") < F.struct("bx", "by")
    end = lambda p, q: [F.when(ahead, F.col(f"{p}{d}")).otherwise(F.col(f"{q}{d}")).alias(f"{p}{d}") for d in "xy"]
    net = edges.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).select("region", *end("a", "b"), *end("b", "a"), F.when(ahead, 1).otherwise(-1).alias("way"))
    net = net.groupBy("region", "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).filter("way != 0")
    back = F.col("way") < 0
    turned = net.select("region", *(F.when(back, F.col(f"{q}{d}")).otherwise(F.col(f"{p}{d}")).alias(f"{p}{d}") for p, q in ("ab", "ba") for d in "xy"))
    left = materialise(turned.withColumn("e", F.monotonically_increasing_id()))
    into = left.select("region", "e", F.col("bx").alias("x"), F.col("by").alias("y"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("from"))
    out = left.select("region", F.col("e").alias("next"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("to"))
    turn = F.pmod(F.col("to") - F.col("from") + F.lit(math.pi), F.lit(2 * math.pi))  # 0 is straight back
    follow = into.join(out, ["region", "x", "y"]).groupBy("e").agg(F.max_by("next", turn).alias("next"))
    now = materialise(follow.select("e", F.col("next").alias("ptr"), F.col("e").alias("least")))
    while True:
        there = now.select(F.col("e").alias("ptr"), F.col("ptr").alias("p2"), F.col("least").alias("l2"))
        new = materialise(now.join(there, "ptr").select("e", F.col("p2").alias("ptr"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("less")))
        more = not new.filter("less").isEmpty()
        now = new.drop("less")
        if not more:
            break

    def walk(rows: pa.Table) -> pa.Table:
        ids, nexts = rows["e"].to_pylist(), dict(zip(rows["e"].to_pylist(), rows["next"].to_pylist(), strict=True))
        place = dict(zip(ids, zip(rows["ax"].to_pylist(), rows["ay"].to_pylist(), strict=True), strict=True))
        at, ring = min(ids), []
        for _ in ids:
            ring.append({"x": place[at][0], "y": place[at][1]})
            at = nexts[at]
        return pa.table({"region": rows["region"][:1], "part": pa.array([min(ids)]), "ring": pa.array([ring], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    kind = mapped.schema["region"].dataType.simpleString()
    full = left.join(follow, "e").join(now.select("e", "least"), "e")
    made = full.select("region", "e", "next", "ax", "ay", "least").groupBy("least").applyInArrow(walk, f"region {kind}, part long, ring {RING}")
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    signed = F.aggregate(F.zip_with("ring", after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    area = F.coalesce(ring_area_centroid(F.col("ring"))["area"], F.lit(0.0)) * F.signum(signed)
    numbered = made.withColumn("area", area).withColumn("part", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("area"), "part")).cast("long") - 1)
    return materialise(numbered)
