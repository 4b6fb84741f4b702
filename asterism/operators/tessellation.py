"""Hulls, annuli, Voronoi cells, and the merging of cells into regions with enough stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ring_area_centroid
from ..shared import discard, materialise, tidy
from .neighbours import CUT, cell_levels, nearest

#: Relative to the box: how near a corner must come to another cell's border to touch it.
TOUCH = 1e-9
#: Candidates around a generator in the first round; doubled where they do not settle its cell.
FIRST_CANDIDATES = 24
RING = "array<struct<x:double,y:double>>"


def hull_of(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull of (n, 2) points, counter-clockwise, by the monotone chain; points on edges are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p.tolist()) + half(p[::-1].tolist()))


def convex_hull(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``k, x, y``: vertices in order. Each task keeps the hull of its rows; only those vertices meet."""

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for pdf in parts:
            kept = hull_of(np.vstack([kept, pdf.dropna().to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"k": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    some = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return some.mapInPandas(local, "x double, y double").groupBy(F.lit(0).alias("_")).applyInPandas(final, "k long, x double, y double")


def polygon_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def disc_area(ring: np.ndarray, center: tuple[float, float], r: float) -> float:
    """Area of a disc inside a polygon, convex or not: over its edges, signed triangles where an edge runs inside the disc and signed sectors where it runs outside."""
    p = ring - np.array(center)
    total = 0.0
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        d = b - a
        dd, ad, aa = d @ d, a @ d, a @ a
        if dd == 0:
            continue
        root = ad * ad - dd * (aa - r * r)
        into = out = 0.0  # where the line is in the disc; a line that only touches it never is
        if root > 0:
            into, out = (-ad - math.sqrt(root)) / dd, (-ad + math.sqrt(root)) / dd
        ts = sorted([0.0, 1.0, *(t for t in (into, out) if 0 < t < 1)])
        for s, t in zip(ts, ts[1:], strict=False):
            u, v = a + s * d, a + t * d
            cross = u[0] * v[1] - u[1] * v[0]
            total += cross / 2 if into < (s + t) / 2 < out else r * r / 2 * math.atan2(cross, u @ v)
    return abs(float(total))


def annuli(ring: np.ndarray, center: tuple[float, float], min_area: float, step: float = 1 / 3600, clip: bool = False) -> list[tuple[int, float, float, float, float]]:
    """(group, inner and outer radius, area, area's share of the field) of rings about a centre that hold at least ``min_area`` each.

    Radii grow by ``step`` until the circle holds the field; a circle is kept
    once the part of the field since the last one is large enough. The last ring
    reaches over all the rest of the field (infinite radius). Areas of the
    others are those of whole rings, or with ``clip`` of their parts in the field.
    """
    field = polygon_area(ring)
    reach = float(np.hypot(*(ring - np.array(center)).T).max())
    radii, last, k = [], 0.0, 1
    while (r := k * step) < reach:
        inside = disc_area(ring, center, r)
        if inside - last > min_area:
            radii.append(r)
            last = inside
        k += 1
    edges = [0.0, *radii[:-1], math.inf]
    out = []
    for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False) if radii else ()):
        if math.isinf(b):
            area = field - disc_area(ring, center, a)
        else:
            area = disc_area(ring, center, b) - disc_area(ring, center, a) if clip else math.pi * (b * b - a * a)
        out.append((g, a, b, area, area / field))
    return out


def clip_cell(p: np.ndarray, box: tuple[float, float, float, float], others: np.ndarray) -> np.ndarray:
    """The box cut by the bisectors between ``p`` and ``others`` (nearest first)."""
    x0, x1, y0, y1 = box
    ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    for q in others:
        d = q - p
        if not d.any():
            continue
        side = (ring - (p + q) / 2) @ d
        if (side <= 0).all():
            if d @ d > 4 * ((ring - p) ** 2).sum(axis=1).max():
                break
            continue
        out = []
        for i in range(len(ring)):
            j = (i + 1) % len(ring)
            if side[i] <= 0:
                out.append(ring[i])
            if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
                out.append(ring[i] + (ring[j] - ring[i]) * (side[i] / (side[i] - side[j])))
        ring = np.array(out)
    return ring


def _cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rings, touching, done = [], [], []
        for row in pdf.itertuples(index=False):
            p, box = np.array([row.x, row.y]), (row.x0, row.x1, row.y0, row.y1)
            near = sorted((n["d2"], n["ref"], n["rx"], n["ry"]) for n in row.near)
            others = np.array([n[2:] for n in near], float).reshape(-1, 2)
            ring = clip_cell(p, box, others)
            reach = ((ring - p) ** 2).sum(axis=1).max()
            done.append(bool(row.complete or (near and near[-1][0] > 4 * reach)))
            tol = TOUCH * max(box[1] - box[0], box[3] - box[2])
            gaps = ((ring[:, None] - (p + others) / 2) * (p - others)).sum(axis=2).min(axis=0) if near else ()
            found = [ref for (d2, ref, *_), gap in zip(near, gaps, strict=True) if not d2 or gap / max(math.sqrt(d2), 1e-300) <= tol]
            rings.append([{"x": x, "y": y} for x, y in ring.tolist()])
            touching.append(found)
        yield pd.DataFrame({"id": pdf["id"], "g": pdf["g"], "x": pdf["x"], "y": pdf["y"], "ring": rings, "touches": touching, "done": done})


def _at_every_star(cells: DataFrame, stars: DataFrame) -> DataFrame:
    """Cells of places (``id``: the least there) given to every star at the place; ``touches`` names the least star of each cell around and of the own place, so its size does not grow with crowds."""
    c, s = cells.select(F.col("id").alias("_place"), F.col("g").alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y"), "ring", "touches"), stars
    here = c["_g"].eqNullSafe(s["g"]) & c["_x"].eqNullSafe(s["x"]) & c["_y"].eqNullSafe(s["y"])
    return s.join(c, here).select("id", "g", "x", "y", "ring", F.filter(F.concat("touches", F.array("_place")), lambda e: e != F.col("id")).alias("touches"))


@tidy
def voronoi_cells(points: DataFrame, pad: float = 0.0, max_rounds: int = 60) -> DataFrame:
    """``id, g, x, y, ring, area, touches`` of every generator (``points``: id, g, x, y) within its group's padded bounding box.

    A cell is its box cut by the bisectors with its nearest generators; it is
    settled once the next generator lies over twice as far as its farthest
    corner. Cells that are not go on with twice as many. Groups lie apart on one
    plane, so all are done by the same joins. ``touches``: cells that share an
    edge or a corner. Generators at one place have the same cell, cut once, for
    the least id there; that one stands for them in ``touches`` of all others. Cells that
    ``max_rounds`` leave open raise an error.
    """
    points = materialise(points.select("id", "g", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    stars, place = points, ("g", "x", "y")
    points = materialise(stars.groupBy(*place).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    crowded = not points.filter("n > 1").isEmpty()
    points = points.select("id", *place)
    boxes = points.groupBy("g").agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"), F.count("*").alias("n"))
    low, high, most = points.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not most:
        empty = points.select("*", F.lit(None).cast(RING).alias("ring"), F.lit(0.0).alias("area"), F.lit(None).cast("array<long>").alias("touches"))
        return empty
    apart = 8 * ((high - low) or 1.0) + 8 * pad
    top = boxes.agg(F.max("n"), F.max(F.col("y1") - F.col("y0"))).first()
    apart = max(apart, 8 * (top[1] or 1.0))
    islands = points.select("id", (F.col("x") + F.col("g") * apart).alias("x"), "y")
    at = points.select(F.col("id").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("g").alias("rg"))
    todo, k, parts = points, FIRST_CANDIDATES, []
    for _ in range(max_rounds):
        asked = todo.select("id", (F.col("x") + F.col("g") * apart).alias("x"), "y")
        near = nearest(asked, islands, k + 1).filter("id != ref").join(at, "ref")
        gathered = near.select("id", "rg", F.struct("d2", "ref", "rx", "ry").alias("s")).groupBy("id").agg(F.collect_list(F.struct(F.col("rg"), F.col("s"))).alias("near"))
        rows = todo.join(boxes, "g").join(gathered, "id", "left")
        own = F.coalesce(F.transform(F.filter("near", lambda e: e["rg"] == F.col("g")), lambda e: e["s"]), F.array().cast("array<struct<d2:double,ref:bigint,rx:double,ry:double>>"))
        rows = rows.select("id", "g", "x", "y", "x0", "x1", "y0", "y1", own.alias("near"), (F.size(own) >= F.col("n") - 1).alias("complete"))
        made = materialise(rows.mapInPandas(_cells, f"id long, g long, x double, y double, ring {RING}, touches array<long>, done boolean"))
        parts.append(made.filter("done"))
        left = made.filter("not done").select("id", "g", "x", "y")
        if left.isEmpty():
            break
        if k >= top[0]:
            raise RuntimeError("cells did not settle against all others")
        todo, k = left, 2 * k
    else:
        raise RuntimeError(f"cells did not settle in {max_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if crowded:
        out = _at_every_star(out, stars)
    return out.select("id", "g", "x", "y", "ring", F.coalesce(ring_area_centroid(F.col("ring"))["area"], F.lit(0.0)).alias("area"), "touches")


def adjacency(cells: DataFrame) -> DataFrame:
    """``i, j`` with i < j: cells that touch, seen from either side; of several stars at one place, cells touch the least, and so do the others there.

    Merging comes out as if all of them touched all: the least star of a place is
    asked before the others there, and takes them with it or is taken with them.
    """
    pairs = cells.select(F.col("id").alias("a"), F.explode("touches").alias("b"))
    return pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).filter("i != j").distinct()


def centroids(cells: DataFrame) -> DataFrame:
    """``id, g, x, y`` at the cells' centroids; a cell without area keeps its generator."""
    c = ring_area_centroid(F.col("ring"))
    return cells.select("id", "g", F.coalesce(c["cx"], "x").alias("x"), F.coalesce(c["cy"], "y").alias("y"))


@tidy
def centroidal(points: DataFrame, rounds: int = 1, pad: float = 0.0) -> DataFrame:
    """Cells after ``rounds`` of Lloyd's method: one gives the cells of the points themselves, each more moves generators to centroids first."""
    if rounds < 1:
        raise ValueError("at least one round")
    cells = voronoi_cells(points, pad)
    for _ in range(rounds - 1):
        cells = voronoi_cells(centroids(cells), pad)
    return cells


@tidy
def merge_regions(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, parent``: regions in order of (area, id); each that no earlier one has absorbed absorbs its free neighbours.

    Equal to the greedy order, but in parallel rounds: a region becomes a seed
    when it is least among its undecided neighbours, whose decisions follow.
    Every round settles at least the least region; rounds grow with the
    logarithm of the regions unless long chains lie in order of area.
    ``areas``: id, area; ``edges``: i, j.
    """
    both = materialise(edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select(F.col("j").alias("a"), F.col("i").alias("b"))).distinct())
    ranked = materialise(areas.select("id", F.struct("area", "id").alias("r")))
    open_, seeds = ranked, None
    while not open_.isEmpty():
        near = both.join(open_.select(F.col("id").alias("b"), "r"), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("low"))
        new = materialise(open_.join(near, "id", "left").filter(F.col("low").isNull() | (F.col("r") < F.col("low"))).select("id", "r"))
        seeds = new if seeds is None else seeds.union(new)
        gone = new.select("id").union(both.join(new.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"))).distinct()
        open_ = materialise(open_.join(gone, "id", "left_anti"))
    if seeds is None:
        return areas.select("id", F.col("id").alias("parent"))
    taken = both.join(seeds.select(F.col("id").alias("b"), "r"), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
    absorbed = taken.join(seeds.select("id"), "id", "left_anti").select("id", F.col("r.id").alias("parent"))
    return materialise(seeds.select("id", F.col("id").alias("parent")).union(absorbed))


@tidy
def dilate(cells: DataFrame, edges: DataFrame, assigned: DataFrame, target_median: float) -> DataFrame:
    """``cell, region``: cells merged, at least once, until the median of distinct stars per non-empty region reaches the target.

    ``cells``: id, area; ``assigned``: id of star, region = cell. Stops as well
    when a round merges nothing.
    """
    areas = cells.select("id", "area")
    mapped = cells.select(F.col("id").alias("cell"), F.col("id").alias("region"))
    while True:
        merged = merge_regions(areas, edges)
        mapped = materialise(mapped.join(merged, mapped["region"] == merged["id"]).select("cell", F.col("parent").alias("region")))
        before, after = areas.count(), mapped.select("region").distinct().count()
        per = assigned.join(mapped.withColumnRenamed("region", "_r"), assigned["region"] == F.col("cell")).groupBy("_r").agg(F.count_distinct(assigned["id"]).alias("n"))
        median = per.agg(F.percentile("n", 0.5)).first()[0]
        if (median is not None and median >= target_median) or after == before or after <= 1:
            break
        areas = materialise(areas.join(merged, "id").groupBy(F.col("parent").alias("id")).agg(F.sum("area").alias("area")))
        a, b = merged.select(F.col("id").alias("i"), F.col("parent").alias("pi")), merged.select(F.col("id").alias("j"), F.col("parent").alias("pj"))
        edges = materialise(edges.join(a, "i").join(b, "j").filter("pi != pj").select(F.least("pi", "pj").alias("i"), F.greatest("pi", "pj").alias("j")).distinct())
    return mapped


def _local_means(seed: int):
    """Weighted k-means of the places of one part of the plane; ``k`` of them, in each row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, k = pdf[["x", "y"]].to_numpy(float), pdf["w"].to_numpy(float), int(pdf["k"].iloc[0])
        order = np.lexsort(x.T)
        x, w = x[order], w[order]
        rng = np.random.default_rng([seed, len(x), k])
        near, c = np.full(len(x), np.inf), np.empty((k, 2))
        for i in range(k):
            chance = w * np.where(np.isinf(near), 1.0, near)
            c[i] = x[rng.choice(len(x), p=chance / chance.sum()) if chance.sum() > 0 else i % len(x)]
            near = np.minimum(near, ((x - c[i]) ** 2).sum(axis=1))
        for _ in range(20):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            total = np.bincount(own, w, k)
            for d in (0, 1):
                c[:, d] = np.where(total > 0, np.bincount(own, w * x[:, d], k) / np.where(total > 0, total, 1), c[:, d])
        head = {name: pdf[name].iloc[0] for name in ("level", "cx", "cy")}
        return pd.DataFrame(head | {"i": np.arange(k), "x": c[:, 0], "y": c[:, 1]})

    return run


@tidy
def kmeans_centroids(points: DataFrame, points_per_bin: int | None = None, bins: int | None = None, seed: int = 0, weight: str = "weight", part: int = 2000, rounds: int = 5) -> DataFrame:
    """``id, g, x, y``: centres of weighted k-means, rows over ``points_per_bin`` of them if it is given (one at least), else ``bins``; no more than places.

    The plane is split by counts into cells of at most ``part`` places, and the
    centres are dealt to them by their share of the places, so that their number
    is exact: each cell gets the whole numbers that its stretch of the running
    share passes, perhaps none. Each cell seeds its centres in a task of its
    own; then ``rounds`` of Lloyd's method move all over the whole plane, by a nearest-centre
    join and one aggregate each. No task and no driver holds all centres; one
    task sees a row for each cell. Rows at one place weigh together; rows of weight 0 have no part.
    """
    if points_per_bin is None and bins is None:
        raise ValueError("either points_per_bin or bins")
    held = points.filter(F.col(weight) > 0)
    places = materialise(held.groupBy("x", "y").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    total, count, x0, x1, y0, y1 = places.agg(F.sum("n"), F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not total:
        return points.select("id", "g", "x", "y").limit(0)
    k = min(count, max(1, round(total / points_per_bin)) if points_per_bin else bins)
    side = (max(x1 - x0, y1 - y0) or 1.0) * (1 + 1e-9)  # the whole plane is one cell at level 0
    near = places.select("id", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"))
    dealt = cell_levels(near, near.select(F.col("x").alias("rx"), F.col("y").alias("ry")), side, part)
    width = F.lit(side) / F.pow(F.lit(float(CUT)), F.col("level"))
    cells = dealt.select("id", "level", F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"))
    cells = materialise(cells.join(places.select("id", "x", "y", "w"), "id"))
    key = ["level", "cx", "cy"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("m"))
    until = F.sum("m").over(Window.orderBy(*key))
    passed = lambda c: F.expr(f"({c} * {k}) div {count}")
    shares = sizes.withColumn("to", until).withColumn("since", F.col("to") - F.col("m")).select(*key, (passed("to") - passed("since")).cast("int").alias("k")).filter("k > 0")
    seeded = cells.join(shares, key).groupBy(*key).applyInPandas(_local_means(seed), "level int, cx long, cy long, i int, x double, y double")
    centres = materialise(seeded.select(F.xxhash64(*key, "i").alias("id"), "x", "y"))
    several = not shares.agg(F.count("*").alias("c")).filter("c > 1").isEmpty() or sizes.count() > 1
    for _ in range(rounds if several else 0):
        own = nearest(places.select("id", "x", "y"), centres, 1).select("id", "ref").join(places.select("id", "x", "y", "w"), "id")
        mean = own.groupBy(F.col("ref").alias("id")).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in "xy"))
        centres = materialise(centres.join(mean, "id", "left").select("id", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y")))
    return centres.select("id", F.lit(0).cast("long").alias("g"), "x", "y")


@tidy
def region_grid(points: DataFrame, which: str = "dilation", rounds: int = 1, pad: float = 0.0, target_median: float | None = None, points_per_bin: int = 20) -> tuple[DataFrame, DataFrame]:
    """Cells and (cell, region) of a grid that adapts to stars (``points``: id, g, x, y; wkmeans: also weight).

    ``dilation`` starts from the stars' own cells, ``wkmeans`` from those of
    weighted k-means centres; both are merged if a target is given.
    """
    if which not in ("dilation", "wkmeans"):
        raise ValueError(f"no grid {which}")
    generators = points if which == "dilation" else kmeans_centroids(points, points_per_bin)
    cells = centroidal(generators, rounds, pad)
    if target_median is None:
        return cells, cells.select(F.col("id").alias("cell"), F.col("id").alias("region"))
    assigned = nearest(points, cells, 1, ties=True).select("id", F.col("ref").alias("region"))
    return cells, dilate(cells, adjacency(cells), assigned, target_median)

