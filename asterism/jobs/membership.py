"""Statistical membership: reddening correction and field subtraction in turn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.expressions import Reddening, inside_polygon, sky_separation
from ..operators import decontamination, neighbours, splines, statistics, tessellation
from ..shared import materialise, tidy


def spatial_groups(cluster: DataFrame, field: DataFrame, min_stars: int = 200, clip: bool = False) -> tuple[DataFrame, list[tuple]]:
    """``star_id, g`` of the cluster's stars and the rings (see ``tessellation.annuli``) about the middle of its field.

    Each ring has area for ``min_stars`` at the mean density of ``field`` (ra,
    dec): its stars over the circle that reaches its farthest one. Stars on a
    border, corners of the cluster's hull among them, are in no group.
    """
    mid = lambda c: F.min(c) + (F.max(c) - F.min(c)) / 2
    (ra, dec), (f_ra, f_dec) = (df.agg(mid("ra"), mid("dec")).first() for df in (cluster, field))
    none = cluster.select("star_id", F.lit(0).cast("long").alias("g")).limit(0)
    if ra is None or f_ra is None:
        return none, []
    n, reach = field.agg(F.count("*"), F.max(sky_separation(F.lit(f_ra), F.lit(f_dec), F.col("ra"), F.col("dec")))).first()
    ring = np.array([(r["x"], r["y"]) for r in tessellation.convex_hull(cluster, "ra", "dec").orderBy("k").collect()])
    if len(ring) < 3 or not reach:
        return none, []
    min_area = min_stars / (n / (np.pi * reach * reach)) / 3600**2
    rings = tessellation.annuli(ring, (ra, dec), float(min_area), clip=clip)
    d = F.sqrt((F.col("ra") - ra) ** 2 + (F.col("dec") - dec) ** 2)
    borders = F.array(*(F.lit(low) for _, low, *_ in rings)).cast("array<double>")  # each ring begins where the one before ends
    passed = F.when(~F.array_contains(borders, d), F.size(F.filter(borders, lambda b: b < d)).cast("long"))
    inside = (passed < len(rings)) | inside_polygon(F.col("ra"), F.col("dec"), [tuple(map(float, p)) for p in ring])
    group = F.when((passed > 0) & inside, passed - 1)
    return cluster.select("star_id", group.alias("g")).filter("g is not null"), rings


@tidy
def differential_reddening(stars: DataFrame, dr: Reddening, roi: list[tuple[float, float]], nref: int, step: float, threshold: float, limited: bool) -> DataFrame:
    """``star_id, band1, band2, delta_e`` after one correction (``stars``: star_id, x, y, band1, band2, membership, delta_ebv).

    Members in the region of interest give the ridge line; every star moves by
    the clipped median residual of its nearest members. With ``limited`` only
    corrections of over two deviations apply, to stars corrected before.
    """
    rx, ry = dr.rotate(F.col("band1"), F.col("band2"))
    rotated = materialise(stars.select("star_id", "x", "y", "band1", "band2", "delta_ebv", "membership", rx.alias("rx"), ry.alias("ry")))
    refs = rotated.filter(F.col("membership") > threshold).filter(inside_polygon(F.col("rx"), F.col("ry"), roi))
    knots = sorted((r["ordinate"], r["abscissa"]) for r in statistics.binned_medians(refs, "ry", "rx", step).collect())
    if len(knots) < 2 or refs.count() < nref + 1:
        raise ValueError("too few reference stars for a ridge line")
    ridge = splines.evaluate(F.col("ry"), *splines.fit([k[0] for k in knots], [k[1] for k in knots]))
    residuals = refs.select(F.col("star_id").alias("ref"), (F.col("rx") - ridge).alias("residual"))
    at = lambda df: df.select(F.col("star_id").alias("id"), "x", "y")
    near = neighbours.nearest(at(rotated), at(refs), nref + 1).filter("rank > 1").join(residuals, "ref")
    shift = neighbours.clipped_medians(near, "id", "residual").select(F.col("id").alias("star_id"), F.col("median").alias("shift"))
    b1, b2, de = dr.corrected(F.col("band1"), F.col("band2"), F.col("shift"))
    moved = materialise(rotated.join(shift, "star_id").select("star_id", "band1", "band2", "delta_ebv", b1.alias("new1"), b2.alias("new2"), de.alias("delta_e")))
    if not limited:
        return moved.select("star_id", F.col("new1").alias("band1"), F.col("new2").alias("band2"), "delta_e")
    limit = 2 * (moved.agg(F.stddev_pop("delta_e")).first()[0] or 0.0)
    use = (F.abs("delta_e") > limit) & (F.col("delta_ebv") != 0)
    pick = lambda a, b: F.when(use, F.col(a)).otherwise(F.col(b))
    return moved.select("star_id", pick("new1", "band1").alias("band1"), pick("new2", "band2").alias("band2"), F.when(use, F.col("delta_e")).otherwise(0.0).alias("delta_e"))


def _within(points: DataFrame, boxes: DataFrame, apart: float) -> DataFrame:
    """``id, star, g, x, y`` of the points (id, g, x, y) within their group's box; groups lie apart on one plane."""
    inside = points.join(boxes, "g").filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.select(F.xxhash64("id", "g").alias("id"), F.col("id").alias("star"), "g", (F.col("x") + F.col("g") * apart).alias("x"), "y")


def _cell_counts(points: DataFrame, generators: DataFrame, boxes: DataFrame, apart: float) -> DataFrame:
    """``region, n``: points in the cell of each generator of their group, on shared edges in each; they are counted alone, so none is looked up again."""
    islands = generators.select("id", (F.col("x") + F.col("g") * apart).alias("x"), "y")
    found = neighbours.nearest(_within(points, boxes, apart).select("id", "x", "y"), islands, 1, ties=True)
    return decontamination.region_counts(found.select(F.col("ref").alias("region")))


def _own_cells(stars: DataFrame, boxes: DataFrame, apart: float) -> DataFrame:
    """``id, region``: the cells of the stars themselves, which are those of all stars at their places."""
    here = _within(stars, boxes, apart).filter(~F.isnan("x") & ~F.isnan("y")).select("star", "x", "y")
    return here.withColumnRenamed("star", "id").join(here.withColumnRenamed("star", "region"), ["x", "y"]).select("id", "region")


METRICS = "iteration long, stars long, grouped long, members long, membership double, corrected long, delta_ebv double"


def _watched(state: DataFrame, iteration: int, metrics: list[dict] | None) -> DataFrame:
    """``state``, written; what METRICS names is counted by the same pass."""
    if metrics is None:
        return materialise(state)
    seen = Observation()
    found = materialise(state.observe(
        seen, F.count(F.lit(1)).alias("stars"), F.count("g").alias("grouped"), F.coalesce(F.sum((F.col("membership") > 0.5).cast("long")), F.lit(0).cast("long")).alias("members"), F.avg("membership").alias("membership"),
        F.coalesce(F.sum((F.col("delta_ebv") != 0).cast("long")), F.lit(0).cast("long")).alias("corrected"), F.avg(F.abs("delta_ebv")).alias("delta_ebv"),
    ))
    metrics.append({"iteration": iteration} | seen.get)
    return found


@tidy
def statistical_membership(
    cluster: DataFrame, field: DataFrame, dr: Reddening, roi: list[tuple[float, float]], nref: int = 20, step: float = 0.1, threshold: float = 0.9,
    iterations: int = 3, min_stars: int = 200, pad: float = 0.0, target_median: float | None = None, fov_multiplier: float = 1.0, method: str = "expected", draws: int = 1000, seed: int = 0, metrics: list[dict] | None = None,
) -> DataFrame:
    """``star_id, g, band1, band2, delta_ebv, membership`` of every cluster star.

    ``cluster``: star_id, ra, dec, x, y, band1, band2; ``field``: star_id, ra,
    dec, band1, band2. All groups are worked on together in each iteration; state is
    written to the shared folder between iterations. ``expected`` gives the mean
    of the random subtraction, ``montecarlo`` draws it, seeded; there, stars
    that are never drawn keep their membership, as do those in no group. To
    ``metrics`` each iteration adds a row of METRICS, gathered while its state is written.
    """
    if method not in ("expected", "montecarlo"):
        raise ValueError(f"no method {method}")
    groups, rings = spatial_groups(cluster, field, min_stars)
    state = materialise(cluster.join(groups, "star_id", "left").select("star_id", "x", "y", "band1", "band2", "g", F.lit(0.0).alias("delta_ebv"), F.lit(1.0).alias("membership")))
    ratio = F.get(F.array(*(F.lit(share * fov_multiplier) for *_, share in rings)).cast("array<double>"), F.col("g").cast("int"))
    for k in range(iterations):
        fixed = differential_reddening(state, dr, roi, nref, step, threshold, limited=k > 0)
        new = fixed.select("star_id", F.col("band1").alias("n1"), F.col("band2").alias("n2"), "delta_e")
        state = state.join(new, "star_id", "left").select("star_id", "x", "y", F.coalesce("n1", "band1").alias("band1"), F.coalesce("n2", "band2").alias("band2"), "g", (F.col("delta_ebv") + F.coalesce("delta_e", F.lit(0.0))).alias("delta_ebv"), "membership")
        state = _watched(state, k, None if rings else metrics)
        if rings:
            state = _watched(_subtract(state, field, rings, ratio, pad, target_median, method, draws, seed + k), k, metrics)
    return state.select("star_id", "g", "band1", "band2", "delta_ebv", "membership")


@tidy
def _subtract(state: DataFrame, field: DataFrame, rings: list[tuple], ratio, pad: float, target_median, method: str, draws: int, seed: int) -> DataFrame:
    """One field subtraction in all groups."""
    stars = materialise(state.filter("g is not null").select(F.col("star_id").alias("id"), "g", (F.col("band1") - F.col("band2")).alias("x"), F.col("band1").alias("y")))
    boxes = stars.groupBy("g").agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))
    low, high, bottom, top = stars.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if low is None:
        return state
    apart = 8 * (high - low + top - bottom + 2 * pad + 1)
    every = F.array(*(F.lit(g).cast("long") for g, *_ in rings))
    points = field.select(F.col("star_id").alias("id"), F.explode(every).alias("g"), (F.col("band1") - F.col("band2")).alias("x"), F.col("band1").alias("y"))
    in_field, in_cluster = _cell_counts(points, stars, boxes, apart), _own_cells(stars, boxes, apart)
    owner = stars.select(F.col("id").alias("region"), "g")
    if target_median is not None:
        cells = tessellation.voronoi_cells(stars, pad)
        merged = tessellation.dilate(cells, tessellation.adjacency(cells), in_cluster, target_median)
        in_field = in_field.withColumnRenamed("region", "cell").join(merged, "cell").groupBy("region").agg(F.sum("n").alias("n"))
        in_cluster = in_cluster.withColumnRenamed("region", "cell").join(merged, "cell").select("id", "region").distinct()
    rates = in_field.join(owner, "region").select("region", (F.col("n") * ratio).alias("rate"))
    new = decontamination.expected_membership(rates, in_cluster) if method == "expected" else decontamination.sampled_membership(rates, in_cluster, draws, seed)
    return decontamination.update_membership(state.withColumnRenamed("star_id", "id"), new).withColumnRenamed("id", "star_id")
