from collections import Counter
import math
import random
import time

import numpy as np
import pytest
from asterism.functions.expressions import inside_polygon, ring_area_centroid
from asterism.operators import neighbours, splines, tessellation as t
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


def points(spark, rows):
    return spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, g long, x double, y double")


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=3, max_size=40))
def test_hull_holds_all_points(pts):
    h = t.hull_of(np.array(pts, float))
    if len(h) < 3:
        return
    for (ax, ay), (bx, by) in zip(h, np.roll(h, -1, axis=0), strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in pts)
    assert {tuple(v) for v in h} <= set(pts)


def test_hull_over_tasks(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(500, 2))
    got = t.convex_hull(points(spark, p).repartition(7)).orderBy("k").collect()
    assert np.allclose([(r["x"], r["y"]) for r in got], t.hull_of(p))
    assert t.convex_hull(points(spark, p).limit(0)).count() == 0


@pytest.mark.parametrize("r", [0.1, 0.5, 0.7, 1.0, 5.0])
def test_disc_in_square(r):
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    xs = (np.arange(1500) + 0.5) / 1500
    want = (((xs[:, None] - 0.3) ** 2 + (xs[None] - 0.6) ** 2) <= r * r).mean()
    assert t.disc_area(square, (0.3, 0.6), r) == pytest.approx(want, abs=2e-3)


def test_disc_that_touches_the_middle_of_edges():
    square = np.array([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])
    assert t.disc_area(square, (0.0, 0.0), 1.0) == pytest.approx(math.pi)
    assert t.disc_area(square, (2.0, 0.0), 1.0) == pytest.approx(0.0)


def test_disc_in_a_concave_field():
    """Against a fine grid of points, with the centre inside, in the notch and far outside."""
    ring = np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])
    grid = (np.arange(1600) + 0.5) / 400
    x, y = (v.ravel() for v in np.meshgrid(grid, grid))
    inside = y < np.where(x < 2, 4 - 1.5 * x, 1.5 * x - 2)
    for way in (1, -1):
        for center in ((1.0, 1.0), (2.0, 3.0), (2.0, 0.9), (-1.0, 2.0)):
            far = np.hypot(x - center[0], y - center[1])
            for r in (0.3, 1.0, 2.2, 3.5, 9.0):
                assert t.disc_area(ring[::way], center, r) == pytest.approx((inside & (far < r)).sum() / 400**2, abs=0.01)


def test_annuli_cover_the_field():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    rings = t.annuli(square, (0.5, 0.5), 0.05, step=0.01, clip=True)
    assert len(rings) > 5 and math.isinf(rings[-1][2])
    assert sum(r[3] for r in rings) == pytest.approx(1.0)
    assert all(r[3] > 0.05 for r in rings)
    assert t.annuli(square, (0.5, 0.5), 2.0, step=0.01) == []


def test_polygon_is_strict_and_centroid(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    cases = {(1.0, 1.0): True, (2.0, 3.0): False, (0.0, 1.0): False, (4.0, 4.0): False, (2.0, 2.0): False, (3.9, 3.7): True, (5.0, 2.0): False, (2.0, 1.99): True}
    df = points(spark, cases)
    assert [r["i"] for r in df.select("id", inside_polygon(F.col("x"), F.col("y"), ring).alias("i")).orderBy("id").collect()] == list(cases.values())
    tri = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 0), (0, 3))))
    r = spark.range(1).select(ring_area_centroid(tri).alias("r")).first()["r"]
    assert (r["area"], r["cx"], r["cy"]) == (4.5, 1.0, 1.0)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_against_all_pairs(spark, k):
    rng = np.random.default_rng(1)
    refs = np.vstack([rng.normal(size=(150, 2)) * 0.01, rng.normal(size=(60, 2)) * 20, [[0.5, 0.5]] * 3])
    asked = np.vstack([rng.normal(size=(40, 2)) * 10, refs[:20], [[500.0, -500.0]]])
    got = {}
    for r in neighbours.nearest(points(spark, asked).drop("g"), points(spark, refs).drop("g"), k).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["ref"]))
    for i, p in enumerate(asked):
        d = ((refs - p) ** 2).sum(axis=1)
        order = sorted(range(len(refs)), key=lambda j: (d[j], j))[:k]
        assert [j for _, j in sorted(got[i])] == order
    few = neighbours.nearest(points(spark, asked[:3]).drop("g"), points(spark, refs[:2]).drop("g"), 5).collect()
    assert len(few) == 6
    assert neighbours.nearest(points(spark, asked).limit(0), points(spark, refs), 2).count() == 0


def test_crowded_catalogues_take_no_longer(spark):
    rng = np.random.default_rng(3)
    n, k = 20_000, 6
    wide = rng.uniform(0, 1000, (n, 2))
    core = np.vstack([rng.normal(500, 0.3, (n - n // 100 - 200, 2)), rng.uniform(0, 1000, (n // 100, 2)), [[500.0, 500.0]] * 200])
    took = []
    for place in (wide[:500], wide, core):
        df = points(spark, place).drop("g").cache()
        begun = time.perf_counter()
        found = neighbours.nearest(df, df, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref"))).alias("r")).collect()
        took.append(time.perf_counter() - begun)
        assert len(found) == len(place)
        for row in random.Random(1).sample(found, 300):
            d = ((place - place[row["id"]]) ** 2).sum(axis=1)
            assert [e["ref"] for e in row["r"]] == np.lexsort((np.arange(len(d)), d))[:k].tolist()
        df.unpersist()
    assert took[2] < 2 * took[1] + 5, took


def test_a_crowd_far_from_the_points_and_blocks_that_many_ask_for(spark, monkeypatch):
    """A directory of several levels over small blocks, several parts of the curve, places in one cell of it, points that all ask the same blocks, and ties across blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "POINTS", 50)
    rng = np.random.default_rng(9)
    crowd = np.vstack([rng.random((900, 2)) * 1e-3 + 3, rng.random((60, 2)) * 1e-13 + 5, [[1e6, -1e6]], np.stack(np.meshgrid(range(9), range(9)), -1).reshape(-1, 2) + 10.0])
    asked = np.vstack([rng.random((400, 2)), [[14.0, 14.0], [14.5, 14.5], [1e7, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]]])
    refs = points(spark, crowd).drop("g")
    for k, ties in ((1, True), (5, True), (6, False)):
        got = {}
        for r in neighbours.nearest(points(spark, asked).drop("g"), refs, k, ties=ties).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["ref"]))
        assert len(got) == 403
        for i in got:
            d = ((crowd - asked[i]) ** 2).sum(axis=1)
            if ties:
                last = np.sort(d)[k - 1]
                assert sorted(j for _, j in got[i]) == np.flatnonzero(d <= last).tolist()
            else:
                assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(len(d)), d))[:k].tolist()


def test_a_crowd_apart_is_met_in_part_alone(spark):
    rng = np.random.default_rng(0)
    took = []
    for n in (500, 2_000, 16_000):
        apart, far = points(spark, rng.random((n, 2))).drop("g"), points(spark, rng.random((n, 2)) * 1e-3 + 3).drop("g")
        begun = time.perf_counter()
        assert neighbours.nearest(apart, far, 6).count() == 6 * n
        took.append(time.perf_counter() - begun)
    assert took[2] < 4 * took[1] + 4, took


def test_all_ties_at_a_crowded_place(spark):
    refs = points(spark, [(1, 1)] * 40 + [(3, 1)] * 30 + [(9, 9)]).drop("g")
    got = neighbours.nearest(points(spark, [(2, 1), (1, 1)]).drop("g"), refs, 1, ties=True).collect()
    assert sorted((r["id"], r["ref"]) for r in got) == [(0, i) for i in range(70)] + [(1, i) for i in range(40)] and {r["rank"] for r in got} == {1}


def test_cells_fill_the_box_and_know_their_neighbours(spark):
    rng = random.Random(4)
    pts = [(rng.random(), rng.random()) for _ in range(120)] + [(0.5 + 1e-4 * i, 0.5) for i in range(30)]
    cells = t.voronoi_cells(points(spark, pts), 0.05)
    rows = {r["id"]: r for r in cells.collect()}
    xs, ys = zip(*pts, strict=True)
    box = (max(xs) - min(xs) + 0.1) * (max(ys) - min(ys) + 0.1)
    assert len(rows) == len(pts) and sum(r["area"] for r in rows.values()) == pytest.approx(box)
    assert all(i in rows[j]["touches"] for i, r in rows.items() for j in r["touches"])
    for _ in range(300):
        q = np.array([rng.uniform(min(xs), max(xs)), rng.uniform(min(ys), max(ys))])
        near = min(rows, key=lambda i: (rows[i]["x"] - q[0]) ** 2 + (rows[i]["y"] - q[1]) ** 2)
        ring = np.array([(p["x"], p["y"]) for p in rows[near]["ring"]])
        nxt = np.roll(ring, -1, axis=0) - ring
        assert ((nxt[:, 0] * (q - ring)[:, 1] - nxt[:, 1] * (q - ring)[:, 0]) >= -1e-9).all()


def test_corner_contact_counts(spark):
    cells = t.voronoi_cells(points(spark, [(0, 0), (1, 0), (0, 1), (1, 1)]), 0.5)
    assert t.adjacency(cells).count() == 6


def test_merging_equals_the_greedy_order(spark):
    rng = random.Random(7)
    areas = {i: rng.choice([1.0, 2.0, 3.0]) + (i % 7) / 10 for i in range(60)}
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)}
    nbrs = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in areas}
    want = {}
    for i in sorted(areas, key=lambda i: (areas[i], i)):
        if i not in want:
            want[i] = i
            for j in nbrs[i]:
                want.setdefault(j, i)
    got = t.merge_regions(spark.createDataFrame(list(areas.items()), "id long, area double"), spark.createDataFrame(list(edges), "i long, j long"))
    assert {r["id"]: r["parent"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_spline_is_exact_for_cubics_and_goes_through_knots(spark, n):
    y = sorted(random.Random(n).sample(range(100), n))
    y = [v / 10 for v in y]
    f = lambda v: 1 - 2 * v + (0.5 * v * v if n > 2 else 0) - (0.1 * v**3 if n > 3 else 0)
    starts, coef = splines.fit(y, [f(v) for v in y])
    at = [-1.0, *y, 4.4, 12.0]
    df = spark.createDataFrame([(v,) for v in at], "y double").select("y", splines.evaluate(F.col("y"), starts, coef).alias("x"))
    for r in df.collect():
        assert r["x"] == pytest.approx(f(r["y"]), rel=1e-6, abs=1e-6)
    with pytest.raises(ValueError):
        splines.fit([1.0, 1.0], [0.0, 1.0])


def test_crowded_places_keep_all_cells(spark):
    pts = [(0.5, 0.5)] * 60 + [(0, 0), (1, 0), (0, 1), (1, 1)]
    rows = {r["id"]: r for r in t.voronoi_cells(points(spark, pts), 0.1, max_rounds=1).collect()}
    assert sorted(rows) == list(range(64))
    assert {r["area"] for i, r in rows.items() if i < 60} == {rows[0]["area"]} and rows[0]["area"] > 0
    assert sorted(rows[7]["touches"]) == [0, 60, 61, 62, 63] and sorted(rows[0]["touches"]) == [60, 61, 62, 63] and 0 in rows[60]["touches"]
    assert sum(len(r["touches"]) for r in rows.values()) < 8 * 64


def test_merging_with_crowded_places_equals_the_greedy_order(spark):
    """As if each star touched all stars of its own place and of the cells around."""
    rng = random.Random(12)
    places = [(rng.random(), rng.random()) for _ in range(25)]
    at = [k for k in range(25) for _ in range(rng.choice([1, 1, 3, 20]))]
    rng.shuffle(at)
    cells = t.voronoi_cells(points(spark, [places[k] for k in at]), 0.1)
    rows = {r["id"]: r for r in cells.collect()}
    least = {k: at.index(k) for k in set(at)}
    around = {k: {at[j] for j in rows[least[k]]["touches"]} | {k} for k in least}
    want = {}
    for i in sorted(rows, key=lambda i: (rows[i]["area"], i)):
        if i not in want:
            want[i] = i
            for j in range(len(at)):
                if at[j] in around[at[i]]:
                    want.setdefault(j, i)
    got = t.merge_regions(cells.select("id", "area"), t.adjacency(cells)).collect()
    assert {r["id"]: r["parent"] for r in got} == want and len(set(want.values())) > 3


def test_open_cells_are_an_error(spark):
    ring = [(np.cos(a), np.sin(a)) for a in np.linspace(0, 6.2, 80)]
    with pytest.raises(RuntimeError):
        t.voronoi_cells(points(spark, [(0, 0), *ring]), 0.1, max_rounds=1)


def test_lloyd_moves_to_centroids(spark):
    """Centroids by counting the points of a fine grid."""
    rng = np.random.default_rng(11)
    p, pad, side = rng.random((40, 2)), 0.1, 1200
    axis = [(np.arange(side) + 0.5) / side * (np.ptp(p[:, d]) + 2 * pad) + p[:, d].min() - pad for d in (0, 1)]
    grid = np.stack(np.meshgrid(*axis, indexing="ij"), -1).reshape(-1, 2)
    own, best = np.zeros(len(grid), int), np.full(len(grid), np.inf)
    for i, q in enumerate(p):
        d = ((grid - q) ** 2).sum(axis=1)
        own[d < best], best = i, np.minimum(d, best)
    want = np.stack([np.bincount(own, grid[:, d]) / np.bincount(own) for d in (0, 1)], 1)
    got = {r["id"]: (r["x"], r["y"]) for r in t.centroidal(points(spark, p), 2, pad).collect()}
    assert np.allclose([got[i] for i in range(40)], want, atol=2e-3)
    with pytest.raises(ValueError):
        t.centroidal(points(spark, p), 0)


@pytest.mark.parametrize("target", [1.0, 1e9])
def test_dilation_against_a_plain_loop(spark, target):
    rng = random.Random(13)
    area = {i: rng.choice([1.0, 2.0]) + i % 5 / 10 for i in range(50)}
    edges = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(80)}
    stars = [(s, rng.randrange(50)) for s in range(60)] + [(s, rng.randrange(50)) for s in range(10)]
    region, live, links = {i: i for i in area}, dict(area), set(edges)
    while True:
        parent = {}
        for i in sorted(live, key=lambda i: (live[i], i)):
            if i not in parent:
                parent[i] = i
                for a, b in links:
                    if i in (a, b):
                        parent.setdefault(b if a == i else a, i)
        region = {c: parent[r] for c, r in region.items()}
        held = {}
        for s, c in stars:
            held.setdefault(region[c], set()).add(s)
        before, after = len(live), len(set(region.values()))
        if np.median([len(v) for v in held.values()]) >= target or after == before or after <= 1:
            break
        live = {r: sum(v for i, v in live.items() if parent[i] == r) for r in set(parent.values())}
        links = {tuple(sorted((parent[a], parent[b]))) for a, b in links if parent[a] != parent[b]}
    cells = spark.createDataFrame(list(area.items()), "id long, area double")
    got = t.dilate(cells, spark.createDataFrame(list(edges), "i long, j long"), spark.createDataFrame(stars, "id long, region long"), target)
    assert {r["cell"]: r["region"] for r in got.collect()} == region


def test_centres_are_means_of_their_rows(spark):
    rng = np.random.default_rng(17)
    p = np.vstack([rng.normal(m, 0.05, (90, 2)) for m in ((0, 0), (3, 0), (0, 3))] + [[[3.0, 0.0]] * 9])
    w = rng.uniform(0.5, 2, len(p))
    df = spark.createDataFrame([(i, 0, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(p, w, strict=True))], "id long, g long, x double, y double, weight double")
    c = np.array([(r["x"], r["y"]) for r in t.kmeans_centroids(df, bins=3).collect()])
    own = ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(c) == 3 and np.allclose(c, [np.average(p[own == k], axis=0, weights=w[own == k]) for k in range(3)])
    many = np.array([(r["x"], r["y"]) for r in t.kmeans_centroids(df, points_per_bin=9, part=40).collect()])
    assert len(many) == round(len(p) / 9) == 31  # however many parts there are
    cost = lambda c: (w * ((p[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)).sum()
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(5):
        c = p[rng.choice(len(p), 1)]
        while len(c) < 31:
            far = w * ((p[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, p[rng.choice(len(p), p=far / far.sum())]])
        for _ in range(25):
            own = ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([np.average(p[own == k], axis=0, weights=w[own == k]) if (own == k).any() else c[k] for k in range(31)])
        best = min(best, cost(c))
    print(cost(many) / best)
    assert cost(many) < 1.25 * best
    assert len(t.kmeans_centroids(df, bins=2, part=40).collect()) == 2 and t.kmeans_centroids(df.limit(5), bins=9).count() == 5
    assert t.kmeans_centroids(df.withColumn("weight", F.lit(0.0)), bins=3).count() == 0
    with pytest.raises(ValueError):
        t.kmeans_centroids(df)


def test_grid_of_weighted_centres(spark):
    """Centres, their cells, and merged regions: every centre has a cell, cells fill the box, regions are unions of touching cells that hold the wanted median of points."""
    rng = np.random.default_rng(21)
    p = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, 0, float(x), float(y), 1.0 + i % 3) for i, (x, y) in enumerate(p)], "id long, g long, x double, y double, weight double")
    cells, mapped = t.region_grid(rows, "wkmeans", 1, 0.2, 40.0, 10)
    cells, region = {r["id"]: r for r in cells.collect()}, {r["cell"]: r["region"] for r in mapped.collect()}
    places = np.array([(r["x"], r["y"]) for r in cells.values()])
    assert len(cells) == 40 and set(region) == set(cells)
    box = np.prod(np.ptp(places, axis=0) + 0.4)
    assert sum(r["area"] for r in cells.values()) == pytest.approx(box)
    ids, own = list(cells), []
    for q in p:
        own.append(ids[((places - q) ** 2).sum(axis=1).argmin()])
    counts = Counter(region[c] for c in own)
    assert np.median(list(counts.values())) >= 40 or len(set(region.values())) == 1
    for r in set(region.values()):
        members = {c for c in region if region[c] == r}
        seen, todo = set(), [min(members)]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += [j for j in cells[c]["touches"] if j in members] + [j for j in members if c in cells[j]["touches"]]
        assert seen == members
    centre_of = np.array([(cells[c]["x"], cells[c]["y"]) for c in own])
    assert ((p - centre_of) ** 2).sum() < 0.2 * ((p - p.mean(axis=0)) ** 2).sum()
