"""Points in polygons and outlines of merged cells."""

import numpy as np
import pytest
from asterism.operators import regions, tessellation
from pyspark.sql import functions as F

RINGS = f"region long, ring {regions.RING}"


def held(ring, x, y):
    odd = on = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y < ay) != (y < by) and x < ax + (y - ay) * ((bx - ax) / (by - ay)):
            odd = not odd
        on |= (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
    return odd or on


def table(spark, rings):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in r]) for k, r in rings], RINGS)


def test_any_outline_edges_several_regions_and_sizes(spark):
    """Concave rings, a spiral, one huge ring beside small ones, points on edges and corners of rings and cells."""
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 6 * np.pi, 200)
    spiral = [(t * np.cos(t), t * np.sin(t)) for t in angle] + [((t + 2) * np.cos(t), (t + 2) * np.sin(t)) for t in angle[::-1]]
    rings = [(1, [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4)]), (2, [(2, -1), (6, -1), (6, 5)]), (3, spiral), (4, [(-1000, -1000), (1000, -1000), (1000, 1000), (-1000, 1000)]), (5, [(0, 0), (1, 1)]), (6, [(0, 0), (8, 0), (8, 8), (0, 8)]), (6, [(4, 4), (12, 4), (12, 12), (4, 12)])]
    for k in range(40):
        x, y = rng.uniform(-9, 9, 2)
        rings.append((10 + k, [(x + r * np.cos(t), y + r * np.sin(t)) for t, r in zip(np.linspace(0, 6, 9), rng.uniform(0.01, 0.4, 9), strict=True)]))
    places = [*rng.uniform(-22, 22, (1500, 2)).tolist(), *[[float(i), float(j)] for i in range(-2, 10) for j in range(-2, 10)], [2.0, 2.0], [4.0, 2.0], [1000.0, 1000.0], [1000.5, 0.0], [3.0, 1.0]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, None, 0.0), (-2, float("nan"), 0.0)], "id long, x double, y double")
    bad = spark.createDataFrame([(90, None), (91, []), (92, [(0.0, 0.0), (1.0, float("inf")), (1.0, 1.0)]), (93, [(0.0, 0.0), (None, 1.0), (1.0, 1.0)])], RINGS)
    got = sorted((r["region"], r["id"]) for r in regions.points_in_polygons(points, table(spark, rings).union(bad)).collect())
    plain = [(k, [(float(a), float(b)) for a, b in r]) for k, r in rings if len(r) > 2]
    assert got == sorted((k, i) for k, r in plain for i, (x, y) in enumerate(places) if held(r, x, y))
    assert regions.points_in_polygons(points, bad).count() == 0 and regions.points_in_polygons(points.limit(0), bad.limit(0)).count() == 0


def test_most_points_of_a_huge_ring_need_no_test():
    level, cells, whole, edges = regions.cover(np.array([(np.cos(t) * 1e6, np.sin(t) * 1e6) for t in np.linspace(0, 6.28, 10_000)]))
    assert whole.mean() > 0.85 and len(cells) < 66**2 and len(edges) == 10_000


def square(x, y, s=1.0):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def outlines(spark, squares, region):
    cells = spark.createDataFrame([(i, [tuple(map(float, p)) for p in square(*s)]) for i, s in enumerate(squares)], f"id long, ring {regions.RING}")
    mapped = spark.createDataFrame(list(enumerate(region)), "cell long, region long")
    return {(r["region"], r["part"]): ([(p["x"], p["y"]) for p in r["ring"]], r["area"]) for r in regions.dissolve(cells, mapped).collect()}


def test_holes_contacts_at_corners_and_equal_cells(spark):
    frame = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    got = outlines(spark, [*frame, (1, 1), (1, 1), (10, 10), (11, 11), (20, 20)], [1] * 8 + [2, 2, 3, 3, 3])
    assert {k: v[1] for k, v in got.items()} == {(1, 0): 9.0, (1, 1): -1.0, (2, 0): 1.0, (3, 0): 1.0, (3, 1): 1.0, (3, 2): 1.0}
    assert len(got[1, 0][0]) == 12 and set(got[1, 1][0]) == set(square(1, 1)) and len(got[2, 0][0]) == 4
    touching = outlines(spark, [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))], [7] * 14)
    assert sorted(v[1] for v in touching.values()) in ([-2.0, 16.0], [-1.0, -1.0, 16.0])


def test_a_long_outline(spark):
    got = outlines(spark, [(x, 0) for x in range(300)], [1] * 300)
    assert list(got) == [(1, 0)] and got[1, 0][1] == 300.0 and len(got[1, 0][0]) == 602


def test_regions_of_voronoi_cells_have_the_area_of_their_cells(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(120, 2)))], "id long, g long, x double, y double")
    cells = tessellation.voronoi_cells(points, 0.5)
    mapped = cells.select(F.col("id").alias("cell"), (F.col("id") % 5).alias("region"))
    want = {r["region"]: r["a"] for r in cells.groupBy((F.col("id") % 5).alias("region")).agg(F.sum("area").alias("a")).collect()}
    found = regions.dissolve(cells, mapped, 1e-9).groupBy("region").agg(F.sum("area").alias("a"), F.count("*").alias("n")).collect()
    assert {r["region"]: r["a"] for r in found} == pytest.approx(want) and sum(r["n"] for r in found) > 5
    (one,) = regions.dissolve(cells, mapped.withColumn("region", F.lit(1)), 1e-9).collect()
    assert one["area"] == pytest.approx(sum(want.values()))
    assert regions.dissolve(cells, mapped.limit(0)).count() == 0
