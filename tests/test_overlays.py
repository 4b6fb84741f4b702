"""Areas of intersections, differences and unions of regions."""

import numpy as np
import pytest
from asterism.operators import overlays, regions, tessellation
from pyspark.sql import functions as F

RINGS = f"region long, ring {regions.RING}"


def table(spark, rings):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in r]) for k, r in rings], RINGS)


def areas(spark, left, right):
    got = overlays.overlay_areas(table(spark, left), table(spark, right)).collect()
    assert len({(r["a"], r["b"]) for r in got}) == len(got)
    return {(r["a"], r["b"]): (r["both"], r["only_a"], r["only_b"], r["either"]) for r in got}


def swept(left, right):
    """What two regions, lists of rings, share: heights by even-odd rule in the middle of the strips between all corners and crossings."""
    edges = [[(p, q) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True)] for rings in (left, right)]
    xs = {p[0] for own in edges for p, _ in own}
    for (ax, ay), (bx, by) in edges[0]:
        for (cx, cy), (dx, dy) in edges[1]:
            d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if d:
                xs.add(ax + (bx - ax) * ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d)
    total, xs = 0.0, sorted(xs)
    for lo, hi in zip(xs, xs[1:], strict=False):
        m = (lo + hi) / 2
        at = sorted((p[1] + (m - p[0]) * (q[1] - p[1]) / (q[0] - p[0]), side) for side in (0, 1) for p, q in edges[side] if min(p[0], q[0]) < m < max(p[0], q[0]))
        inside = [False, False]
        for (y, side), (up, _) in zip(at, at[1:], strict=False):
            inside[side] = not inside[side]
            total += (up - y) * (hi - lo) * all(inside)
    return total


def box(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_exact_cases(spark):
    notched = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    got = areas(
        spark,
        [(1, box(0, 0, 2, 2)), (2, notched[::-1]), (3, box(0, 0, 3, 3)), (3, box(1, 1)[::-1]), (4, [(0, 0), (1, 1)]), (5, [(0, 0), (1, 1), (2, 2)])],
        [(1, box(1, 1, 2, 2)), (2, box(0, 0, 2, 2)), (3, box(2, 0)), (4, box(1.25, 1.25, 0.5, 0.5)), (5, box(9, 9)), (6, box(2, 3, 1, 9))],
    )
    assert got[1, 1] == pytest.approx((1, 3, 3, 7)) and got[1, 2] == pytest.approx((4, 0, 0, 4)) and got[1, 3] == pytest.approx((0, 4, 1, 5))
    assert got[2, 2] == pytest.approx((11 / 3, 10 - 11 / 3, 1 / 3, 14 - 11 / 3)) and got[2, 3][0] == pytest.approx(1)
    assert got[3, 2] == pytest.approx((3, 5, 1, 9)) and got[3, 4] == pytest.approx((0, 8, 0.25, 8.25)) and got[3, 6] == pytest.approx((0, 8, 9, 17))
    assert got[5, 2] == pytest.approx((0, 0, 4, 4)) and not any(4 == a or 5 == b for a, b in got) and (1, 6) not in got


def star(rng, x, y, size, n):
    """An outline without crossings: angles in turn, less than half a turn apart."""
    return [(x + r * size * np.cos(t), y + r * size * np.sin(t)) for t, r in zip(2 * np.pi * (np.arange(n) + rng.uniform(0, 0.4, n)) / n, rng.uniform(0.2, 1, n), strict=True)]


def test_against_a_sweep(spark):
    """Concave outlines of many sizes, either way round, a fine spiral, a comb and a region with a hole, far from the origin too."""
    rng = np.random.default_rng(11)
    angle = np.linspace(0, 6 * np.pi, 120)
    spiral = [(t * np.cos(t), t * np.sin(t)) for t in angle] + [((t + 2) * np.cos(t), (t + 2) * np.sin(t)) for t in angle[::-1]]
    comb = [p for k in range(30) for p in ((-9.0, k * 0.6 - 9), (9.0, k * 0.6 - 8.9), (9.0, k * 0.6 - 8.7), (-8.9, k * 0.6 - 8.6))] + [(-9.5, 9.5)]
    for shift in (0.0, 1e5):
        make = lambda: [star(rng, *rng.uniform(-10, 10, 2), 10 ** rng.uniform(-2, 1), int(rng.integers(3, 40)))[:: int(rng.choice([1, -1]))] for _ in range(25)]  # noqa: B023, E731
        left, right = ({k: [r] for k, r in enumerate(make())} for _ in "ab")
        left[100], left[101], right[102] = [spiral], [box(-6, -6, 12, 12), star(rng, 0, 0, 5, 9)[::-1]], [comb]
        move = lambda t: {k: [[(x + shift, y - shift) for x, y in r] for r in rs] for k, rs in t.items()}  # noqa: B023, E731
        left, right = move(left), move(right)
        got = areas(spark, *([(k, r) for k, rs in t.items() for r in rs] for t in (left, right)))
        for a, p in left.items():
            for b, q in right.items():
                want = swept(p, q)
                assert got.get((a, b), (0.0,))[0] == pytest.approx(float(want), abs=1e-8 if shift == 0 else 1e-5), (a, b)
    assert sum(v[0] > 0 for v in got.values()) > 80


def test_cells_of_two_tessellations_fill_each_other(spark):
    rng = np.random.default_rng(2)
    cells = []
    for n in (60, 90):
        corners = np.array([(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)])
        points = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(-2, 2, (n, 2)), corners]))], "id long, g long, x double, y double")
        cells.append(tessellation.voronoi_cells(points, 0.0).select(F.col("id").alias("region"), "ring", "area"))
    found = overlays.overlay_areas(*cells)
    for side, t in zip("ab", cells, strict=True):
        sums = {r[side]: r["s"] for r in found.groupBy(side).agg(F.sum("both").alias("s")).collect()}
        assert sums == pytest.approx({r["region"]: r["area"] for r in t.collect()})
    assert found.agg(F.sum("both")).first()[0] == pytest.approx(16.0)


def test_odd_rows_and_a_huge_outline(spark):
    bad = spark.createDataFrame([(90, None), (91, []), (92, [(0.0, 0.0), (1.0, float("inf")), (1.0, 1.0)]), (93, [(0.0, 0.0), (None, 1.0), (1.0, 1.0)]), (94, [(0.0, 0.0), None, (1.0, 1.0)])], RINGS)
    some = table(spark, [(1, box(0, 0))])
    assert overlays.overlay_areas(bad, some).count() == 0 and overlays.overlay_areas(some, bad.limit(0)).count() == 0
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    disc = [(1000 * np.cos(v), 1000 * np.sin(v)) for v in t]
    rng = np.random.default_rng(4)
    small = [(k, box(*p, 0.5, 0.5)) for k, p in enumerate(rng.uniform(-1100, 1100, (2000, 2)))]
    got = areas(spark, [(1, disc)], small)
    assert sum(v[0] == pytest.approx(0.25) for v in got.values()) > 1000 and len(got) > 1500
    for k, r in small:
        far = np.hypot(*np.array(r).T)
        if far.max() < 999:
            assert got[1, k][0] == pytest.approx(0.25)
        elif (1, k) in got and far.min() > 1001:
            assert got[1, k][0] == pytest.approx(0, abs=1e-9)
