"""Many rings about a cluster, as a query and as groups."""

import numpy as np
import pytest
from asterism.functions.expressions import inside_polygon
from asterism.jobs import membership
from asterism.jobs.queries import QUERIES
from asterism.operators import tessellation
from pyspark.sql import functions as F


def test_the_query_with_several_rings(spark):
    rows = sorted(QUERIES["annuli"](spark, "/root/testdata/sf0.1").collect())
    assert len(rows) > 3 and [r["group_id"] for r in rows] == list(range(len(rows)))
    groups = QUERIES["annulus_groups"](spark, "/root/testdata/sf0.1").groupBy("group_id").count().collect()
    assert {r["group_id"]: r["n"] for r in rows} == {r["group_id"]: r["count"] for r in groups}


def test_a_hundred_rings_against_numpy(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.normal(0, 0.05, (4000, 2)), [(0.0, 0.0)]])
    stars = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "star_id long, ra double, dec double")
    groups, rings = membership.spatial_groups(stars, stars, 10)
    assert len(rings) > 100 and all(type(v) in (int, float) for r in rings for v in r)
    hull = tessellation.hull_of(p)
    mid = (p.min(axis=0) + p.max(axis=0)) / 2
    d, want = np.hypot(*(p - mid).T), {}
    corners = {tuple(c) for c in hull}
    for k, (far, place) in enumerate(zip(d, p, strict=True)):
        for g, low, high, *_ in rings:
            if low < far < high and not (np.isinf(high) and tuple(place) in corners):
                want[k] = g
    assert {r["star_id"]: r["g"] for r in groups.collect()} == want
    assert len(groups._jdf.queryExecution().analyzed().toString()) < 100_000
    assert membership.spatial_groups(stars, stars, 10**9)[0].count() == 0


@pytest.mark.parametrize("n", [5, 40])
def test_inside_rings_of_few_and_many_corners(spark, n):
    """A jagged outline with level edges; its corners and the middles of level edges are not inside."""
    xs = np.linspace(0.0, 16.0, n)
    ring = [(float(x), float(2 + k % 2)) for k, x in enumerate(xs)] + [(16.0, 0.0), (0.0, 0.0)]
    grid = [(float(x), float(y)) for x in np.linspace(-1, 17, 37) for y in np.linspace(-0.5, 3.5, 17)] + ring
    got = {(r["x"], r["y"]): r["in"] for r in spark.createDataFrame(grid, "x double, y double").withColumn("in", inside_polygon(F.col("x"), F.col("y"), ring)).collect()}
    top = lambda x: np.interp(x, xs, [p[1] for p in ring[:n]])
    near = lambda x, y: abs(y - top(x)) < 1e-9 if 0 <= x <= 16 else False
    for (x, y), inside in got.items():
        if not near(x, y):
            assert inside == (0 < x < 16 and 0 < y < top(x)), (x, y)
    assert not any(got[p] for p in ring)
