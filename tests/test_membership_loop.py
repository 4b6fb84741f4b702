"""The whole membership loop against a second version in plain numpy."""

import math

import numpy as np
import pytest
from asterism.functions.expressions import Reddening
from asterism.jobs import membership

NREF, STEP, THRESHOLD, PAD = 5, 0.15, 0.3, 0.05
ROI = (-1.5, 1.5, -2.2, 2.6)


def catalogue(rng, n):
    y, r, a = rng.uniform(-1, 1, n), 0.02 * np.sqrt(rng.uniform(size=n)), rng.uniform(0, 2 * np.pi, n)
    place, band1 = rng.uniform(0, 100, (n, 2)), 22 + 2 * y
    color = 1.75 + 0.2 * y + 0.002 * (place[:, 0] - 50) + rng.normal(0, 0.02, n)  # redder to one side
    return np.column_stack([290 + r * np.cos(a), 2 + r * np.sin(a), place, band1, band1 - color])


def ridge(knots, values, at):
    """The not-a-knot cubic through the knots, all its conditions solved at once."""
    n = len(knots) - 1
    rows, want = [], []
    term = lambda t, d: np.array([[1, t, t * t, t**3], [0, 1, 2 * t, 3 * t * t], [0, 0, 2, 6 * t], [0, 0, 0, 6]][d], float)

    def state(value, *parts):
        row = np.zeros(4 * n)
        for i, v in parts:
            row[4 * i : 4 * i + 4] += v
        rows.append(row)
        want.append(value)

    for i in range(n):
        state(values[i], (i, term(0, 0)))
        state(values[i + 1], (i, term(knots[i + 1] - knots[i], 0)))
    for i in range(n - 1):
        for d in (1, 2):
            state(0, (i, term(knots[i + 1] - knots[i], d)), (i + 1, -term(0, d)))
    for i in (0, n - 2):
        state(0, (i, term(0, 3)), (i + 1, -term(0, 3)))
    c = np.linalg.solve(np.array(rows), np.array(want)).reshape(n, 4)
    i = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, n - 1)
    return np.array([term(a - knots[j], 0) @ c[j] for a, j in zip(at, i, strict=True)])


def plain(cluster, field, groups, share, dr, iterations):
    """Bands, reddening and membership of all cluster stars; ``groups``: ring of each star or -1, ``share``: area of each ring over the field's."""
    cos, sin = math.cos(dr.theta), math.sin(dr.theta)
    b1, b2, delta, m = cluster[:, 4].copy(), cluster[:, 5].copy(), np.zeros(len(cluster)), np.ones(len(cluster))
    history = []
    for k in range(iterations):
        up, across = b1 - dr.to_mag, b1 - b2 - dr.to_color
        rx, ry = across * cos + up * sin, up * cos - across * sin
        refs = np.flatnonzero((m > THRESHOLD) & (rx > ROI[0]) & (rx < ROI[1]) & (ry > ROI[2]) & (ry < ROI[3]))
        low = ry[refs].min()
        knots = []
        for j in range(round((ry[refs].max() - low) / STEP)):
            inside = refs[(ry[refs] > low + j * STEP) & (ry[refs] < low + (j + 1) * STEP)]
            if len(inside):
                knots.append((np.median(ry[inside]), np.median(rx[inside])))
        residual = rx[refs] - ridge(*map(np.array, zip(*knots, strict=True)), ry[refs])
        shift = np.zeros(len(cluster))
        for i, p in enumerate(cluster[:, 2:4]):
            near = residual[np.argsort(((cluster[refs, 2:4] - p) ** 2).sum(axis=1), kind="stable")[1 : NREF + 1]]
            kept = near[np.abs(near - np.median(near)) < 2 * near.std()]
            shift[i] = np.median(kept if len(kept) else near)
        change = shift * cos / (dr.a1 - dr.a2)
        use = np.ones(len(cluster), bool) if k == 0 else (np.abs(change) > 2 * change.std()) & (delta != 0)
        b1, b2 = np.where(use, b1 - shift * sin, b1), np.where(use, b2 - shift * sin + shift * cos, b2)
        delta = delta + np.where(use, change, 0)
        for g, ratio in share.items():
            own = np.flatnonzero(groups == g)
            at = np.column_stack([b1[own] - b2[own], b1[own]])
            f = np.column_stack([field[:, 4] - field[:, 5], field[:, 4]])
            f = f[((f >= at.min(axis=0) - PAD) & (f <= at.max(axis=0) + PAD)).all(axis=1)]
            nearest = ((f[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            for i, n in zip(*np.unique(nearest, return_counts=True), strict=True):
                m[own[i]] = 1 - min(1.0, n * ratio)  # a cell has one cluster star, taken with this probability
        history.append((b1.copy(), b2.copy(), delta.copy(), m.copy(), use))
    return history


@pytest.mark.parametrize("iterations", [1, 3])
def test_against_plain_numpy(spark, iterations):
    rng = np.random.default_rng(9)
    cluster, field = catalogue(rng, 500), catalogue(rng, 150)
    field[:, 4:] += 0.4
    names = "ra double, dec double, x double, y double, band1 double, band2 double, star_id long"
    frames = [spark.createDataFrame([(*map(float, r), i) for i, r in enumerate(t)], names) for t in (cluster, field)]
    dr = Reddening()
    a, b, c, d = ROI
    found, rings = membership.spatial_groups(*frames, 30)
    groups = np.full(len(cluster), -1)
    for r in found.collect():
        groups[r["star_id"]] = r["g"]
    assert len(rings) > 1 and (groups >= 0).sum() > 400
    want = plain(cluster, field, groups, {g: share for g, *_, share in rings}, dr, iterations)
    got = membership.statistical_membership(*frames, dr, [(a, c), (b, c), (b, d), (a, d)], nref=NREF, step=STEP, threshold=THRESHOLD, iterations=iterations, min_stars=30, pad=PAD).collect()
    assert sorted(r["star_id"] for r in got) == list(range(len(cluster)))
    b1, b2, delta, m, used = want[-1]
    for r in got:
        i = r["star_id"]
        assert (r["g"] if r["g"] is not None else -1) == groups[i]
        assert (r["band1"], r["band2"], r["delta_ebv"], r["membership"]) == pytest.approx((b1[i], b2[i], delta[i], m[i]), abs=1e-8)
    assert 0 < used.sum() and (iterations == 1 or used.sum() < len(cluster) / 2)
    assert 20 < (m < 1).sum() < 400
