"""Overlays of many small regions: what is stored and shuffled does not grow with their pairs."""

import os

import numpy as np
import pytest
from asterism.operators import overlays, regions
from asterism.shared import shared_dir

RINGS = f"region long, ring {regions.RING}"


def stored(spark):
    root = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(root) for f in files)


def test_a_crowd_in_blocks(spark, monkeypatch):
    """All pairs of 600 and 700 boxes at one place, and a huge box on either side."""
    monkeypatch.setattr(overlays, "BLOCK", 100, raising=False)
    rng = np.random.default_rng(3)
    tables, boxes = [], []
    for n in (600, 700):
        low = np.vstack([rng.uniform(0, 0.4, (n, 2)), [(-50.0, -60.0)]])
        high = np.vstack([low[:-1] + rng.uniform(0.5, 0.9, (n, 2)), [(70.0, 40.0)]])
        boxes.append((low, high))
        rings = [[(a, b), (c, b), (c, d), (a, d)][:: 1 if k % 2 else -1] for k, ((a, b), (c, d)) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
        tables.append(spark.createDataFrame(list(enumerate(rings)), RINGS))
    before = stored(spark)
    found = overlays.overlay_areas(*tables)
    assert stored(spark) - before < 1_000_000
    got = found.toPandas().sort_values(["a", "b"])
    (al, ah), (bl, bh) = boxes
    want = np.maximum(np.minimum(ah[:, None], bh) - np.maximum(al[:, None], bl), 0).prod(axis=2)
    assert len(got) == 601 * 701 and not got.duplicated(["a", "b"]).any()
    assert np.allclose(got["both"].to_numpy().reshape(601, 701), want, atol=1e-11)
    assert np.allclose(got["only_a"].to_numpy().reshape(601, 701), (ah - al).prod(axis=1)[:, None] - want, atol=1e-9)


def test_cells_and_slabs_agree(spark):
    """Outlines of 3 to 60 corners, of sizes from a hundredth to ten, either way round."""
    rng = np.random.default_rng(8)

    def outline(k):
        n = int(rng.integers(3, 60))
        t, r = 2 * np.pi * (np.arange(n) + rng.uniform(0, 0.4, n)) / n, rng.uniform(0.2, 1, n)
        (x, y), size = rng.uniform(-5, 5, 2), 10 ** rng.uniform(-2, 1)
        return [(float(x + size * s * np.cos(v)), float(y + size * s * np.sin(v))) for v, s in zip(t, r, strict=True)][:: 1 if k % 3 else -1]

    rings = [overlays._rings(spark.createDataFrame([(k, outline(k)) for k in range(120)], RINGS)) for _ in "ab"]
    got, want = ({(r["a"], r["b"]): (r["both"], r["a_area"], r["b_area"]) for r in how(*rings).collect()} for how in (overlays._by_cells, overlays._by_slabs))
    assert got.keys() == want.keys() and len(want) > 2000
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
