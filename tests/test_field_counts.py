"""Field stars counted by cell, on many groups at once."""

import numpy as np
from asterism.jobs import membership
from asterism.operators import neighbours
from pyspark.sql import functions as F

PLACES = "id long, g long, x double, y double"


def test_counts_and_own_cells_against_all_pairs(spark, monkeypatch):
    """Whole numbers, so that many points lie on shared edges and several stars at one place; boxes leave some points out."""
    rng = np.random.default_rng(6)
    stars = [(k, int(g), float(x), float(y)) for k, (g, x, y) in enumerate(zip(rng.integers(0, 4, 300), *rng.integers(0, 12, (2, 300)), strict=True))]
    field = [(k, g, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-2, 15, (200, 2))) for g in range(4)]
    s, f = spark.createDataFrame(stars, PLACES), spark.createDataFrame(field, PLACES)
    boxes = s.groupBy("g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    met, nearest = [], neighbours._nearest_in_block
    monkeypatch.setattr(neighbours, "_nearest_in_block", lambda *a: met.append(a) or nearest(*a))
    got = {r["region"]: r["n"] for r in membership._cell_counts(f, s, boxes, 1000.0).collect()}
    own = {(r["id"], r["region"]) for r in membership._own_cells(s, boxes, 1000.0).collect()}
    assert met == [(1, True)]  # stars of their own cells are not searched
    want = {}
    for _, g, x, y in field:
        near = [(i, (x - u) ** 2 + (y - v) ** 2, u, v) for i, h, u, v in stars if h == g]
        if min(n[2] for n in near) <= x <= max(n[2] for n in near) and min(n[3] for n in near) <= y <= max(n[3] for n in near):
            for i, d, *_ in near:
                if d == min(n[1] for n in near):
                    want[i] = want.get(i, 0) + 1
    assert got == want
    assert own == {(a[0], b[0]) for a in stars for b in stars if a[1:] == b[1:]}


def test_points_ask_for_few_blocks(spark):
    """Parts of blocks give a near bound, so that few points ask for more than the block around them; each asks for the one with its nearest place."""
    rng = np.random.default_rng(9)
    p, q = rng.uniform(size=(2000, 2)), rng.uniform(size=(20_000, 2))
    places = spark.createDataFrame([(k, [k], float(x), float(y)) for k, (x, y) in enumerate(q)], "place long, refs array<long>, rx double, ry double")
    blocks = neighbours._blocks(places, (0.0, 0.0), 1.0, len(q), 256)
    boxes = blocks.groupBy("block", "leaf").agg(F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"), F.sum(F.size("refs")).alias("n"), F.min("code").alias("code"))
    coarse = blocks.groupBy("block").agg(F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"), F.sum(F.size("refs")).alias("n"), F.min("code").alias("code"))
    for k in (1, 5):
        point, block = neighbours._Directory(sorted(boxes.collect()), (0.0, 0.0), 1.0).asked(p[:, 0], p[:, 1], k)
        most, _ = neighbours._Directory(sorted(coarse.collect()), (0.0, 0.0), 1.0).asked(p[:, 0], p[:, 1], k)
        assert len(set(zip(point.tolist(), block.tolist(), strict=True))) == len(point) < len(most) / 2
        of = {r["place"]: r["block"] for r in blocks.select("place", "block").collect()}
        asked = set(zip(point.tolist(), block.tolist(), strict=True))
        order = ((p[:, None] - q) ** 2).sum(axis=2).argsort(axis=1)[:, :k]
        assert all((i, of[j]) in asked for i, row in enumerate(order.tolist()) for j in row)
    assert max(r["count"] for r in blocks.groupBy("block").count().collect()) <= 256
