"""Areas that regions of two tables share, and what each keeps for itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, tidy
from .regions import RING

#: A slab of a region is as wide as so many of its mean edges, so cutting edges at slabs adds few pieces whatever the outline.
EDGES_ACROSS = 4
#: Cells and slabs are no finer than this power of two below the largest coordinate, so their numbers are exact.
FINEST = 50
#: Corners of regions that tasks meet whole; larger outlines are cut into slabs.
FEW = 64
#: Regions of either side that a task holds at once, pairs whose boxes it compares at once, those whose areas it computes at once, and pairs that are worth a task.
BLOCK, CANDIDATES, CELLS, WORK = 1 << 13, 1 << 16, 1 << 12, 1 << 26
TINY = 1e-300
#: What tells the groups of regions that meet: kind (see ``_entered``), level and place of a cell, and blocks of its left and right regions.
GROUP = ["kind", "l", "cx", "cy", "i", "j"]


def _level(extent: Column, largest: Column) -> Column:
    """Power of two of a side that reaches over ``extent``."""
    power = lambda v: F.when(v > 0, F.ceil(F.log2(v)).cast("int"))
    return F.greatest(F.coalesce(power(extent), F.lit(-1000)), F.coalesce(power(largest) - FINEST, F.lit(-1000)), F.lit(-1000))


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _rings(regions: DataFrame) -> DataFrame:
    """The rings that can enclose something."""
    known = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    some = regions.select(F.col("region").cast("long").alias("region"), F.col("ring").cast(RING).alias("ring"))
    return some.filter((F.size("ring") >= 3) & F.forall("ring", lambda p: known(p["x"]) & known(p["y"])))


def _edges(some: DataFrame) -> DataFrame:
    """Edges of the rings, and twice the area each sweeps about its ring's first corner."""
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    each = some.select("region", F.col("ring")[0].alias("o"), F.explode(F.arrays_zip(F.col("ring").alias("a"), after.alias("b"))).alias("e"))
    each = each.select("region", "o", *(F.col(f"e.{c}.{d}").alias(f"{c}{d}") for c in "ab" for d in "xy"))
    x, y = (lambda c: F.col(f"{c}x") - F.col("o.x")), (lambda c: F.col(f"{c}y") - F.col("o.y"))
    return each.select("region", "ax", "ay", "bx", "by", (x("a") * y("b") - x("b") * y("a")).alias("twice"))


def _boxes(edges: DataFrame) -> DataFrame:
    """Box, area, way round and slab width of each region."""
    b = edges.groupBy("region").agg(
        F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"),
        F.count("*").alias("n"), F.sum(F.abs(F.col("bx") - F.col("ax"))).alias("spread"), F.sum("twice").alias("twice"),
    )
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    far = lambda *cs: F.greatest(*(F.abs(c) for c in cs))
    return b.select(
        "region", "x0", "x1", "y0", "y1", (F.abs("twice") / 2).alias("area"), F.when(F.col("twice") < 0, -1).otherwise(1).alias("way"),
        _level(F.greatest(wide, tall), far("x0", "x1", "y0", "y1")).alias("level"),
        _level(F.least(EDGES_ACROSS * F.col("spread") / F.col("n"), wide), far("x0", "x1")).alias("slab"),
    )


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of regions whose boxes meet, once each, by equal cells.

    A box reaches over two cells of its own level along an axis at most. It is entered there
    and at the coarser levels of the other table, so of two boxes the smaller one looks the larger up.
    """
    levels = {s: [r["level"] for r in t.select("level").distinct().collect()] for s, t in (("a", left), ("b", right))}  # powers of two between the least and the greatest box

    def entered(t: DataFrame, own: str, other: str) -> DataFrame:
        coarser = F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda v: v > F.col("level"))
        t = t.withColumn("l", F.explode(F.concat(F.array("level"), coarser))).withColumn("side", _side(F.col("l")))
        cell = lambda c: F.floor(F.col(c) / F.col("side"))
        t = t.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
        named = {c: f"{own}_{c}" for c in ("x0", "x1", "y0", "y1", "area", "way", "level", "slab")}
        return t.drop("side" if own == "b" else "_").withColumnRenamed("region", own).withColumnsRenamed(named)

    met = entered(left, "a", "b").join(entered(right, "b", "a"), ["l", "cx", "cy"])
    low = lambda d: F.greatest(f"a_{d}0", f"b_{d}0")
    high = lambda d: F.least(f"a_{d}1", f"b_{d}1")
    first = (F.floor(low("x") / F.col("side")) == F.col("cx")) & (F.floor(low("y") / F.col("side")) == F.col("cy"))
    met = met.filter((F.col("l") == F.greatest("a_level", "b_level")) & (low("x") <= high("x")) & (low("y") <= high("y")) & first)
    return met.select("a", "b", "a_area", "b_area", "a_way", "b_way", "a_slab", "b_slab", low("x").alias("x0"), high("x").alias("x1"), low("y").alias("base"))


def _pieces(edges: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
    """Edges cut at the slabs of their region; ``s`` is 1 for an edge above the inside of an anticlockwise ring, -1 for one below it."""
    e = edges.filter("ax != bx").join(boxes.select("region", "slab"), "region")
    right = F.col("ax") < F.col("bx")
    end = lambda p, q, d: F.when(right, F.col(f"{p}{d}")).otherwise(F.col(f"{q}{d}"))
    e = e.select(F.col("region").alias(name), _side(F.col("slab")).alias("side"), F.when(right, -1).otherwise(1).alias("s"), end("a", "b", "x").alias("p"), end("b", "a", "x").alias("q"), end("a", "b", "y").alias("f"), end("b", "a", "y").alias("g"))
    e = e.withColumn("k", F.explode(F.sequence(F.floor(F.col("p") / F.col("side")), F.floor(F.col("q") / F.col("side")))))
    e = e.withColumn("u", F.greatest("p", F.col("k") * F.col("side"))).withColumn("v", F.least("q", (F.col("k") + 1) * F.col("side"))).filter("u < v")
    slope = (F.col("g") - F.col("f")) / (F.col("q") - F.col("p"))
    at = lambda c: F.when(F.col(c) == F.col("q"), F.col("g")).otherwise(F.col("f") + (F.col(c) - F.col("p")) * slope)
    return e.select(name, "k", "s", "u", "v", at("u").alias("f"), at("v").alias("g"))


def _shown(pairs: DataFrame, pieces: DataFrame, name: str) -> DataFrame:
    """The pieces of one region of each pair over the slabs where boxes meet, above the base of the pair, with heights from there."""
    own, common = _side(F.col(f"{name}_slab")), _side(F.greatest("a_slab", "b_slab"))
    asked = pairs.select("a", "b", "base", (own / common).alias("part"), F.col(f"{name}_way").alias("way"), F.explode(F.sequence(F.floor(F.col("x0") / own), F.floor(F.col("x1") / own))).alias("k"))
    got = asked.join(pieces, [name, "k"]).withColumns({"f": F.col("f") - F.col("base"), "g": F.col("g") - F.col("base")}).filter("f > 0 or g > 0")
    zero = F.col("u") + (F.col("v") - F.col("u")) * (F.col("f") / (F.col("f") - F.col("g")))
    cut = lambda c, h: F.when(F.col(h) < 0, zero).otherwise(F.col(c)).alias(f"{name}_{c}")
    over = lambda h: F.greatest(F.col(h), F.lit(0.0)).alias(f"{name}_{h}")
    return got.select("a", "b", F.floor(F.col("k") * F.col("part")).alias("slab"), (F.col("s") * F.col("way")).alias(f"{name}_s"), cut("u", "f"), cut("v", "g"), over("f"), over("g"))


def _below_both() -> Column:
    """Area under two straight pieces, over the stretch where both are."""
    l, r = F.greatest("a_u", "b_u"), F.least("a_v", "b_v")

    def at(n: str, x: Column) -> Column:
        f, g, u, v = (F.col(f"{n}_{c}") for c in "fguv")
        return F.when(x == v, g).otherwise(f + (x - u) * ((g - f) / (v - u)))

    dl, dr = at("a", l) - at("b", l), at("a", r) - at("b", r)
    low_l, low_r = F.least(at("a", l), at("b", l)), F.least(at("a", r), at("b", r))
    t = dl / (dl - dr)
    middle = at("a", l) + t * (at("a", r) - at("a", l))
    crossed = F.when(dl * dr < 0, t * (low_l + middle) + (1 - t) * (middle + low_r)).otherwise(low_l + low_r)
    return (r - l) * crossed / 2


def _small_shapes(rings: DataFrame) -> DataFrame:
    """Corners of all rings of each region, the rings' lengths, box and level; regions of few corners alone, as their rings are gathered."""
    each = rings.groupBy("region").agg(F.collect_list("ring").alias("rings"))
    each = each.select("region", F.transform("rings", lambda r: F.size(r)).alias("lens"), F.flatten("rings").alias("p"))
    each = each.select("region", "lens", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))
    each = each.select("*", *(f(f"{d}s").alias(f"{d}{k}") for d in "xy" for k, f in ((0, F.array_min), (1, F.array_max))))
    far = F.greatest(*(F.abs(c) for c in ("x0", "x1", "y0", "y1")))
    return each.select("region", "lens", "xs", "ys", "x0", "x1", "y0", "y1", _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), far).alias("level"))


def _entered(shapes: DataFrame, coarser: list[int], right: bool) -> DataFrame:
    """``shapes`` in the cells (l, cx, cy) that their boxes reach, of their own level and of the ``coarser`` ones of the other table.

    Of two boxes the larger one is at its own level: pairs of kind 0 meet where
    the left one is, those of kind 1 where the right one is and the left one is smaller.
    """
    above = F.filter(F.array(*map(F.lit, coarser)).cast("array<int>"), lambda v: v > F.col("level"))
    at = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("l"))
    own = [at(0, F.col("level")), at(1, F.col("level"))] if right else [at(0, F.col("level"))]
    t = shapes.withColumn("e", F.explode(F.concat(F.array(*own), F.transform(above, lambda v: at(0 if right else 1, v))))).select("*", "e.*").drop("e", "level")
    cell = lambda c: F.floor(F.col(c) / _side(F.col("l")))
    return t.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1")))).drop("x0", "x1", "y0", "y1")


class _Shapes:
    """Regions of some rows: boxes, areas, and edges that are not upright, by class (a power of two that holds their number)."""

    def __init__(self, rows: pa.Table) -> None:
        xs, ys, lens = (rows[c].combine_chunks() for c in ("xs", "ys", "lens"))
        x, y, n = (v.flatten().to_numpy() for v in (xs, ys, lens))
        count = np.diff(xs.offsets.to_numpy())
        heads = np.cumsum(count) - count
        self.box = [f.reduceat(v, heads) for v in (x, y) for f in (np.minimum, np.maximum)]
        start = np.cumsum(n) - n
        after = np.arange(len(x)) + 1
        after[start + n - 1] = start
        first = np.repeat(start, n)
        dx, dy = x - x[first], y - y[first]
        twice = np.add.reduceat(dx * dy[after] - dx[after] * dy, heads)
        self.area, way = np.abs(twice) / 2, np.where(twice < 0, -1.0, 1.0)
        of = np.repeat(np.arange(len(count)), count)
        keep = x != x[after]
        of, to, fro = of[keep], after[keep], np.flatnonzero(keep)
        ahead = x[fro] < x[to]
        p, q = np.where(ahead, fro, to), np.where(ahead, to, fro)
        edges = (x[p], x[q], y[p], y[q], np.where(ahead, -1.0, 1.0) * way[of])
        m = np.bincount(of, minlength=len(count))
        self.kind = np.maximum(2, np.ceil(np.log2(np.maximum(m, 1)))).astype(int)
        place = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        self.slot, self.edges = np.empty(len(count), np.int64), {}
        for k in np.unique(self.kind):
            own = np.flatnonzero(self.kind == k)
            self.slot[own] = np.arange(len(own))
            mine = self.kind[of] == k
            self.edges[k] = np.zeros((5, 1 << k, len(own)))  # what is left over has no width
            for held, v in zip(self.edges[k], edges, strict=True):
                held[place[mine], self.slot[of[mine]]] = v[mine]

    def shown(self, kind: int, rows: np.ndarray, x0: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, height at the start, slope and sign of edges of ``rows``, above ``base`` and from ``x0`` on."""
        u, v, f, g, s = self.edges[kind][:, :, self.slot[rows]]
        u, v, f, g = u - x0, v - x0, f - base, g - base
        slope = np.where(v > u, (g - f) / (v - u), 0.0)
        zero = u + (v - u) * (f / (f - g))
        start, end = np.where((f < 0) & (g > 0), zero, u), np.where((f > 0) & (g < 0), zero, v)
        return start, np.where((f > 0) | (g > 0), end, start), np.maximum(f, 0.0), slope, s


def _common(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Signed sum of the areas under two straight pieces, over the stretches where both are, for each pair of regions."""
    total = np.zeros(left[0].shape[1])
    l, w, al, bl, ar, br = np.empty((6, len(total)))
    for au, av, af, am, s in zip(*left, strict=True):
        for bu, bv, bf, bm, t in zip(*right, strict=True):
            np.maximum(au, bu, out=l)
            np.maximum(np.subtract(np.minimum(av, bv, out=w), l, out=w), 0.0, out=w)
            np.add(np.multiply(np.subtract(l, au, out=al), am, out=al), af, out=al)
            np.add(np.multiply(np.subtract(l, bu, out=bl), bm, out=bl), bf, out=bl)
            np.add(np.multiply(w, am, out=ar), al, out=ar)
            np.add(np.multiply(w, bm, out=br), bl, out=br)
            np.add(np.minimum(al, bl), np.minimum(ar, br), out=l)
            dl, dr = np.subtract(al, bl, out=al), np.subtract(ar, br, out=ar)
            crossed = np.maximum(np.multiply(dl, -dr, out=bl), 0.0, out=bl)
            apart = np.maximum(np.add(np.abs(dl, out=dl), np.abs(dr, out=dr), out=dl), TINY, out=dl)
            np.add(l, np.divide(crossed, apart, out=bl), out=l)  # where they cross, the lower one reaches above the line between its ends
            total += np.multiply(np.multiply(l, w, out=l), s * t, out=l)
    return total / 2


def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of rows that are whole groups in order, with the left rows of each ahead of the right ones."""
    key = [rows[c].to_numpy() for c in GROUP]
    new = np.zeros(len(key[0]), bool)
    for v in key:
        new[1:] |= v[1:] != v[:-1]
    group, right = np.cumsum(new), rows["right"].to_numpy(zero_copy_only=False)
    lefts, rights = np.flatnonzero(~right), np.flatnonzero(right)
    first, last = (np.searchsorted(group[rights], group[lefts], side) for side in ("left", "right"))
    lefts, first, many = (v[last > first] for v in (lefts, first, last - first))
    if not len(lefts):
        return
    shapes, region = _Shapes(rows), rows["region"].to_numpy()
    side = 2.0 ** rows["l"].to_numpy()
    cx, cy = rows["cx"].to_numpy(), rows["cy"].to_numpy()
    x0, x1, y0, y1 = shapes.box
    with np.errstate(all="ignore"):
        for part in np.split(np.arange(len(lefts)), np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES)) + 1):
            n = many[part]
            a = np.repeat(lefts[part], n)
            b = rights[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(len(a))]
            lx, ly = np.maximum(x0[a], x0[b]), np.maximum(y0[a], y0[b])
            # once, where the boxes begin to meet
            meet = (lx <= np.minimum(x1[a], x1[b])) & (ly <= np.minimum(y1[a], y1[b])) & (np.floor(lx / side[a]) == cx[a]) & (np.floor(ly / side[a]) == cy[a])
            a, b, lx, ly = a[meet], b[meet], lx[meet], ly[meet]
            for ka in np.unique(shapes.kind[a]):
                for kb in np.unique(shapes.kind[b]):
                    now = np.flatnonzero((shapes.kind[a] == ka) & (shapes.kind[b] == kb))
                    for i in range(0, len(now), CELLS):
                        k = now[i : i + CELLS]
                        at = lx[k], ly[k]
                        both = _common(shapes.shown(ka, a[k], *at), shapes.shown(kb, b[k], *at))
                        big, small = shapes.area[a[k]], shapes.area[b[k]]
                        both = np.minimum(np.maximum(both, 0.0), np.minimum(big, small))
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (region[a[k]], region[b[k]], both, big, small)], ["a", "b", "both", "a_area", "b_area"])


def _pairs_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_met`` over rows in order, some whole groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BLOCK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(rows.num_rows, bool)
        for c in GROUP:
            v = rows[c].to_numpy()
            same &= v == v[-1]
        at = int(np.argmax(same))  # the last group may go on in the next batch
        yield from _met(rows.slice(0, at).combine_chunks())
        held = rows.slice(at).combine_chunks().to_batches()
    if held:
        yield from _met(pa.Table.from_batches(held).combine_chunks())


def _by_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlays of regions of few corners (region, ring): tasks meet those of a cell and give the finished pairs, so no pair is shuffled or stored."""
    shapes = [materialise(_small_shapes(t)) for t in (left, right)]
    levels = [[r["level"] for r in t.select("level").distinct().collect()] for t in shapes]  # powers of two between the least and the greatest box
    a, b = _entered(shapes[0], levels[1], False), _entered(shapes[1], levels[0], True)
    cell = GROUP[:4]
    sides = [t.groupBy(*cell).agg(F.count("*").alias(n)) for t, n in ((a, "na"), (b, "nb"))]
    crowds = materialise(sides[0].join(sides[1], cell).select(*cell, F.ceil(F.col("na") / BLOCK).cast("int").alias("ma"), F.ceil(F.col("nb") / BLOCK).cast("int").alias("mb"), (F.col("na") * F.col("nb")).alias("work")))
    cores = left.sparkSession.sparkContext.defaultParallelism
    work, groups = crowds.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.sum(F.col("ma") * F.col("mb")), F.lit(0))).first()
    tasks = max(1, min(int(groups), max(4 * cores, int(work) // WORK)))  # of few bytes but much work: not to be merged
    split = F.broadcast(crowds.filter("ma > 1 or mb > 1").select(*cell, "ma", "mb"))  # one for every BLOCK rows at most
    one = lambda c: F.coalesce(c, F.lit(1))
    own = lambda c: F.pmod(F.xxhash64("region"), one(F.col(c))).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    a = a.join(split, cell, "left").withColumn("i", own("ma")).withColumn("j", every("mb")).withColumn("right", F.lit(False))
    b = b.join(split, cell, "left").withColumn("j", own("mb")).withColumn("i", every("ma")).withColumn("right", F.lit(True))
    rows = [t.select(*GROUP, "right", "region", "lens", "xs", "ys") for t in (a, b)]
    dealt = rows[0].union(rows[1]).repartition(tasks, *GROUP).sortWithinPartitions(*GROUP, "right")
    return dealt.mapInArrow(_pairs_of_groups, "a long, b long, both double, a_area double, b_area double")


def _by_slabs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlays of regions of any number of corners (region, ring): pieces of edges of each pair meet by slabs."""
    edges = [materialise(_edges(t)) for t in (left, right)]
    boxes = [materialise(_boxes(e)) for e in edges]
    pairs = materialise(_meeting(*boxes))
    a, b = (_shown(pairs, _pieces(e, t, n), n) for e, t, n in zip(edges, boxes, "ab", strict=True))
    over = a.join(b, ["a", "b", "slab"]).filter(F.greatest("a_u", "b_u") < F.least("a_v", "b_v"))
    shared = over.groupBy("a", "b").agg(F.sum(F.col("a_s") * F.col("b_s") * _below_both()).alias("both"))
    both = F.least(F.greatest(F.coalesce("both", F.lit(0.0)), F.lit(0.0)), "a_area", "b_area")
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", both.alias("both"), "a_area", "b_area")


@tidy
def overlay_areas(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b, both, only_a, only_b, either``: areas of intersection, differences and union of every region of ``left`` with every region of ``right`` whose boxes meet.

    Both tables have a region and a ring of structs x, y, not closed. Rings may be
    concave but don't cross themselves; a region of several rings has its holes
    run the other way round than its outlines, as ``dissolve`` gives them. Boxes
    meet if they touch; all other pairs share nothing. Rings of under three
    corners or with a null or infinite one are left out.

    A region is the sum of the strips below its upper edges less those below
    its lower edges, so what two regions share is the signed sum, over pairs of
    edges above each other, of the area below both: no crossing points are
    stitched, and edges that coincide need no rule. Regions of FEW corners at
    most are dealt to cells as large as they are; a task meets blocks of those of a cell and
    gives the finished pairs, so what is stored and shuffled grows with the regions, not with their pairs,
    and the work with the pairs. Edges of larger regions are cut into
    slabs of their region of some mean edges' width, and pairs of regions ask only for the
    slabs where their boxes meet, so a huge outline beside many small ones
    brings each only the edges above and below it. There the work grows with the pairs of edges that
    lie over one another within a slab: a few for each edge of outlines that seldom turn
    back, all pairs for two combs with teeth along x.
    """
    rings = [materialise(_rings(t)) for t in (left, right)]
    large = [materialise(t.groupBy("region").agg(F.sum(F.size("ring")).alias("n")).filter(F.col("n") > FEW).select("region")) for t in rings]
    any_ = [not t.isEmpty() for t in large]
    small = [r.join(t, "region", "left_anti") if some else r for r, t, some in zip(rings, large, any_, strict=True)]
    found = _by_cells(*small)
    if any_[0]:
        found = found.union(_by_slabs(rings[0].join(large[0], "region", "left_semi"), rings[1]))
    if any_[1]:
        found = found.union(_by_slabs(small[0], rings[1].join(large[1], "region", "left_semi")))
    return found.select("a", "b", "both", (F.col("a_area") - F.col("both")).alias("only_a"), (F.col("b_area") - F.col("both")).alias("only_b"), (F.col("a_area") + F.col("b_area") - F.col("both")).alias("either"))
