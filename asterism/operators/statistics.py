"""Histograms, binned medians and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise, tidy


def _range(df: DataFrame, *cols: str) -> tuple:
    """Minimum and maximum of each column, as numbers: one partial aggregate."""
    row = df.agg(*(f(F.when(~F.isnan(c), F.col(c))) for c in cols for f in (F.min, F.max))).first()
    return tuple(row)


def bin_index(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value; bins are half open, but the last is closed."""
    x = F.col(x) if isinstance(x, str) else x
    width = (high - low) / bins or 1.0
    return F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``bin, n, density`` of the bins that have rows; density integrates to one. No rows without values."""
    low, high = _range(df, col)
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density")).limit(0)
    width = (high - low) / bins or 1.0
    counted = df.filter(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(bin_index(col, low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count_if(F.col(col).isNotNull() & ~F.isnan(col))).first()[0]
    return counted.withColumn("density", F.col("n") / F.lit(total * width))


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 200) -> DataFrame:
    """``ix, iy, n, density`` of the cells that have rows."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    x0, x1, y0, y1 = _range(df, x, y)
    if x0 is None:
        return df.select(F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density")).limit(0)
    area = ((x1 - x0) / bins or 1.0) * ((y1 - y0) / bins or 1.0)
    cells = df.groupBy(bin_index(x, x0, x1, bins).alias("ix"), bin_index(y, y0, y1, bins).alias("iy")).agg(F.count("*").alias("n"))
    return cells.withColumn("density", F.col("n") / F.lit(df.count() * area))


def density_weights(df: DataFrame, key: str, x: str, y: str, bins: int = 200) -> DataFrame:
    """``key, weight``, one row for each: the histogram's density between the four bin centres around the row; 0 outside the outermost centres.

    The densities at the four corners are gathered for each of the at most
    (``bins`` + 1) squared squares between centres; the parameter bounds that
    table, so every task gets it, and rows are neither shuffled nor grouped.
    """
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    x0, x1, y0, y1 = _range(df, x, y)
    if x0 is None:
        return df.select(key, F.lit(0.0).alias("weight"))
    wx, wy = (x1 - x0) / bins or 1.0, (y1 - y0) / bins or 1.0
    sides = [(i, j) for i in (0, 1) for j in (0, 1)]
    shared = F.explode(F.array(*(F.struct((F.col("ix") - i).alias("qx"), (F.col("iy") - j).alias("qy"), F.lit(2 * i + j).alias("c")) for i, j in sides)))
    squares = histogram2d(df, x, y, bins).select("density", shared.alias("s")).select("density", "s.*")
    squares = squares.groupBy("qx", "qy").agg(*(F.coalesce(F.max(F.when(F.col("c") == 2 * i + j, F.col("density"))), F.lit(0.0)).alias(f"d{i}{j}") for i, j in sides))
    at = df.select(key, ((F.col(x) - x0) / wx - 0.5).alias("u"), ((F.col(y) - y0) / wy - 0.5).alias("v"))
    at = at.withColumns({"qx": F.floor("u"), "qy": F.floor("v")})
    outside = (F.col("u") < 0) | (F.col("u") > bins - 1) | (F.col("v") < 0) | (F.col("v") > bins - 1)
    fu, fv = F.col("u") - F.col("qx"), F.col("v") - F.col("qy")
    weight = sum(((fu if i else 1 - fu) * (fv if j else 1 - fv) * F.coalesce(f"d{i}{j}", F.lit(0.0)) for i, j in sides), F.lit(0.0))
    return at.join(F.broadcast(squares), ["qx", "qy"], "left").select(key, F.when(outside, 0.0).otherwise(weight).alias("weight"))


@tidy
def group_medians(df: DataFrame, keys: list[str], cols: list[str], few: int = 4096, bins: int = 256) -> DataFrame:
    """``keys`` and the exact median of each of ``cols`` in each group, for groups of any size.

    The middle of a group starts with the range of its values as its bracket.
    While a bracket holds over ``few`` values, a pass counts them by bin and
    narrows it to the bin with the middle; only what is left in a bracket is
    gathered, so no buffer holds more. Keys are not null; null and NaN values
    are left out, and a group without others has a null median.
    """
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols))).alias("_e")).select(*keys, "_e.*").filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    on = [*keys, "_c"]
    ends = rows.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    now = materialise(ends.select(*on, F.floor((F.col("_n") - 1) / 2).alias("_r"), F.floor(F.col("_n") / 2).alias("_q"), "_a", "_b", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m")))
    settled = []
    while True:
        settled.append(now.filter("_a = _b").select(*on, F.col("_a").alias("_median")))
        wide = now.filter((F.col("_a") < F.col("_b")) & (F.col("_m") > few))
        if wide.isEmpty():
            break
        small = now.filter((F.col("_a") < F.col("_b")) & (F.col("_m") <= few))
        inside = rows.join(wide, on).filter(F.col("_v").between(F.col("_a"), F.col("_b")))
        k = F.least(F.floor((F.col("_v") - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins)), F.lit(bins - 1))
        cells = inside.groupBy(*on, "_r", "_q", "_below", k.alias("_k")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*on).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("_below", F.col("_below") + before)
        holds = lambda r: (F.col(r) >= F.col("_below")) & (F.col(r) < F.col("_below") + F.col("_m"))
        low, high = (F.min(F.when(holds(r), F.struct("_a", "_b", "_below", "_m"))) for r in ("_r", "_q"))
        found = materialise(cells.groupBy(*on, "_r", "_q").agg(low.alias("l"), high.alias("h")))
        settled.append(found.filter("l._below != h._below").select(*on, ((F.col("l._b") + F.col("h._a")) / 2).alias("_median")))
        now = materialise(small.union(found.filter("l._below = h._below").select(*on, "_r", "_q", "l._a", "l._b", "l._below", "l._m")))
    held = rows.join(now.filter("_a < _b"), on).filter(F.col("_v").between(F.col("_a"), F.col("_b")))
    held = held.groupBy(*on, "_r", "_q", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_o"))
    pick = lambda r: F.get("_o", (F.col(r) - F.col("_below")).cast("int"))
    settled.append(held.select(*on, ((pick("_r") + pick("_q")) / 2).alias("_median")))
    every = settled[0]
    for s in settled[1:]:
        every = every.union(s)
    return every.groupBy(*keys).agg(*(F.max(F.when(F.col("_c") == c, F.col("_median"))).alias(c) for c in cols))


def bracketed(on: list[str], ends: DataFrame, count, gather, at: tuple[float, ...], few: int = 4096, bins: int = 256) -> DataFrame:
    """``on, q, value``: exact percentiles of each group by brackets, with linear interpolation.

    ``ends``: on, _n, _a, _b (number, least and greatest value). Each percentile
    of a group starts with the whole range. While a bracket holds over ``few``
    values, ``count`` (brackets: on, _q, _a, _b) gives its non-empty bins (on,
    _q, _k, _m, _a, _b: place, number, least and greatest value), and it becomes
    the bin, or the two bins, that hold the ranks; ``gather`` gives the values (on, _q, _v) of what
    is left. No buffer holds more than ``few`` values.
    """
    asked = F.explode(F.array(*(F.lit(float(q)) for q in at)))
    place = F.col("_q") * (F.col("_n") - 1)
    now = ends.filter("_n > 0").select("*", asked.alias("_q")).select(*on, "_q", F.floor(place).alias("_r"), (place - F.floor(place)).alias("_f"), "_a", "_b", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"))
    now = materialise(now)
    keys, settled = [*on, "_q"], []
    while True:
        settled.append(now.filter("_a = _b").select(*keys, F.col("_a").alias("_value")))
        wide = now.filter((F.col("_a") < F.col("_b")) & (F.col("_m") > few))
        if wide.isEmpty():
            break
        small = now.filter((F.col("_a") < F.col("_b")) & (F.col("_m") <= few))
        cells = count(wide.select(*keys, "_a", "_b"), bins).join(wide.select(*keys, "_r", "_f", "_below"), keys)
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("_below", F.col("_below") + before)
        holds = lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_m"))
        low, high = (F.min(F.when(holds(r), F.struct("_below", "_a", "_b", "_m"))) for r in (F.col("_r"), F.col("_r") + (F.col("_f") > 0).cast("int")))
        found = materialise(cells.groupBy(*keys, "_r", "_f").agg(low.alias("l"), high.alias("h")))
        apart = F.col("l._below") != F.col("h._below")
        settled.append(found.filter(apart).select(*keys, (F.col("l._b") + (F.col("h._a") - F.col("l._b")) * F.col("_f")).alias("_value")))
        now = materialise(small.union(found.filter(~apart).select(*keys, "_r", "_f", "l._a", "l._b", "l._below", "l._m")))
    left = now.filter("_a < _b")
    held = gather(left.select(*keys, "_a", "_b")).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_o")).join(left, keys)
    pick = lambda more: F.get("_o", (F.col("_r") - F.col("_below") + more).cast("int"))
    settled.append(held.select(*keys, (pick(0) + F.when(F.col("_f") > 0, (pick(1) - pick(0)) * F.col("_f")).otherwise(0.0)).alias("_value")))
    every = settled[0]
    for part in settled[1:]:
        every = every.union(part)
    return every.select(*on, F.col("_q").alias("q"), F.col("_value").alias("value"))


@tidy
def group_quantiles(df: DataFrame, on: list[str], value: str, at: tuple[float, ...], few: int = 4096, bins: int = 256) -> DataFrame:
    """``on, q, value``: exact percentiles of ``value`` in each group of any size, all in the same passes. Null and NaN are left out; keys are not null."""
    rows = df.select(*on, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    inside = lambda brackets: rows.join(brackets, on).filter(F.col("_v").between(F.col("_a"), F.col("_b")))

    def count(wide: DataFrame, bins: int) -> DataFrame:
        k = F.least(F.floor((F.col("_v") - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins)), F.lit(bins - 1))
        return inside(wide).groupBy(*on, "_q", k.alias("_k")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))

    ends = rows.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    return bracketed(on, ends, count, lambda left: inside(left).select(*on, "_q", "_v"), at, few, bins)


def exact_quantiles(df: DataFrame, col: str, at: tuple[float, ...], few: int = 4096, bins: int = 1024) -> list[float | None]:
    """Exact percentiles of a whole column with linear interpolation, for any number of rows.

    Each wanted rank starts with the range of all values as its bracket. A pass
    counts the rows of every bracket by bin, which shuffles at most ``bins``
    rows per bracket and task, and narrows it to the bin with the rank; at most
    ``few`` values of a bracket reach the driver in the end. Null and NaN are
    left out; without values all percentiles are None.
    """
    x = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = x.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    open_ = {r: (low, high, 0, n) for p in places for r in (math.floor(p), min(math.floor(p) + 1, n - 1))}
    found: dict[int, float] = {}
    while True:
        found |= {r: b[0] for r, b in open_.items() if b[0] == b[1]}
        open_ = {r: b for r, b in open_.items() if r not in found}
        wide = sorted({b for b in open_.values() if b[3] > few})
        if not wide:
            break
        inside = F.array(*(F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("v") - a) / ((b - a) / bins)), F.lit(bins - 1)).alias("k"))) for i, (a, b, *_) in enumerate(wide)))
        counted = x.select("v", F.explode(F.filter(inside, lambda s: s.isNotNull())).alias("s")).groupBy("s.i", "s.k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        cells = {i: sorted((r["k"], r["a"], r["b"], r["n"]) for r in counted if r["i"] == i) for i in range(len(wide))}
        for r, b in list(open_.items()):
            if b in wide:
                below = b[2]
                for _, lo, hi, m in cells[wide.index(b)]:
                    if r < below + m:
                        open_[r] = (lo, hi, below, m)
                        break
                    below += m
    if open_:
        brackets = sorted(set(open_.values()))
        any_ = F.lit(False)
        for a, b, *_ in brackets:
            any_ = any_ | F.col("v").between(a, b)
        values = sorted(r["v"] for r in x.filter(any_).collect())
        found |= {r: [v for v in values if a <= v <= b][r - below] for r, (a, b, below, _) in open_.items()}
    return [found[math.floor(p)] + (found[min(math.floor(p) + 1, n - 1)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def percentiles(df: DataFrame, col: str, at: tuple[float, ...] = (0.16, 0.5, 0.84)) -> DataFrame:
    """``q, value``: exact percentiles with linear interpolation."""
    return df.sparkSession.createDataFrame(list(zip(map(float, at), exact_quantiles(df, col, at), strict=True)), "q double, value double")


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a column, in one row."""
    quartiles = exact_quantiles(df, col, (0.25, 0.5, 0.75))
    return df.agg(F.count(col).alias("n"), F.mean(col).alias("mean"), F.stddev(col).alias("std"), F.min(col).alias("min"), *(F.lit(v).cast("double").alias(f"p{p}") for p, v in zip((25, 50, 75), quartiles, strict=True)), F.max(col).alias("max"))


@tidy
def binned_medians(df: DataFrame, ordinate: str, abscissa: str, step: float) -> DataFrame:
    """``bin, n, ordinate, abscissa``: medians of bins of the ordinate that are open at both ends.

    The number of bins is the range over ``step``, rounded to the nearest, half
    to even, so the last part of the range may fall outside. Rows on an edge are
    in no bin; bins without rows are left out.
    """
    low, high = _range(df, ordinate)
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("ordinate"), F.lit(0.0).alias("abscissa")).limit(0)
    bins = round((high - low) / step)
    k = F.floor((F.col(ordinate) - low) / step).cast("long")
    inside = (F.col(ordinate) > low + k * step) & (F.col(ordinate) < low + (k + 1) * step) & (k < bins)
    kept = df.select(k.alias("bin"), F.col(ordinate).alias("o"), F.col(abscissa).alias("a"), inside.alias("in")).filter("in")
    middles = group_medians(kept, ["bin"], ["o", "a"]).select("bin", F.col("o").alias("ordinate"), F.col("a").alias("abscissa"))
    return kept.groupBy("bin").agg(F.count("*").alias("n")).join(middles, "bin").select("bin", "n", "ordinate", "abscissa")


@tidy
def hexagon_medians(df: DataFrame, x: str, y: str, value: str, gridsize: int = 100) -> DataFrame:
    """``lattice, hx, hy, n, median`` of a value by hexagon: a row goes to the nearer centre of two rectangular lattices."""
    x0, x1, y0, y1 = _range(df, x, y)
    if x0 is None:
        return df.select(*(F.lit(0).cast("long").alias(c) for c in ("lattice", "hx", "hy", "n")), F.lit(0.0).alias("median")).limit(0)
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    u, v = (F.col(x) - x0) / ((x1 - x0) / nx or 1.0), (F.col(y) - y0) / ((y1 - y0) / ny or 1.0)
    at = df.select(u.alias("u"), v.alias("v"), F.col(value).alias("value"))
    first = (F.col("u") - F.rint("u")) ** 2 + 3 * (F.col("v") - F.rint("v")) ** 2 < (F.col("u") - F.floor("u") - 0.5) ** 2 + 3 * (F.col("v") - F.floor("v") - 0.5) ** 2
    cell = at.select(F.when(first, 1).otherwise(2).cast("long").alias("lattice"), F.when(first, F.rint("u")).otherwise(F.floor("u")).cast("long").alias("hx"), F.when(first, F.rint("v")).otherwise(F.floor("v")).cast("long").alias("hy"), "value")
    keys = ["lattice", "hx", "hy"]
    middles = group_medians(cell, keys, ["value"]).withColumnRenamed("value", "median")
    return cell.groupBy(*keys).agg(F.count("value").alias("n")).join(middles, keys, "left").select(*keys, "n", "median")


def corner(df: DataFrame, params: list[str], bins: int = 20, at: tuple[float, ...] = (0.16, 0.5, 0.84)) -> DataFrame:
    """``kind, a, b, ia, ib, n, value``: what a corner plot of ``params`` shows.

    Rows of kind ``one`` are histograms of each parameter (``value``: density),
    ``two`` those of each pair, in the order given, and ``quantile`` each
    parameter's exact quantiles (``ib``: its place in ``at``). One pass counts all
    histograms. Rows with a null or NaN parameter are left out.
    """
    df = df.select(*(F.col(p).cast("double").alias(p) for p in params))
    good = F.lit(True)
    for p in params:
        good = good & F.col(p).isNotNull() & ~F.isnan(p)
    df = df.filter(good)
    ends = df.agg(F.count("*"), *(f(p) for p in params for f in (F.min, F.max))).first()
    total, width, index = ends[0], {}, {}
    schema = "kind string, a string, b string, ia long, ib long, n long, value double"
    if not total:
        return df.sparkSession.createDataFrame([], schema)
    for k, p in enumerate(params):
        low, high = ends[1 + 2 * k], ends[2 + 2 * k]
        width[p], index[p] = (high - low) / bins or 1.0, bin_index(p, low, high, bins)
    none = F.lit(None)
    cells = [(p, None) for p in params] + [(p, q) for k, p in enumerate(params) for q in params[k + 1 :]]
    made = [F.struct(F.lit(p).alias("a"), F.lit(q).cast("string").alias("b"), index[p].alias("ia"), (none if q is None else index[q]).cast("long").alias("ib"), F.lit(width[p] * (1 if q is None else width[q])).alias("size")) for p, q in cells]
    counted = df.select(F.explode(F.array(*made)).alias("e")).select("e.*").groupBy("a", "b", "ia", "ib", "size").agg(F.count("*").alias("n"))
    shown = counted.select(F.when(F.col("b").isNull(), "one").otherwise("two").alias("kind"), "a", "b", "ia", "ib", "n", (F.col("n") / (F.lit(total) * F.col("size"))).alias("value"))
    rows = [("quantile", p, None, None, i, None, v) for p in params for i, v in enumerate(exact_quantiles(df, p, at))]
    return shown.union(df.sparkSession.createDataFrame(rows, schema))
