"""A mixture of error-convolved bivariate normals, and what follows from its chain."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bivariate_normal, observed, safe_log
from ..shared import materialise, tidy
from .statistics import bracketed

#: Parameters of one component: means, deviations and correlation; k components carry k - 1 weights behind (one has its weight).
PER_COMPONENT = 5
#: Rows and draws that a task meets at most, their pairs that it computes at once, and draws among these.
DATA_ROWS, DRAW_ROWS, CELLS, TILE = 1 << 16, 1 << 14, 1 << 15, 1 << 10


def components_of(size: int) -> int:
    """Components of a parameter vector of ``size`` numbers."""
    k = 1 if size == PER_COMPONENT + 1 else (size + 1) // (PER_COMPONENT + 1)
    if size != (PER_COMPONENT + 1 if k == 1 else k * PER_COMPONENT + k - 1):
        raise ValueError(f"{size} numbers are no parameter vector")
    return k


def weighted_densities(theta: list, x1, x2, e1, e2) -> list[Column]:
    """Weight times density of each component; ``theta`` holds numbers or columns."""
    k = components_of(len(theta))
    own = theta[k * PER_COMPONENT :]
    last = F.lit(1.0)
    for w in own:
        last = last - w
    weights = own if k == 1 else [*own, last]
    col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    parts = [theta[i * PER_COMPONENT : (i + 1) * PER_COMPONENT] for i in range(k)]
    return [col(w) * bivariate_normal(x1, x2, *observed(*p, e1, e2)) for p, w in zip(parts, weights, strict=True)]


def log_prior(theta: list, low: list[float], high: list[float]) -> Column:
    """0 inside the closed box, with weights that sum to one at most; else minus infinity."""
    k, bad, total = components_of(len(theta)), F.lit(False), F.lit(0.0)
    for i, (t, a, b) in enumerate(zip(theta, low, high, strict=True)):
        t = t if isinstance(t, Column) else F.lit(float(t))
        bad = bad | (t < a) | (t > b)
        total = total + t if i >= k * PER_COMPONENT else total
    if k > 1:
        bad = bad | (1 - total < 0)
    return F.when(bad, F.lit(float("-inf"))).otherwise(0.0)


def fix_and_link(theta: Column, fixed: list[float | None] | None = None, links: list[tuple[int, int]] = ()) -> Column:
    """A parameter array with fixed values in place (None: free), then each link's source copied to its target, in order."""
    if fixed is not None:
        at = F.array(*(F.lit(v).cast("double") for v in fixed))
        theta = F.transform(theta, lambda v, i: F.coalesce(F.get(at, i), v))
    for source, target in links:
        theta = _linked(theta, source, target)
    return theta


def _linked(theta: Column, source: int, target: int) -> Column:
    return F.transform(theta, lambda v, i: F.when(i == target, F.get(theta, F.lit(source))).otherwise(v))


def effective(theta: list[float], fixed: list[float | None] | None, links: list[tuple[int, int]]) -> list[float]:
    """The same for a vector on the driver."""
    out = list(theta) if fixed is None else [t if f is None else f for t, f in zip(theta, fixed, strict=True)]
    for source, target in links:
        out[target] = out[source]
    return out


def log_likelihoods(data: DataFrame, thetas: list[list[float]], x=("pm_ra", "pm_dec", "epm_ra", "epm_dec")) -> DataFrame:
    """``param_id, log_likelihood`` of each vector over all rows, in one pass and one row per vector and task in the shuffle.

    A row of density zero makes minus infinity, one that is NaN makes NaN.
    """
    cols = [F.col(c) for c in x]
    sums = []
    for t in thetas:
        parts = weighted_densities(t, *cols)
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        sums.append(F.sum(safe_log(total)))
    row = data.agg(F.array(*sums).alias("v"))
    return row.select(F.posexplode("v").alias("param_id", "log_likelihood")).select(F.col("param_id").cast("long"), "log_likelihood")


def log_posteriors(data: DataFrame, thetas: list[list[float]], low: list[float], high: list[float], fixed=None, links=(), x=("pm_ra", "pm_dec", "epm_ra", "epm_dec")) -> DataFrame:
    """``param_id, log_posterior``: the prior judges the raw vector; the likelihood of the vector after fixing and linking is computed only where the prior allows."""
    def allowed(t):
        k = components_of(len(t))
        return all(a <= v <= b for v, a, b in zip(t, low, high, strict=True)) and (k == 1 or 1 - sum(t[k * PER_COMPONENT :]) >= 0)

    ids = [i for i, t in enumerate(thetas) if allowed(t)]
    found = log_likelihoods(data, [effective(thetas[i], fixed, links) for i in ids], x) if ids else data.select(F.lit(0).cast("long").alias("param_id"), F.lit(0.0).alias("log_likelihood")).limit(0)
    named = F.array(*(F.lit(i).cast("long") for i in ids or [0]))
    inside = found.select(F.get(named, F.col("param_id").cast("int")).alias("param_id"), F.col("log_likelihood").alias("log_posterior"))
    outside = [i for i in range(len(thetas)) if i not in ids]
    spark = data.sparkSession
    return inside.union(spark.createDataFrame([(i, -math.inf) for i in outside], "param_id long, log_posterior double")) if outside else inside


def _dealt(data: DataFrame, draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``data`` and ``draws`` (theta) in groups (``_part``, ``_block``) of DATA_ROWS and DRAW_ROWS at most, which hold every pair of a row and a draw once.

    Both are written first, so that rows are dealt by their place, however many
    are equal, and alike when a task is run again.
    """
    return _dealt_by_place(data, draws.select(F.col("theta").cast("array<double>").alias("theta")))


def _dealt_by_place(data: DataFrame, draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    data, draws = materialise(data), materialise(draws)
    n, m = data.count(), draws.count()
    parts = -(-n // DATA_ROWS) or 1
    cores = data.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-m // DRAW_ROWS), min(-(-m // 256), -(-2 * cores // parts))) or 1
    own = lambda k: F.pmod(F.monotonically_increasing_id(), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = data.withColumn("_part", own(parts)).withColumn("_block", every(blocks))
    right = draws.withColumn("_block", own(blocks)).withColumn("_part", every(parts))
    tasks = min(parts * blocks, 4 * cores)  # of few bytes but much work: not to be merged
    return left.repartition(tasks, "_part", "_block"), right.repartition(tasks, "_part", "_block")


def _vectors(draws: pa.Table, size: int) -> np.ndarray:
    """(draws, size) parameters."""
    lists = draws["theta"].combine_chunks()
    flat = lists.flatten()
    if len(flat) != size * len(lists) or flat.null_count or lists.null_count:
        raise ValueError(f"draws need {size} numbers each")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def _weights(thetas: np.ndarray) -> np.ndarray:
    """(draws, k) weights of the components."""
    k = components_of(thetas.shape[1])
    own = thetas[:, k * PER_COMPONENT :]
    return own if k == 1 else np.column_stack([own, 1.0 - own.sum(axis=1)])


def _shares(x: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """(rows, draws, k): each row's share of each component; NaN where all densities vanish."""
    k, weights = components_of(thetas.shape[1]), _weights(thetas)
    out = np.empty((len(x), len(thetas), k))
    x1, x2, e1, e2 = (c[:, None] for c in x.T)
    with np.errstate(all="ignore"):
        for c in range(k):
            m1, m2, s1, s2, rho = thetas[None, :, c * PER_COMPONENT : (c + 1) * PER_COMPONENT].transpose(2, 0, 1)
            o1, o2 = np.sqrt(s1 * s1 + e1 * e1), np.sqrt(s2 * s2 + e2 * e2)
            r = rho * s1 * s2 / (o1 * o2)
            u, v, q = (x1 - m1) / o1, (x2 - m2) / o2, 1 - r * r
            out[:, :, c] = weights[:, c] * np.exp(-(u * u - 2 * r * u * v + v * v) / (2 * q)) / (2 * np.pi * o1 * o2 * np.sqrt(q))
        return out / out.sum(axis=2, keepdims=True)


def _share_sums(x: np.ndarray, thetas: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, k) sums of each row's shares over draws, each ``times`` as often, and (rows,) how many draws count.

    As ``_shares``, but tile by tile in the same few arrays, which stay in a core's cache.
    """
    k, n = components_of(thetas.shape[1]), len(x)
    total, count = np.zeros((n, k)), np.zeros(n, np.int64)
    wide = min(TILE, CELLS, len(thetas)) or 1
    tall = max(1, CELLS // wide)
    held = np.empty((5 + k, tall, wide))
    x1, x2, e1, e2 = (c[:, None] for c in x.T)
    e1, e2 = e1 * e1, e2 * e2
    with np.errstate(all="ignore"):
        for j in range(0, len(thetas), wide):
            t, often = thetas[j : j + wide], times[j : j + wide]
            weights = _weights(t).T.copy()
            parts = [t[:, c * PER_COMPONENT : (c + 1) * PER_COMPONENT].T.copy() for c in range(k)]
            for i in range(0, n, tall):
                at = slice(i, i + tall)
                a, b, u, v, q, *shares = held[:, : min(tall, n - i), : len(t)]
                for p, w, (m1, m2, s1, s2, rho) in zip(shares, weights, parts, strict=True):
                    np.sqrt(np.add(e1[at], s1 * s1, out=a), out=a)
                    np.sqrt(np.add(e2[at], s2 * s2, out=b), out=b)
                    np.divide(np.subtract(x1[at], m1, out=u), a, out=u)
                    np.divide(np.subtract(x2[at], m2, out=v), b, out=v)
                    np.multiply(a, b, out=a)
                    r = np.divide(rho * s1 * s2, a, out=b)
                    np.subtract(1.0, np.multiply(r, r, out=q), out=q)
                    # u*u - 2*r*u*v + v*v over q is the square of u - r*v over q, and v*v
                    np.subtract(u, np.multiply(r, v, out=b), out=u)
                    np.divide(np.multiply(u, u, out=u), q, out=u)
                    np.add(u, np.multiply(v, v, out=v), out=u)
                    np.multiply(np.exp(np.multiply(u, -0.5, out=u), out=u), w, out=u)
                    np.divide(u, np.multiply(a, np.sqrt(q, out=q), out=a), out=p)
                every = a
                every[:] = shares[0]
                for p in shares[1:]:
                    every += p
                bad = False
                for p in shares:
                    np.divide(p, every, out=p)
                    bad = bad | np.isnan(p)
                some = bad.any()
                for c, p in enumerate(shares):
                    if some:
                        p[bad] = 0.0
                    total[at, c] += p @ often
                count[at] += (~bad) @ often if some else often.sum()
    return total, count


@tidy
def mean_membership(data: DataFrame, key: str, draws: DataFrame, size: int, x=("pm_ra", "pm_dec", "epm_ra", "epm_dec")) -> DataFrame:
    """``key, comp, p, draws``: each row's mean share of each component over all draws of a chain (``draws``: theta, an array of ``size`` numbers).

    Draws under which all densities vanish don't count; ``draws`` has how many
    do, and p is null without any, as for rows with a null. Rows of one key count together. Equal draws, as
    a chain that stays where it is has them, are computed once and count as often as they occur. A task multiplies
    a block of rows by a block of draws and returns sums, so nothing is made or
    shuffled for each row and draw.
    """
    k = components_of(size)
    kind = data.schema[key].dataType.simpleString()
    different = draws.groupBy(F.col("theta").cast("array<double>").alias("theta")).agg(F.count("*").alias("times"))
    left, right = _dealt_by_place(data.select(key, *(F.col(c).cast("double").alias(c) for c in x)), different)

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        thetas, n = _vectors(draws, size), rows.num_rows
        at = np.column_stack([rows[c].to_numpy() for c in x]).astype(float).reshape(n, len(x))
        total, count = _share_sums(at, thetas, draws["times"].to_numpy())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(total.ravel()))
        return pa.table({key: rows[key], "s": sums, "n": pa.array(count)})

    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, f"`{key}` {kind}, s array<double>, n long")
    sums = found.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(c))).alias(f"s{c}") for c in range(k)))
    each = F.array(*(F.struct(F.lit(c).cast("long").alias("comp"), F.try_divide(F.col(f"s{c}"), F.col("n")).alias("p")) for c in range(k)))
    return sums.select(key, F.col("n").alias("draws"), F.explode(each).alias("e")).select(key, "e.comp", "e.p", "draws")


@tidy
def component_membership(data: DataFrame, key: str, draws: DataFrame, size: int, x=("pm_ra", "pm_dec", "epm_ra", "epm_dec")) -> DataFrame:
    """``key, draw, comp, p``: each row's share of each component under each draw; null where all densities vanish.

    This is a row for every row, draw and component; ``mean_membership`` has
    the mean without it. ``draws``: draw, theta (an array of ``size`` numbers).
    """
    k = components_of(size)
    numbered = materialise(draws.select("draw", F.col("theta").cast("array<double>").alias("theta")))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((data, key), (draws, "draw"))]
    tagged = numbered.select(F.struct("draw", "theta").alias("theta"))
    left, right = _dealt_by_place(data.select(key, *(F.col(c).cast("double").alias(c) for c in x)), tagged)

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        both = draws["theta"].combine_chunks()
        thetas, n = _vectors(pa.table({"theta": both.field("theta")}), size), rows.num_rows
        found = _shares(np.column_stack([rows[c].to_numpy() for c in x]).astype(float).reshape(n, len(x)), thetas)
        m = len(thetas)
        p = found.ravel()
        return pa.table({
            key: rows[key].combine_chunks().take(pa.array(np.repeat(np.arange(n), m * k))),
            "draw": both.field("draw").take(pa.array(np.tile(np.repeat(np.arange(m), k), n))),
            "comp": pa.array(np.tile(np.arange(k), n * m)),
            "p": pa.array(p, mask=np.isnan(p)),
        })

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, f"`{key}` {kinds[0]}, draw {kinds[1]}, comp long, p double")


@tidy
def density_bands(grid: DataFrame, draws: DataFrame, size: int, errors: tuple[float, float] = (0.0, 0.0), at: tuple[float, float] = (0.05, 0.95), few: int = 4096) -> DataFrame:
    """``axis, i, component, low, high``: percentiles over all draws of each component's density along each axis, and of their sum (component -1).

    ``grid``: axis (0 or 1), i, x; ``draws``: theta. A component is a normal with
    its weight, widened by the axis's error. Tasks multiply blocks of places by
    blocks of draws and return ends, counts by bin, or the values in what is left
    of a bracket, so no buffer holds the draws of a place.
    """
    k = components_of(size)
    names = np.array([-1, *range(k)])
    held = materialise(grid.select(F.col("axis").cast("long").alias("axis"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")))
    on = ["axis", "i", "component"]

    def densities(axis: int, x: float, thetas: np.ndarray, weights: np.ndarray) -> np.ndarray:
        mu = thetas[:, axis : k * PER_COMPONENT : PER_COMPONENT]
        s = thetas[:, 2 + axis : k * PER_COMPONENT : PER_COMPONENT]
        with np.errstate(all="ignore"):
            s = np.sqrt(s * s + errors[axis] ** 2)
            p = weights * np.exp(-(((x - mu) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))
        return np.column_stack([p.sum(axis=1), p])

    def over(asked: DataFrame, make, schema: str) -> DataFrame:
        """``make(values, row)`` of each place's component and block of draws; ``asked``: axis, i, x, component, and brackets if there are any."""
        left, right = _dealt(asked, draws)

        def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
            thetas, out, last = _vectors(draws, size), [], None
            weights = _weights(thetas)
            for r in sorted(rows.to_pylist(), key=lambda r: (r["axis"], r["i"])):
                if last != (r["axis"], r["i"]):
                    last, p = (r["axis"], r["i"]), densities(r["axis"], r["x"], thetas, weights)
                v = p[:, int(np.flatnonzero(names == r["component"])[0])]
                out += make(v[~np.isnan(v)], r)
            fields = [f.split() for f in schema.split(", ")]
            return pa.table({name: pa.array([o[j] for o in out], {"long": pa.int64(), "double": pa.float64()}[kind]) for j, (name, kind) in enumerate(fields)})

        return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, schema)

    places = held.withColumn("component", F.explode(F.array(*(F.lit(int(c)).cast("long") for c in names))))
    key = lambda r: (r["axis"], r["i"], r["component"])
    head = "axis long, i long, component long"
    ends = over(places, lambda v, r: [(*key(r), len(v), float(v.min()), float(v.max()))] if len(v) else [], f"{head}, n long, a double, b double")
    ends = ends.groupBy(*on).agg(F.sum("n").alias("_n"), F.min("a").alias("_a"), F.max("b").alias("_b"))
    put = lambda brackets: brackets.join(held, ["axis", "i"])

    def count(wide: DataFrame, bins: int) -> DataFrame:
        def make(v: np.ndarray, r: dict) -> list[tuple]:
            v = np.sort(v[(v >= r["_a"]) & (v <= r["_b"])])
            if not len(v):
                return []
            b = np.minimum((v - r["_a"]) // ((r["_b"] - r["_a"]) / bins), bins - 1).astype(int)
            heads = np.flatnonzero(np.r_[True, np.diff(b) > 0])
            tails = np.r_[heads[1:], len(v)]
            return [(*key(r), r["_q"], int(b[s]), int(e - s), float(v[s]), float(v[e - 1])) for s, e in zip(heads, tails, strict=True)]

        cells = over(put(wide), make, f"{head}, _q double, _k long, _m long, _a double, _b double")
        return cells.groupBy(*on, "_q", "_k").agg(F.sum("_m").alias("_m"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))

    def gather(left: DataFrame) -> DataFrame:
        return over(put(left), lambda v, r: [(*key(r), r["_q"], x) for x in v[(v >= r["_a"]) & (v <= r["_b"])].tolist()], f"{head}, _q double, _v double")

    found = bracketed(on, ends, count, gather, at, few)
    low, high = (F.max(F.when(F.col("q") == float(q), F.col("value"))) for q in at)
    return found.groupBy(*on).agg(low.alias("low"), high.alias("high"))
