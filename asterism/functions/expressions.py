"""Densities, rotations and geometry as pure column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: total to selective extinction.
R_V = 3.1
#: Edges of a ring that are written out as an expression of their own.
FEW_EDGES = 8


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_log(p: Column) -> Column:
    """ln with ln(0) = -inf and NaN kept (Spark's own gives null for 0)."""
    return F.when(p == 0, F.lit(float("-inf"))).when(F.isnan(p), p).otherwise(F.ln(p))


def bivariate_normal(x1, x2, mu1, mu2, s1, s2, rho) -> Column:
    """Density of a bivariate normal with standard deviations and correlation."""
    x1, x2, mu1, mu2, s1, s2, rho = map(_c, (x1, x2, mu1, mu2, s1, s2, rho))
    u, v, q = (x1 - mu1) / s1, (x2 - mu2) / s2, 1 - rho * rho
    return F.exp(-(u * u - 2 * rho * u * v + v * v) / (2 * q)) / (2 * math.pi * s1 * s2 * F.sqrt(q))


def covariance_normal(x1, x2, mu1, mu2, c11, c12, c22) -> Column:
    """The same density from a covariance matrix, by its closed-form inverse."""
    x1, x2, mu1, mu2, c11, c12, c22 = map(_c, (x1, x2, mu1, mu2, c11, c12, c22))
    det, a, b = c11 * c22 - c12 * c12, x1 - mu1, x2 - mu2
    return F.exp(-(c22 * a * a - 2 * c12 * a * b + c11 * b * b) / (2 * det)) / (2 * math.pi * F.sqrt(det))


def univariate_normal(x, mu, sigma, weight=1.0) -> Column:
    """A weighted normal density."""
    x, mu, sigma, weight = map(_c, (x, mu, sigma, weight))
    return weight * F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def observed(mu1, mu2, s1, s2, rho, e1, e2) -> tuple:
    """Parameters of a component after convolution with independent errors."""
    s1, s2, rho, e1, e2 = map(_c, (s1, s2, rho, e1, e2))
    o1, o2 = F.sqrt(s1 * s1 + e1 * e1), F.sqrt(s2 * s2 + e2 * e2)
    return mu1, mu2, o1, o2, rho * s1 * s2 / (o1 * o2)


def sky_separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance of two places in degrees, in arc seconds, stable at all distances."""
    ra1, dec1, ra2, dec2 = (F.radians(_c(x)) for x in (ra1, dec1, ra2, dec2))
    d = ra2 - ra1
    a = F.cos(dec2) * F.sin(d)
    b = F.cos(dec1) * F.sin(dec2) - F.sin(dec1) * F.cos(dec2) * F.cos(d)
    c = F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(d)
    return F.degrees(F.atan2(F.sqrt(a * a + b * b), c)) * 3600


@dataclass(frozen=True)
class Reddening:
    """Extinction coefficients of two bands and the turn-off point of the colour-magnitude diagram."""

    rband1: float = 0.903
    rband2: float = 0.597
    to_mag: float = 22.0
    to_color: float = 1.75

    @property
    def a1(self) -> float:
        return R_V * self.rband1

    @property
    def a2(self) -> float:
        return R_V * self.rband2

    @property
    def theta(self) -> float:
        return math.atan2(self.a1, self.a1 - self.a2)

    def rotate(self, band1, band2) -> tuple[Column, Column]:
        """Abscissa along the reddening vector and ordinate across it."""
        b, c = _c(band1) - self.to_mag, _c(band1) - _c(band2) - self.to_color
        cos, sin = math.cos(self.theta), math.sin(self.theta)
        return c * cos + b * sin, b * cos - c * sin

    def corrected(self, band1, band2, shift) -> tuple[Column, Column, Column]:
        """Bands moved back along the reddening vector by ``shift``, and the reddening that takes away."""
        cos, sin = math.cos(self.theta), math.sin(self.theta)
        b1, b2, m = _c(band1), _c(band2), _c(shift)
        return b1 - m * sin, b2 - m * sin + m * cos, m * cos / (self.a1 - self.a2)


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies strictly inside a ring of vertices (even-odd rule; not on an edge)."""
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    if len(edges) > FEW_EDGES:  # as data, so that the expression does not grow with the ring
        return _inside_many(x, y, edges)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in edges:
        if ay != by:
            at = ax + (y - ay) * ((bx - ax) / (by - ay))
            crossings = crossings + F.when(((y < ay) != (y < by)) & (x < at), 1).otherwise(0)
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on_edge = on_edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return (crossings % 2 == 1) & ~on_edge


def _inside_many(x: Column, y: Column, edges: list) -> Column:
    each = F.array(*(F.array(*map(_c, (ax, ay, bx, by, (bx - ax) / (by - ay) if ay != by else 0.0))) for (ax, ay), (bx, by) in edges))
    crossed = lambda e: ((y < e[1]) != (y < e[3])) & (x < e[0] + (y - e[1]) * e[4])
    on = lambda e: ((e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]) == 0) & x.between(F.least(e[0], e[2]), F.greatest(e[0], e[2])) & y.between(F.least(e[1], e[3]), F.greatest(e[1], e[3]))
    return (F.size(F.filter(each, crossed)) % 2 == 1) & ~F.exists(each, on)


def ring_area_centroid(ring: Column) -> Column:
    """Area and centroid (struct area, cx, cy) of an array of structs x, y by the shoelace formula; null for zero area."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("u"), (p["y"] + q["y"]).alias("v")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(terms, start, lambda s, t: F.struct((s["a"] + t["c"]).alias("a"), (s["x"] + t["c"] * t["u"]).alias("x"), (s["y"] + t["c"] * t["v"]).alias("y")))
    return F.transform(F.array(total), lambda s: F.when(s["a"] != 0, F.struct((F.abs(s["a"]) / 2).alias("area"), (s["x"] / (3 * s["a"])).alias("cx"), (s["y"] / (3 * s["a"])).alias("cy"))))[0]


def register_functions(spark) -> None:
    """The scalar kernels as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bivar_pdf(x1 DOUBLE, x2 DOUBLE, mu1 DOUBLE, mu2 DOUBLE, s1 DOUBLE, s2 DOUBLE, rho DOUBLE) RETURNS DOUBLE RETURN exp(-(pow((x1-mu1)/s1,2) - 2*rho*((x1-mu1)/s1)*((x2-mu2)/s2) + pow((x2-mu2)/s2,2)) / (2*(1-rho*rho))) / (2*pi()*s1*s2*sqrt(1-rho*rho))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION univar_pdf(x DOUBLE, mu DOUBLE, sigma DOUBLE, w DOUBLE) RETURNS DOUBLE RETURN w * exp(-pow((x-mu)/sigma,2)/2) / (sigma*sqrt(2*pi()))")
