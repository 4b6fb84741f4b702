"""Cubic splines through a few knots, evaluated as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fit(y: list[float], x: list[float]) -> tuple[list[float], list[list[float]]]:
    """Left ends of the pieces, and for each piece the coefficients of 1, t, t squared and t cubed with t = y - left end.

    Third derivatives agree at the second and the last but one knot. Two knots
    give a line, three a parabola. Knots must increase.
    """
    y, x = np.asarray(y, float), np.asarray(x, float)
    if len(y) < 2 or (np.diff(y) <= 0).any():
        raise ValueError("a spline needs two knots or more, increasing")
    h, n = np.diff(y), len(y)
    if n <= 3:
        c = np.polyfit(y - y[0], x, n - 1)[::-1]
        return [float(y[0])], [[*map(float, c), *[0.0] * (4 - n)]]
    slope = np.diff(x) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(a, b)
    return y[:-1].tolist(), [[float(x[i]), float(slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6), float(m[i] / 2), float((m[i + 1] - m[i]) / (6 * h[i]))] for i in range(n - 1)]


def evaluate(at: Column, starts: list[float], coefficients: list[list[float]]) -> Column:
    """The spline's value; beyond the knots the end pieces go on."""
    i = sum(((at >= s).cast("int") for s in starts[1:]), F.lit(0))
    pick = lambda k: F.get(F.array(*(F.lit(c[k]) for c in coefficients)), i)
    t = at - F.get(F.array(*map(F.lit, starts)), i)
    return pick(0) + t * (pick(1) + t * (pick(2) + t * pick(3)))
