"""Slices and summaries of sampler chains (walker, step, parameters, log_prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import group_quantiles


def slice_chain(chain: DataFrame, discard: int = 0, thin: int = 1) -> DataFrame:
    """Steps after the first ``discard``, each ``thin``-th: discard + thin - 1, discard + 2 thin - 1, ..."""
    return chain.filter((F.col("step") >= discard) & (F.pmod(F.col("step") - discard - (thin - 1), F.lit(thin)) == 0))


def best_step(chain: DataFrame) -> DataFrame:
    """The row of greatest log_prob, of several the one of least step, then walker: one partial aggregate."""
    order = F.struct("log_prob", (-F.col("step")).alias("s"), (-F.col("walker")).alias("w"))
    return chain.agg(F.max_by(F.struct(*chain.columns), order).alias("r")).select("r.*")


def parameter_quantiles(chain: DataFrame, at: tuple[float, ...] = (0.16, 0.5, 0.84)) -> DataFrame:
    """``param, q, value``: exact percentiles of every parameter of an array chain (theta), all in the same passes; null and NaN values are left out."""
    rows = chain.select(F.posexplode("theta").alias("param", "value")).select(F.col("param").cast("long").alias("param"), "value")
    return group_quantiles(rows, ["param"], "value", at)


def last_steps(chain: DataFrame) -> DataFrame:
    """The last step of every walker: one partial maximum."""
    return chain.groupBy("walker").agg(F.max_by(F.struct(*(c for c in chain.columns if c != "walker")), "step").alias("r")).select("walker", "r.*")


def trace(chain: DataFrame, params: list[str], burn_in: int = 0, walkers: list[int] | None = None, without: list[int] = ()) -> DataFrame:
    """``walker, step, param, value, part``: one row per parameter; part tells burn-in from kept steps.

    ``walkers`` names those to show (None: all), ``without`` those to leave out.
    """
    if walkers is not None:
        chain = chain.filter(F.col("walker").isin(list(walkers)))
    if without:
        chain = chain.filter(~F.col("walker").isin(list(without)))
    named = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params))
    part = F.when(F.col("step") < burn_in, "burn_in").otherwise("kept")
    return chain.select("walker", "step", part.alias("part"), F.explode(named).alias("e")).select("walker", "step", "e.param", "e.value", "part")
