"""Ensemble samplers for the mixture: differential-evolution and snooker moves on half ensembles in turn."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixture import PER_COMPONENT, components_of, effective
from ..shared import discard, materialise, new_path

#: Steps of walkers that the driver holds before it adds them to the chain's table.
HELD_ROWS = 10_000
#: Observations are written once in files of about so many rows; passes over few of them start few tasks.
TASK_ROWS = 50_000
TASKS_PER_CORE = 4
#: The unit in which log likelihoods of tasks are added.
MICRO = 1e-6
SNOOKER = 0.2
COLUMNS = ("pm_ra", "pm_dec", "epm_ra", "epm_dec")
STATE = "done int, chain_id int, places array<array<double>>, logs array<double>, random string"
CHAIN = "chain_id long, step int, walker int, theta array<double>, log_prob double"


def start(walkers: int, low: list[float], high: list[float], seed: int) -> np.ndarray:
    """Walkers spread evenly over the box, with weights that sum to one at most."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(low, high, (walkers, len(low)))
    k = components_of(len(low))
    if k > 1:
        w = p[:, k * PER_COMPONENT :]
        p[:, k * PER_COMPONENT :] = w / np.maximum(1.0, w.sum(axis=1, keepdims=True) * 1.000001)
    return p


def allowed(theta: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether the prior allows a vector: inside the closed box, with weights that sum to one at most."""
    k = components_of(len(theta))
    return bool((theta >= low).all() and (theta <= high).all() and (k == 1 or 1 - theta[k * PER_COMPONENT :].sum() >= 0))


def log_likelihood(theta: np.ndarray, data: np.ndarray) -> float:
    """Log likelihood of one vector, fixed and linked before, over (n, 4) observations."""
    k = components_of(len(theta))
    x, y, ex, ey = data.T
    own = theta[k * PER_COMPONENT :]
    weights = own if k == 1 else [*own, 1 - own.sum()]
    total = np.zeros(len(data))
    for i, w in enumerate(weights):
        mx, my, sx, sy, rho = theta[i * PER_COMPONENT : (i + 1) * PER_COMPONENT]
        ox, oy = np.sqrt(sx * sx + ex * ex), np.sqrt(sy * sy + ey * ey)
        r = rho * sx * sy / (ox * oy)
        u, v, q = (x - mx) / ox, (y - my) / oy, 1 - r * r
        total += w * np.exp(-(u * u - 2 * r * u * v + v * v) / (2 * q)) / (2 * np.pi * ox * oy * np.sqrt(q))
    with np.errstate(divide="ignore"):
        return float(np.log(total).sum())


def _sums(thetas: np.ndarray):
    """Log likelihoods of all vectors over one task's rows, in whole MICRO; null where they vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(thetas))
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += [log_likelihood(t, data) for t in thetas]
        units = [round(v / MICRO) if math.isfinite(v) else None for v in total.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([units], pa.list_(pa.int64()))], ["units"])

    return run


def log_posteriors(rows: DataFrame, thetas: np.ndarray, low: np.ndarray, high: np.ndarray, fixed=None, links=()) -> np.ndarray:
    """Log posterior of each of (n, d) vectors over ``rows`` (four columns), in one pass without a shuffle.

    The prior judges the raw vector, the likelihood sees it fixed and linked.
    The pass has TASKS_PER_CORE tasks a core at most, each over its share of the
    rows, and the driver adds one number of each vector and task: that grows with
    the cluster, not with the rows. The numbers are whole millionths, so their
    order does not matter; a vector under which some row has no density, or none
    that is a number, gets minus infinity.
    """
    found = np.full(len(thetas), -math.inf)
    inside = [i for i, t in enumerate(thetas) if allowed(t, low, high)]
    if inside:
        asked = np.array([effective(thetas[i].tolist(), fixed, links) for i in inside])
        tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
        parts = [r["units"] for r in rows.coalesce(tasks).mapInArrow(_sums(asked), "units array<long>").collect()]
        for i, units in zip(inside, zip(*parts, strict=True) if parts else [()] * len(inside), strict=True):
            found[i] = -math.inf if None in units else sum(units) * MICRO
    return found


def propose(now: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """New places of half an ensemble from pairs of the other half, with log corrections of the acceptance.

    Differential evolution (ter Braak, 2006; Nelson et al., 2014): a step along
    the difference of two walkers, of 2.38 / sqrt(2 d). Snooker (ter Braak and
    Vrugt, 2008): a step along the line to a walker, by the difference of two
    others projected on it.
    """
    n, d = now.shape
    out, fix = now.copy(), np.zeros(n)
    gamma = 2.38 / math.sqrt(2 * d)
    for i in range(n):
        if rng.random() < SNOOKER and len(other) >= 3:
            z, a, b = other[rng.choice(len(other), 3, replace=False)]
            line = now[i] - z
            length = np.linalg.norm(line)
            if length:
                u = line / length
                out[i] = now[i] + 1.7 * u * (u @ a - u @ b)
                far = np.linalg.norm(out[i] - z)
                fix[i] = (d - 1) * (math.log(far) - math.log(length)) if far else -math.inf
        else:
            a, b = other[rng.choice(len(other), 2, replace=False)]
            out[i] = now[i] + gamma * (1 + 1e-5 * rng.standard_normal()) * (a - b)
    return out, fix


def advance(places: list[np.ndarray], logs: list[np.ndarray], rngs: list[np.random.Generator], evaluate) -> None:
    """One step of all ensembles, in place; ``evaluate`` takes the (n, d) vectors proposed for half of each at once."""
    half = len(places[0]) // 2
    for mine, theirs in ((slice(0, half), slice(half, None)), (slice(half, None), slice(0, half))):
        offers = [propose(p[mine], p[theirs], rng) for p, rng in zip(places, rngs, strict=True)]
        found = np.split(evaluate(np.concatenate([new for new, _ in offers])), len(places))
        for p, log_p, rng, (new, fix), log_new in zip(places, logs, rngs, offers, found, strict=True):
            with np.errstate(invalid="ignore"):
                accept = np.log(rng.random(len(new))) < fix + log_new - log_p[mine]
            p[mine] = np.where(accept[:, None], new, p[mine])
            log_p[mine] = np.where(accept, log_new, log_p[mine])


def start_table(spark: SparkSession, chains: int, walkers: int, low, high, seed: int = 0) -> DataFrame:
    """``chain_id, step, walker, theta, log_prob`` (null) of the walkers before the first step."""
    rows = [(c, 0, w, t, None) for c in range(chains) for w, t in enumerate(start(walkers, low, high, seed + c).tolist())]
    return spark.createDataFrame(rows, CHAIN)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table, or None if nothing was written there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else None


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The steps (CHAIN columns) of a chain that ``sample`` stores at ``path``, up to the last state that was stored with them."""
    state = _read(spark, f"{path}/state", STATE)
    done = None if state is None else state.agg(F.max("done")).first()[0]
    if done is None:
        return spark.createDataFrame([], CHAIN)
    return spark.read.schema(f"{CHAIN}, block int").parquet(f"{path}/chain").filter((F.col("block") < done) & (F.col("step") < done)).drop("block")


def _store(spark: SparkSession, path: str, first: int, done: int, held: list[tuple], places: list, logs: list, rngs: list) -> None:
    """A block of steps, then the walkers behind it. A block without its state is written anew when the run goes on, so a loss in between costs that block alone."""
    spark.createDataFrame(held, CHAIN).coalesce(1).write.mode("overwrite").parquet(f"{path}/chain/block={first}")
    rows = [(done, c, p.tolist(), v.tolist(), json.dumps(r.bit_generator.state)) for c, (p, v, r) in enumerate(zip(places, logs, rngs, strict=True))]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")


def sample(data: DataFrame, chains: int, walkers: int, steps: int, low, high, fixed=None, links=(), seed: int = 0, columns=COLUMNS, path: str | None = None, start_at: np.ndarray | None = None, reset: bool = False) -> DataFrame:
    """Chains of independent ensembles (CHAIN columns) over observations; rows with a null are left out.

    Each half step is one distributed pass over the observations for the
    proposals of all ensembles. The driver holds the walkers and the steps not
    yet written: the chain is a table that grows by HELD_ROWS rows at a time,
    and with each block goes a state of walkers, logs and random numbers. With
    ``path`` a stored run is continued by ``steps`` more, as if it had never
    stopped, or begun anew with ``reset``. ``start_at`` (chains, walkers,
    parameters) are the walkers of a new run; else they are spread over the box.
    """
    spark, low, high = data.sparkSession, np.array(low, float), np.array(high, float)
    path = path or new_path(spark)
    rows = data.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    rows = materialise(rows.repartition(-(-rows.count() // TASK_ROWS) or 1))
    evaluate = lambda v: log_posteriors(rows, v, low, high, fixed, links)
    stored = None if reset else _read(spark, f"{path}/state", STATE)
    last = [] if stored is None else stored.filter(F.col("done") == stored.agg(F.max("done")).first()[0]).orderBy("chain_id").collect()
    if last:
        if len(last) != chains or np.array(last[0]["places"]).shape != (walkers, len(low)):
            raise ValueError("the stored run has other chains, walkers or parameters")
        begin, places, logs, rngs = last[0]["done"], [np.array(r["places"]) for r in last], [np.array(r["logs"]) for r in last], []
        for r in last:
            rng = np.random.default_rng()
            rng.bit_generator.state = json.loads(r["random"])
            rngs.append(rng)
    else:
        for name in ("state", "chain"):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        places = [start(walkers, low, high, seed + c) for c in range(chains)] if start_at is None else [np.array(p, float) for p in start_at]
        if [p.shape for p in places] != [(walkers, len(low))] * chains:
            raise ValueError("walkers to start at need one row of parameters each, for every chain")
        begin, rngs = 0, [np.random.default_rng(seed + c) for c in range(chains)]
        logs = np.split(evaluate(np.concatenate(places)), chains)
        _store(spark, path, 0, 0, [], places, logs, rngs)
    held, first = [], begin
    for s in range(begin, begin + steps):
        advance(places, logs, rngs, evaluate)
        held += [(c, s, w, t, v) for c in range(chains) for w, (t, v) in enumerate(zip(places[c].tolist(), logs[c].tolist(), strict=True))]
        if len(held) >= HELD_ROWS or s == begin + steps - 1:
            _store(spark, path, first, s + 1, held, places, logs, rngs)
            held, first = [], s + 1
    discard(rows)
    return read_chain(spark, path)
