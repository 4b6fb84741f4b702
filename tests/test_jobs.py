import math

import numpy as np
import pytest
from asterism.functions.expressions import Reddening
from asterism.jobs import membership, sampler
from asterism.operators import decontamination as dc
from asterism.operators import mixture, neighbours, statistics
from asterism.sources import catalogues
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.mark.parametrize("rate", [0.0, 0.4, 1.0, 3.4, 9.0])
def test_sampling_agrees_with_its_mean(spark, rate):
    cluster = spark.createDataFrame([(i, 1) for i in range(7)], "id long, region long")
    rates = spark.createDataFrame([(1, rate), (2, 5.0)], "region long, rate double")
    want = {r["id"]: r["membership"] for r in dc.expected_membership(rates, cluster).collect()}
    got = {r["id"]: r["membership"] for r in dc.sampled_membership(rates, cluster, 2000).collect()}
    assert len(want) == 7 and (len(got) == 7 or rate == 0)
    p = 1 - want[0]
    assert all(abs(got.get(i, 1.0) - want[i]) < 5 * math.sqrt(p * (1 - p) / 2000) + 1e-9 for i in want)
    assert dc.expected_membership(rates.limit(0), cluster).count() == 0


def test_sampling_in_blocks(spark, monkeypatch):
    """Regions of many blocks lose as many stars in all as those of one, and each star as often as the others; stars in two regions lose both; the same however rows lie."""
    cluster = spark.createDataFrame([(i, 1) for i in range(120)] + [(i, -2) for i in range(100, 110)] + [(500, 3)], "id long, region long")
    rates = spark.createDataFrame([(1, 30.3), (-2, 2.0), (3, 0.0), (4, 7.0)], "region long, rate double")
    found = []
    for size in (4096, 7):
        monkeypatch.setattr(dc, "BLOCK", size)
        got = {r["id"]: r["membership"] for r in dc.sampled_membership(rates, cluster, 1500).collect()}
        assert got == {r["id"]: r["membership"] for r in dc.sampled_membership(rates, cluster.repartition(7), 1500).collect()}
        want = {r["id"]: r["membership"] for r in dc.expected_membership(rates, cluster).collect()}
        assert set(got) == set(range(120))
        assert all(abs(got[i] - want[i]) < 5 * math.sqrt(0.25 / 1500) for i in got)
        chi = sum((got[i] - want[i]) ** 2 / (0.2525 * 0.7475 / 1500) for i in range(100))
        assert 50 < chi < 170
        found.append(sum(1 - m for m in got.values()))
    assert found[0] == pytest.approx(found[1])  # draws take the same numbers
    assert dc.sampled_membership(rates.limit(0), cluster, 10).count() == 0


def test_update_keeps_the_rest(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 0.5)], "id long, membership double")
    new = spark.createDataFrame([(2, 0.2)], "id long, membership double")
    assert {r["id"]: r["membership"] for r in dc.update_membership(old, new).collect()} == {1: 1.0, 2: 0.2}


def test_clipping_without_spread(spark):
    df = spark.createDataFrame([(1, 2.0)] * 3 + [(2, v) for v in (1.0, 1.1, 0.9, 1.0, 1.05, 50.0)], "k long, v double")
    got = {r["k"]: (r["n_kept"], r["median"]) for r in neighbours.clipped_medians(df, "k", "v").collect()}
    assert got == {1: (0, 2.0), 2: (5, 1.0)}


def test_quantiles_of_many_rows_and_ties(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=3000), np.full(4000, 0.25), rng.exponential(1e6, 500), [-1e9]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
    at = (0.0, 0.01, 0.16, 0.5, 0.84, 0.999, 1.0)
    for few in (10, 10**6):
        assert statistics.exact_quantiles(df, "x", at, few=few, bins=16) == pytest.approx(np.quantile(v, at).tolist())
    assert statistics.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_summaries_of_nothing(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert statistics.histogram(df, "x").count() == statistics.histogram2d(df, "x", "y").count() == statistics.hexagon_medians(df, "x", "y", "x").count() == statistics.binned_medians(df, "x", "y", 0.1).count() == 0
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert [tuple(r)[:2] for r in statistics.histogram(one, "x").collect()] == [(0, 2)]
    assert sum(r["n"] for r in statistics.histogram2d(one, "x", "y").collect()) == 2


def test_densities_integrate_and_shares_sum_to_one(spark):
    df = catalogues.photometry(spark, "/root/testdata/sf0.001")
    h = statistics.histogram(df, "band1", 50)
    low, high = df.agg(F.min("band1"), F.max("band1")).first()
    assert h.agg(F.sum("density")).first()[0] * (high - low) / 50 == pytest.approx(1)
    s = catalogues.stars(spark, "/root/testdata/sf0.001")
    base = [-3.0, -6.0, 0.3, 0.3, 0.0, -2.5, -5.5, 1.0, 1.2, 0.2]
    draws = spark.createDataFrame([(i, [*base, i / 200]) for i in range(150)], "draw long, theta array<double>")
    shares = mixture.component_membership(s, "star_id", draws, 11)
    rows = shares.groupBy("star_id", "draw").agg(F.sum("p").alias("t")).collect()
    assert len(rows) == s.count() * 150 and all(r["t"] == pytest.approx(1) for r in rows)
    means = {(r["star_id"], r["comp"]): (r["p"], r["draws"]) for r in mixture.mean_membership(s, "star_id", draws, 11).collect()}
    want = {(r["star_id"], r["comp"]): r["p"] for r in shares.groupBy("star_id", "comp").agg(F.avg("p").alias("p")).collect()}
    assert {k: v[0] for k, v in means.items()} == pytest.approx(want) and {v[1] for v in means.values()} == {150}
    assert {r["draw"] for r in shares.select("draw").distinct().collect()} == set(range(150))


def test_membership_of_odd_rows_in_many_blocks(spark, monkeypatch):
    """Nulls, a row under which all densities vanish, equal rows, and blocks of few rows and draws; densities as the column expressions give them."""
    monkeypatch.setattr(mixture, "DATA_ROWS", 3)
    monkeypatch.setattr(mixture, "DRAW_ROWS", 7)
    monkeypatch.setattr(mixture, "CELLS", 4)
    rows = [(i, -3.0 + i / 4, -6.0, 0.1, 0.2) for i in range(8)] + [(8, 1e9, 0.0, 0.1, 0.1), (9, None, 0.0, 0.1, 0.1), (3, -3.0 + 3 / 4, -6.0, 0.1, 0.2)]
    data = spark.createDataFrame(rows, "id long, pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    thetas = [[-3.0, -6.0, 0.3, 0.3, 0.1, -2.5 - i / 9, -5.5, 1.0, 1.2, 0.2, i / 30] for i in range(30)]
    draws = spark.createDataFrame([(t,) for t in thetas], "theta array<double>")
    got = {(r["id"], r["comp"]): (r["p"], r["draws"]) for r in mixture.mean_membership(data, "id", draws, 11).collect()}
    assert got[8, 0] == got[9, 1] == (None, 0) and len(got) == 20 and got[3, 0][1] == 60
    cols = [F.col(c) for c in ("pm_ra", "pm_dec", "epm_ra", "epm_dec")]
    parts = [mixture.weighted_densities(t, *cols) for t in thetas]
    mean = sum((p[1] / (p[0] + p[1]) for p in parts), F.lit(0.0)) / len(parts)
    for r in data.filter("id < 8").select("id", mean.alias("p")).collect():
        assert got[r["id"], 1][0] == pytest.approx(r["p"])
    assert mixture.mean_membership(data.limit(0), "id", draws, 11).count() == 0
    assert {r["p"] for r in mixture.mean_membership(data, "id", draws.limit(0), 11).collect()} == {None}
    with pytest.raises(Exception, match="need 11 numbers"):
        mixture.mean_membership(data, "id", draws.selectExpr("slice(theta, 1, 10) theta"), 11).count()


@pytest.mark.parametrize("few", [3, 4096])
def test_bands_are_percentiles_of_all_draws(spark, few):
    rng = np.random.default_rng(4)
    base = np.array([-3.0, -6.0, 0.3, 0.3, 0.0, -2.5, -5.5, 1.0, 1.2, 0.2, 0.6])
    thetas = base + rng.random((300, 11)) * 0.1
    thetas[100:140] = thetas[100]  # ties
    draws = spark.createDataFrame([(t.tolist(),) for t in thetas], "theta array<double>")
    places = [(a, i, -3.0 - 3 * a + 0.4 * i) for a in (0, 1) for i in range(4)]
    grid = spark.createDataFrame(places, "axis long, i long, x double")
    got = {(r["axis"], r["i"], r["component"]): (r["low"], r["high"]) for r in mixture.density_bands(grid, draws, 11, (0.1, 0.3), (0.05, 0.9), few=few).collect()}
    assert len(got) == 24
    for axis, i, x in places:
        each = []
        for c in (0, 1):
            s = np.sqrt(thetas[:, 5 * c + 2 + axis] ** 2 + (0.1, 0.3)[axis] ** 2)
            w = thetas[:, 10] if c == 0 else 1 - thetas[:, 10]
            each.append(w * np.exp(-(((x - thetas[:, 5 * c + axis]) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)))
        for c, v in ((-1, each[0] + each[1]), (0, each[0]), (1, each[1])):
            assert got[axis, i, c] == pytest.approx(tuple(np.quantile(v, [0.05, 0.9])), rel=1e-9)


@pytest.mark.parametrize("few", [2, 5, 4096])
def test_group_quantiles(spark, few):
    rng = np.random.default_rng(6)
    values = {0: rng.normal(size=500), 1: np.repeat([1.0, 2.0], [40, 3]), 2: np.array([7.0]), 3: rng.integers(0, 4, 200).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(0, None), (2, float("nan")), (4, None)]
    found = statistics.group_quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", (0.0, 0.16, 0.5, 0.84, 1.0), few, 7)
    got = {(r["g"], r["q"]): r["value"] for r in found.collect()}
    assert got == pytest.approx({(k, q): np.quantile(vs, q) for k, vs in values.items() for q in (0.0, 0.16, 0.5, 0.84, 1.0)})


def test_posterior_on_driver_and_in_spark(spark):
    rng = np.random.default_rng(0)
    rows = [(*rng.normal([-3, -6], 0.5), *rng.uniform(0.05, 0.2, 2)) for _ in range(50)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    low, high = [-5.0, -8.0, 0.01, 0.01, -0.9] * 2 + [0.0], [0.0, -4.0, 3.0, 3.0, 0.9] * 2 + [1.0]
    thetas = sampler.start(6, low, high, 1).tolist() + [[9.0] * 11]
    fixed, links = [None] * 4 + [0.0] + [None] * 6, [(2, 3)]
    got = {r["param_id"]: r["log_posterior"] for r in mixture.log_posteriors(df, thetas, low, high, fixed, links).collect()}
    for i, t in enumerate(thetas):
        free = sampler.allowed(np.array(t), np.array(low), np.array(high))
        want = sampler.log_likelihood(np.array(mixture.effective(t, fixed, links)), np.array(rows)) if free else -math.inf
        assert got[i] == pytest.approx(want, rel=1e-9)
    spread = sampler.log_posteriors(df.repartition(5), np.array(thetas), np.array(low), np.array(high), fixed, links)
    assert spread == pytest.approx([got[i] for i in range(len(thetas))], abs=1e-5)
    zero = mixture.log_likelihoods(df.withColumn("pm_ra", F.lit(1e9)), thetas[:1]).first()
    assert zero["log_likelihood"] == -math.inf
    with pytest.raises(ValueError):
        mixture.components_of(7)


def test_sampler_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """Two runs are one run; a block whose state was lost is made again; a run from given walkers; begun anew."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(a), float(b), 0.1, 0.1) for a, b in rng.normal([-3, -6], 0.3, (60, 2))], "pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    low, high = [-5.0, -8.0, 0.05, 0.05, -0.8, 0.99], [0.0, -4.0, 2.0, 2.0, 0.8, 1.0]
    read = lambda c: sorted((r["chain_id"], r["step"], r["walker"], tuple(r["theta"]), r["log_prob"]) for r in c.collect())
    path = f"file://{tmp_path}/run"
    run = lambda steps, **more: sampler.sample(df, 2, 8, steps, low, high, path=path, **more)
    whole = read(sampler.sample(df, 2, 8, 6, low, high))
    assert len(whole) == 2 * 8 * 6 and read(run(3)) == [r for r in whole if r[1] < 3]
    assert read(run(3)) == whole
    stored = sampler._store
    monkeypatch.setattr(sampler, "_store", lambda spark, path, first, done, held, *state: spark.createDataFrame(held, sampler.CHAIN).write.mode("overwrite").parquet(f"{path}/chain/block={first}"))
    run(2)  # ended before its state was stored
    monkeypatch.setattr(sampler, "_store", stored)
    assert read(sampler.read_chain(spark, path)) == whole
    assert read(run(2))[:0] == [] and [r for r in read(sampler.read_chain(spark, path)) if r[1] < 6] == whole and len(read(sampler.read_chain(spark, path))) == 2 * 8 * 8
    places = np.array([sampler.start(8, low, high, 40 + c) for c in range(2)])
    new = read(run(1, start_at=places, reset=True))
    assert len(new) == 16 and {tuple(p) for p in places.reshape(-1, 6).tolist()} & {r[3] for r in new}
    with pytest.raises(ValueError, match="other chains"):
        sampler.sample(df, 1, 8, 1, low, high, path=path)
    with pytest.raises(ValueError, match="one row of parameters"):
        run(1, start_at=places[:1], reset=True)


def test_sampler_starts_in_the_box(spark):
    low, high = [-5.0, -8.0, 0.05, 0.05, -0.9] * 2 + [0.0], [0.0, -4.0, 3.0, 3.0, 0.9] * 2 + [1.0]
    rows = sampler.start_table(spark, 3, 40, low, high, seed=4).collect()
    assert sorted((r["chain_id"], r["walker"]) for r in rows) == [(c, w) for c in range(3) for w in range(40)] and {(r["step"], r["log_prob"]) for r in rows} == {(0, None)}
    theta = np.array([r["theta"] for r in rows])
    assert (theta >= low).all() and (theta <= high).all() and len({tuple(t) for t in theta}) == 120
    assert np.abs(theta.mean(axis=0) - (np.array(low) + high) / 2).max() < 0.6 * np.ptp([low, high], axis=0).max() / 2
    three = [-5.0, -8.0, 0.05, 0.05, -0.9] * 3 + [0.0, 0.0], [0.0, -4.0, 3.0, 3.0, 0.9] * 3 + [1.0, 1.0]
    assert max(sum(r["theta"][15:]) for r in sampler.start_table(spark, 1, 300, *three).collect()) <= 1.0


def test_sampler_finds_planted_means(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal([-3, -6], 0.3, (300, 2))
    df = spark.createDataFrame([(float(a), float(b), 0.05, 0.05) for a, b in xy], "pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    low, high = [-5.0, -8.0, 0.05, 0.05, -0.8, 0.99], [0.0, -4.0, 2.0, 2.0, 0.8, 1.0]
    chain = sampler.sample(df, 2, 24, 150, low, high)
    kept = chain.filter("step >= 100").agg(F.avg(F.col("theta")[0]), F.avg(F.col("theta")[1]), F.count("*")).first()
    assert kept[0] == pytest.approx(-3, abs=0.1) and kept[1] == pytest.approx(-6, abs=0.1) and kept[2] == 2 * 24 * 50
    far = sampler.sample(df.repartition(6), 2, 8, 3, low, high).orderBy("chain_id", "step", "walker").collect()
    data, box = df.toPandas().to_numpy(), (np.array(low), np.array(high))
    alone = lambda v: np.array([sampler.log_likelihood(t, data) if sampler.allowed(t, *box) else -math.inf for t in v])
    want = []
    for c in range(2):
        places, rng = [sampler.start(8, low, high, c)], [np.random.default_rng(c)]
        logs = [alone(places[0])]
        for _ in range(3):
            sampler.advance(places, logs, rng, alone)
            want += [(t, v) for t, v in zip(places[0].tolist(), logs[0].tolist(), strict=True)]
    assert [r["theta"] for r in far] == [t for t, _ in want]
    assert [r["log_prob"] for r in far] == pytest.approx([v for _, v in want], abs=1e-4)
    assert sampler.sample(df.limit(0), 1, 8, 1, low, high).filter("log_prob = 0").count() > 0


def test_long_chains_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sampler, "HELD_ROWS", 20)
    df = spark.createDataFrame([(-3.0, -6.0, 0.1, 0.1)] * 9 + [(None, 0.0, 0.1, 0.1)], "pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    low, high = [-5.0, -8.0, 0.05, 0.05, -0.8, 0.99], [0.0, -4.0, 2.0, 2.0, 0.8, 1.0]
    got = sampler.sample(df, 1, 8, 7, low, high)
    assert sorted((r["step"], r["walker"]) for r in got.collect()) == [(s, w) for s in range(7) for w in range(8)]
    assert len(got.inputFiles()) > 2


def catalogue(spark, n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = rng.uniform(-1, 1)
        c, b = 1.75 + 0.2 * y + rng.normal(0, 0.02), 22 + 2 * y
        r = 0.02 * np.sqrt(rng.uniform())
        a = rng.uniform(0, 2 * np.pi)
        rows.append((i, 290 + r * np.cos(a), 2 + r * np.sin(a), float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), b, b - c))
    return spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows], "ra double, dec double, x double, y double, band1 double, band2 double, star_id long")


@pytest.mark.parametrize("method,target", [("expected", None), ("montecarlo", 3.0)])
def test_membership_falls_where_the_field_lies(spark, method, target):
    cluster = catalogue(spark)
    field = cluster.filter("band1 > 22.5").select("star_id", "ra", "dec", "band1", "band2")
    roi = [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)]
    metrics = []
    got = membership.statistical_membership(cluster, field, Reddening(), roi, nref=5, step=0.4, threshold=0.3, iterations=1, min_stars=40, method=method, draws=50, target_median=target, metrics=metrics)
    rows = got.collect()
    m = [r["membership"] for r in rows]
    want = {"iteration": 0, "stars": 400, "grouped": sum(r["g"] is not None for r in rows), "members": sum(x > 0.5 for x in m), "membership": np.mean(m), "corrected": sum(r["delta_ebv"] != 0 for r in rows), "delta_ebv": np.mean([abs(r["delta_ebv"]) for r in rows])}
    assert len(metrics) == 1 and metrics[0] == pytest.approx(want)
    assert len(rows) == 400 and len({r["g"] for r in rows if r["g"] is not None}) >= 2
    assert all(r["membership"] == 1.0 for r in rows if r["g"] is None)
    bright = [r["membership"] for r in rows if r["g"] is not None and r["band1"] < 22]
    faint = [r["membership"] for r in rows if r["g"] is not None and r["band1"] > 23]
    assert np.mean(bright) > np.mean(faint) + 0.1
    with pytest.raises(ValueError):
        membership.statistical_membership(cluster.limit(3), field, Reddening(), roi, iterations=1)


def test_weights_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, 0.2, 0.2), (1, 0.2, 0.2), (2, 0.8, 0.3), (3, 0.0, 0.0), (4, 1.0, 1.0), (5, 0.5, 0.5)], "k long, x double, y double")
    got = statistics.density_weights(df, "k", "x", "y", 4).collect()
    assert len(got) == 6 and len({r["weight"] for r in got if r["k"] == 1}) == 1
    cells = {(r["ix"], r["iy"]): r["density"] for r in statistics.histogram2d(df, "x", "y", 4).collect()}
    for x, y, k in ((0.2, 0.2, 1), (0.8, 0.3, 2), (0.5, 0.5, 5)):
        u, v = x / 0.25 - 0.5, y / 0.25 - 0.5
        a, b = math.floor(u), math.floor(v)
        want = sum(cells.get((a + i, b + j), 0.0) * (u - a if i else 1 - u + a) * (v - b if j else 1 - v + b) for i in (0, 1) for j in (0, 1))
        assert next(r["weight"] for r in got if r["k"] == k) == pytest.approx(want)


def test_medians_of_groups_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(a), float(b)) for g, n in ((0, 1), (1, 2), (2, 999), (3, 5000)) for a, b in zip(rng.normal(size=n), rng.exponential(1e9, n), strict=True)]
    rows += [(4, 7.0, None)] * 3000 + [(5, float("nan"), 1.0), (5, None, 3.0), (6, 0.0, 1.0), (6, 1.0, 1.0)] * 400
    df = spark.createDataFrame(rows, "g long, a double, b double")
    for few in (3, 10_000):
        got = {r["g"]: (r["a"], r["b"]) for r in statistics.group_medians(df, ["g"], ["a", "b"], few=few, bins=8).collect()}
        for g in range(7):
            for k, v in enumerate(zip(*((x[1:]) for x in rows if x[0] == g), strict=True)):
                some = [x for x in v if x is not None and not math.isnan(x)]
                assert got[g][k] == (pytest.approx(np.median(some)) if some else None)


def test_corner_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    rows = statistics.corner(df, ["a", "b"], 4).collect()
    assert sorted((r["kind"], r["a"], r["n"]) for r in rows if r["kind"] != "quantile") == [("one", "a", 2), ("one", "b", 1), ("one", "b", 1), ("two", "a", 1), ("two", "a", 1)]
    assert statistics.corner(df.limit(0), ["a", "b"]).count() == 0


def test_traces_of_some_walkers(spark):
    df = spark.createDataFrame([(w, s, float(s), 0.0) for w in range(4) for s in range(3)], "walker long, step int, t double, log_prob double")
    from asterism.operators import chains

    assert {r["walker"] for r in chains.trace(df, ["t"], 1, walkers=[0, 1, 2], without=[1]).collect()} == {0, 2}
    assert sorted((r["walker"], r["step"]) for r in chains.last_steps(df).collect()) == [(w, 2) for w in range(4)]


def test_groups_follow_the_field(spark):
    """Radii and groups by counting a fine grid of points, apart from the closed forms."""
    rng = np.random.default_rng(7)
    stars = [(i, 290 + a, 2 + b) for i, (a, b) in enumerate(rng.normal(0, 0.004, (600, 2)))]
    many = [(i, 290 + a, 2 + b) for i, (a, b) in enumerate(rng.uniform(-0.01, 0.01, (500, 2)))]
    frame = lambda r: spark.createDataFrame([(i, float(a), float(b)) for i, a, b in r], "star_id long, ra double, dec double")
    groups, rings = membership.spatial_groups(frame(stars), frame(many), 60)
    f = np.array(many)[:, 1:]
    mid = f.min(axis=0) + np.ptp(f, axis=0) / 2
    sep = np.hypot((f[:, 0] - mid[0]) * np.cos(np.radians(2)), f[:, 1] - mid[1]).max() * 3600
    least = 60 / (500 / (np.pi * sep**2)) / 3600**2
    p = np.array(stars)[:, 1:]
    hull = p[[0]] * 0 + p  # all stars: a point is inside if it is on no outer side of any edge of the hull
    from asterism.operators.tessellation import hull_of

    ring, c = hull_of(hull), p.min(axis=0) + np.ptp(p, axis=0) / 2
    xs = np.stack(np.meshgrid(*(np.linspace(p[:, d].min(), p[:, d].max(), 1500) for d in (0, 1)), indexing="ij"), -1).reshape(-1, 2)
    step = np.roll(ring, -1, axis=0) - ring
    inside = np.ones(len(xs), bool)
    for v, e in zip(ring, step, strict=True):
        inside &= e[0] * (xs[:, 1] - v[1]) - e[1] * (xs[:, 0] - v[0]) >= 0
    far = np.sort(np.hypot(*(xs[inside] - c).T))
    one, radii, last, k = np.prod(np.ptp(p, axis=0)) / 1499**2, [], 0.0, 1
    while k / 3600 < np.hypot(*(ring - c).T).max():
        area = np.searchsorted(far, k / 3600) * one
        if area - last > least:
            radii.append(k / 3600)
            last = area
        k += 1
    got = [b for _, _, b, *_ in rings[:-1]]
    assert len(rings) == len(radii) and np.allclose(got, radii[:-1], atol=1.01 / 3600)
    at = {r["star_id"]: r["g"] for r in groups.collect()}
    corners = {i for i, a, b in stars if any((a, b) == tuple(v) for v in ring)}
    for i, a, b in stars:
        d = math.hypot(a - c[0], b - c[1])
        want = next((g for g, low, high, *_ in rings if low < d < high), None)
        assert at.get(i) == (None if i in corners and want == len(rings) - 1 else want)


def test_ridge_is_the_spline_through_the_bins(spark):
    from asterism.jobs import queries

    d = "/root/testdata/sf0.001"
    knots = sorted((r["ordinate"], r["abscissa"]) for r in statistics.binned_medians(queries._roi(spark, d).select("rx", "ry"), "ry", "rx", queries.STEP).collect())
    y, x = map(np.array, zip(*knots, strict=True))
    n = len(y) - 1  # pieces; all conditions of the definition as one linear system
    rows, want = [], []
    power = lambda t, d: np.array([[1, t, t * t, t**3], [0, 1, 2 * t, 3 * t * t], [0, 0, 2, 6 * t], [0, 0, 0, 6]][d], float)
    def add(parts, value):
        row = np.zeros(4 * n)
        for i, v in parts:
            row[4 * i : 4 * i + 4] += v
        rows.append(row)
        want.append(value)
    for i in range(n):
        add([(i, power(0, 0))], x[i])
        add([(i, power(y[i + 1] - y[i], 0))], x[i + 1])
    for i in range(n - 1):
        for k in (1, 2):
            add([(i, power(y[i + 1] - y[i], k)), (i + 1, -power(0, k))], 0)
    for i in (0, n - 2):
        add([(i, power(0, 3)), (i + 1, -power(0, 3))], 0)
    c = np.linalg.solve(np.array(rows), np.array(want)).reshape(n, 4)
    for r in queries._rotated(catalogues.photometry(spark, d)).join(queries.ridge_residuals(spark, d), "star_id").collect():
        i = min(max(np.searchsorted(y, r["ry"], side="right") - 1, 0), n - 1)
        value = power(r["ry"] - y[i], 0) @ c[i]
        assert r["ridge"] == pytest.approx(value, rel=1e-4, abs=1e-4) and r["residual"] == pytest.approx(r["rx"] - value, rel=1e-4, abs=1e-4)


def test_text_catalogues(spark, tmp_path):
    (tmp_path / "a.cat").write_text("  ra(1)   x(3) oktot(54)\n 1.5    2  1\n\n   2.5 -3.25   0\nbad 1 1\n")
    schema = T.StructType([T.StructField("oktot(54)", T.IntegerType()), T.StructField("ra(1)", T.DoubleType())])
    got = catalogues.scan_whitespace(spark, str(tmp_path / "a.cat"), schema).collect()
    assert sorted(map(tuple, got), key=str) == [(0, 2.5), (1, 1.5), (1, None)]
    (tmp_path / "b.csv").write_text("u,ra(1),v\n1,2.5,x\n2,,y\n")
    assert sorted(map(tuple, catalogues.scan_csv(spark, str(tmp_path / "b.csv"), T.StructType([T.StructField("ra(1)", T.DoubleType())])).collect()), key=str) == [(2.5,), (None,)]
    with pytest.raises(ValueError):
        catalogues.scan_csv(spark, str(tmp_path / "b.csv"), schema)
    with pytest.raises(ValueError):
        catalogues.scan_whitespace(spark, str(tmp_path / "a.cat"), T.StructType([T.StructField("no", T.DoubleType())]))


def test_chains_are_stored_by_run(spark, tmp_path):
    df = spark.createDataFrame([(s, w, float(s)) for s in range(6) for w in range(2)], "step int, walker int, log_prob double")
    path = str(tmp_path / "chain")
    catalogues.write_chain(df, path, "one")
    catalogues.write_chain(df, path, "two")
    catalogues.write_chain(df.filter("step < 2"), path, "one")
    catalogues.write_chain(df.filter("step >= 4"), path, "one", append=True)
    assert catalogues.read_chain(spark, path, "one").count() == 8 and catalogues.read_chain(spark, path).count() == 20
