"""Mean membership over chains that repeat their draws."""

import numpy as np
import pytest
from asterism.operators import mixture


@pytest.mark.parametrize("k", [1, 2, 3])
def test_sums_of_shares(monkeypatch, k):
    """Against the shares of every row and draw; far rows, errors and deviations of zero, full correlation, negative weights, nulls and infinities."""
    monkeypatch.setattr(mixture, "CELLS", 64)
    monkeypatch.setattr(mixture, "TILE", 16)
    rng = np.random.default_rng(k)
    x = np.column_stack([rng.normal(-3, 1, (30, 2)), rng.uniform(0, 0.4, (30, 2))])
    x[:6] = [(1e9, 0, 0.1, 0.1), (np.nan, 0, 0.1, 0.1), (0, 0, 0, 0), (-3, -6, 0, 0.1), (np.inf, 0, 0.1, 0.1), (-40, 40, 0.1, 0.1)]
    thetas = rng.uniform(0.1, 0.9, (50, 6 if k == 1 else 6 * k - 1))
    thetas[:, :2] -= 3.0
    thetas[0, 4], thetas[1, 2:5], thetas[2, -1], thetas[3, 3], thetas[4, 4] = 1.0, 0.0, -0.2, 1e120, -1.0
    times = rng.integers(1, 9, 50)
    each = mixture._shares(x, thetas)
    good = ~np.isnan(each).any(axis=2)
    total, count = mixture._share_sums(x, thetas, times)
    assert (count == good @ times).all() and 0 < (count == 0).sum() < 10
    assert np.allclose(total, (np.where(good[:, :, None], each, 0) * times[:, None]).sum(axis=1), rtol=1e-9)


def test_equal_draws_are_computed_once(spark, monkeypatch):
    met, dealt = [], mixture._dealt_by_place

    def watched(data, draws):
        met.append(draws.count())
        return dealt(data, draws)

    monkeypatch.setattr(mixture, "_dealt_by_place", watched)
    thetas = [[-3.0, -6.0, 0.3, 0.3, 0.1, -2.5 - i / 9, -5.5, 1.0, 1.2, 0.2, i / 30] for i in range(30)]
    often = [1 + (7 * i) % 100 for i in range(30)]
    draws = spark.createDataFrame([(t,) for t, n in zip(thetas, often, strict=True) for _ in range(n)], "theta array<double>")
    rows = [(i, -3.0 + i / 4, -6.0, 0.1, 0.2) for i in range(8)]
    data = spark.createDataFrame(rows, "id long, pm_ra double, pm_dec double, epm_ra double, epm_dec double")
    got = {(r["id"], r["comp"]): (r["p"], r["draws"]) for r in mixture.mean_membership(data, "id", draws, 11).collect()}
    want = np.average(mixture._shares(np.array(rows, float)[:, 1:], np.array(thetas)), axis=1, weights=often)
    assert met == [30] and {v[1] for v in got.values()} == {sum(often)}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({(i, c): want[i, c] for i in range(8) for c in (0, 1)})
