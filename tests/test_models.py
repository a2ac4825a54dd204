import numpy as np
import pandas as pd
import pytest

from panelquant.models import quantile as Q, vol
from panelquant.models.splits import walk_forward
from panelquant.operators.asof import Grid
from panelquant.operators.evaluate import mean_pinball

TAUS = (0.1, 0.5, 0.9)


def test_linear_quantiles_are_recovered(spark):
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.uniform(0, 1, n)
    pdf = pd.DataFrame({"date": np.arange(n), "DTID": "a", "x": x, "y": 1 + 2 * x + (0.5 + x) * rng.uniform(-1, 1, n)})
    df = spark.createDataFrame(pdf)
    m = Q.fit_quantile(df, ["x"], "y", TAUS, steps=120, lr=0.2, patience=200)
    W, b = Q._unflat(m.members[0], Q.init_params(m.spec, 0))["net1"][0]
    for k, t in enumerate(TAUS):  # true quantile: 1 + 2x + (0.5 + x)(2 tau - 1)
        assert b[k] + 0.5 * W[0, k] == pytest.approx(2 + (2 * t - 1), abs=0.08)
    base = mean_pinball(df.selectExpr("*", "array(2.0D, 2.0D, 2.0D) as q"), TAUS).collect()[0].loss
    assert mean_pinball(Q.predict(m, df), TAUS).collect()[0].loss < 0.6 * base


@pytest.mark.parametrize("heads,loss", [(1, "pinball"), (1, "huber"), (1, "mse"), (1, "huber_pinball"), (2, "pinball"), (3, "pinball")])
def test_gradient_matches_differences(heads, loss):
    rng = np.random.default_rng(1)
    spec = Q.Spec(["a", "b"], "y", TAUS, ["a"] if heads > 1 else None, "z", "s", (3,), (2,), "sigmoid", loss, heads)
    p = Q.init_params(spec, 3)
    v = Q._flat(p) + rng.normal(scale=0.3, size=Q._flat(p).size)
    X1, y1, X2, y2, s = rng.normal(size=(7, 2)), rng.normal(size=7), rng.normal(size=(7, 1)), rng.normal(size=7), rng.uniform(0.1, 0.3, 7)
    f = lambda u: Q.evaluate_batch(Q._unflat(u, p), spec, X1, y1, X2, y2, s, grad=False)[0].sum()
    g = Q._flat(Q.evaluate_batch(Q._unflat(v, p), spec, X1, y1, X2, y2, s)[1])
    for i in range(v.size):
        d = np.zeros_like(v)
        d[i] = 1e-6
        assert g[i] == pytest.approx((f(v + d) - f(v - d)) / 2e-6, abs=1e-4)


def test_t_quantiles_and_multipliers():
    assert vol.t_quantile(0.975, 4) / np.sqrt(0.5) == pytest.approx(2.776445, abs=1e-4)
    assert vol.t_quantile(0.01, 8) / np.sqrt(0.75) == pytest.approx(-2.896459, abs=1e-4)
    assert vol.multipliers((0.5,), "t", (6.0,))[6.0] == [0.0]


def test_variance_fit_prefers_the_true_parameters(spark):
    rng = np.random.default_rng(2)
    e, h = [], 1e-4
    for _ in range(1000):
        e.append(np.sqrt(h) * rng.normal())
        h = 1e-4 * 0.05 + 0.15 * e[-1] ** 2 + 0.8 * h
    d = pd.date_range(end="2020-12-31", periods=1000, freq="D").date
    df = spark.createDataFrame(pd.DataFrame({"DTID": "a", "date": d, "r": e}))
    r = vol.fit_vol(df, Grid("2021-01-01", "2021-01-01"), 36, "garch", "normal", [(0.01, 0.5, 0.0, 0.0), (0.05, 0.94, 0.0, 0.0), (0.15, 0.8, 0.0, 0.0), (0.4, 0.3, 0.0, 0.0)]).collect()[0]
    assert (r.alpha, r.beta, r.n, r.Converged) == (0.15, 0.8, 1000.0, True)
    q = vol.vol_quantiles(spark.createDataFrame([r], vol_schema()), (0.05, 0.5, 0.95), 21).collect()[0]
    assert q.q[0] < 0 < q.q[2] and q.q[1] == pytest.approx(0, abs=1e-12)


def vol_schema():
    names = "omega alpha beta gamma nu vol last ll n".split()
    return "T date, DTID string, mu double, " + ", ".join(f"{n} double" for n in names) + ", Converged boolean, family string, dist string"


def test_walk_forward_horizons(spark):
    r = walk_forward(spark, 2000, 2001, 1, "Y").orderBy("valid_start").collect()
    assert str(r[0].train_end) == "1998-12-31" and str(r[1].valid_end) == "2001-12-31" and len(r) == 2
    with pytest.raises(ValueError):
        walk_forward(spark, horizon="X")
