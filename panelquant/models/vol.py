"""Volatility fits per (security, date) on a parameter grid, and horizon quantiles from them."""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from panelquant.operators.asof import Grid, snapshot

# default grid of (alpha, beta, gamma) steps; omega follows from the sample variance
ALPHAS = (0.02, 0.05, 0.08, 0.12, 0.16, 0.2)
PERSISTENCE = (0.8, 0.9, 0.95, 0.98, 0.99)
GAMMAS = (0.0, 0.04, 0.08, 0.12)
NUS = (4.0, 6.0, 8.0, 12.0)


def parameter_grid(family: str = "garch", dist: str = "normal", alphas=ALPHAS, persistence=PERSISTENCE, gammas=GAMMAS, nus=NUS) -> list[tuple]:
    """(alpha, beta, gamma, nu) tuples; gamma only for the asymmetric family, nu only for t errors."""
    if family == "ewma":
        return [(0.06, 0.94, 0.0, 4.0)]
    gs = gammas if family == "gjr" else (0.0,)
    ns = nus if dist == "t" else (0.0,)
    return [(a, p - a - g / 2, g, n) for a in alphas for p in persistence for g in gs for n in ns if p - a - g / 2 > 0]


def _loglik(R, N, par, target, dist):
    """Variance recursion for a padded batch (rows x time) against all parameter sets at once."""
    a, b, g, nu = (par[:, i][None, :] for i in range(4))
    s2 = target[:, None]
    om = s2 * np.maximum(1 - a - b - g / 2, 0.0)
    h = np.repeat(s2, par.shape[0], axis=1)
    ll, last_h, last_e = np.zeros_like(h), h.copy(), np.zeros(len(R))
    if dist == "t":
        lg = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in par[:, 3]])[None, :]
    for t in range(R.shape[1]):
        on = (t < N)[:, None]
        e = R[:, t][:, None]
        if t > 0:
            pe = R[:, t - 1][:, None]
            nh = om + (a + g * (pe < 0)) * pe * pe + b * h
            h = np.where(on, nh, h)
        z = e * e / h
        term = lg - 0.5 * np.log(h) - 0.5 * (nu + 1) * np.log1p(z / (nu - 2)) if dist == "t" else -0.5 * (math.log(2 * math.pi) + np.log(h) + z)
        ll += np.where(on, term, 0.0)
        last_h = np.where(on, h, last_h)
        last_e = np.where(on[:, 0], R[:, t], last_e)
    return ll, last_h, last_e, om


def fit_vol(returns: DataFrame, grid: Grid, months: int = 36, family: str = "garch", dist: str = "normal", params: list | None = None, mu: float = 0.0,
            mu_table: DataFrame | None = None, ret: str = "r", min_obs: int = 50, key="DTID", date="date") -> DataFrame:
    """(T, key, family, dist, mu, omega, alpha, beta, gamma, nu, vol, last, ll, n, Converged).

    The demeaned returns of the window are gathered per (T, key) - one value per date, so the
    array is bounded by the calendar - and a batch of such rows is scored against the whole
    parameter grid with array arithmetic.  Converged is false on the edge of any free parameter of the grid.
    """
    p = returns.filter(F.col(ret).isNotNull()).select(key, date, ret)
    s = snapshot(p, grid, -months, 0, [ret], key, date)
    if mu_table is not None:
        s = s.join(F.broadcast(mu_table.select("T", "mu")), "T")  # one row per grid date
    else:
        s = s.withColumn("mu", F.lit(float(mu)))
    a = s.groupBy("T", key).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), (F.col(ret) - F.col("mu")).alias("e")))).alias("_a"), F.first("mu").alias("mu"))
    a = a.filter(F.size("_a") >= min_obs).select("T", key, "mu", F.transform("_a", lambda v: v["e"]).alias("e"))
    par = np.array(params if params is not None else parameter_grid(family, dist))
    # every parameter that takes more than one value; persistence stands for beta
    free = np.column_stack([par[:, 0], par[:, 0] + par[:, 1] + par[:, 2] / 2, par[:, 2], par[:, 3]]).round(12)
    free = free[:, [len(set(x)) > 1 for x in free.T]]
    edge = (free.min(axis=0), free.max(axis=0)) if len(par) else None
    names = ["omega", "alpha", "beta", "gamma", "nu", "vol", "last", "ll", "n"]
    schema = T.StructType([T.StructField("T", T.DateType()), T.StructField(key, T.StringType()), T.StructField("mu", T.DoubleType()),
                           *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("Converged", T.BooleanType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for lo in range(0, len(pdf), 256):  # bounded memory: 256 rows x grid x time
                part = pdf.iloc[lo:lo + 256]
                N = part["e"].map(len).to_numpy()
                R = np.zeros((len(part), N.max()))
                for i, e in enumerate(part["e"]):
                    R[i, :len(e)] = e
                target = (R * R).sum(axis=1) / N
                target = np.where(target > 0, target, 1e-12)
                ll, h, last, om = _loglik(R, N, par, target, "normal" if family == "ewma" else dist)
                if family == "ewma":
                    w = np.array([(np.where(np.arange(n) == 0, 1.0, 0.06) * 0.94 ** (n - 1 - np.arange(n)) * r[:n] ** 2).sum() for r, n in zip(R, N)])
                    h, om = w[:, None], np.zeros_like(h)
                k, r = ll.argmax(axis=1), np.arange(len(part))
                ok = ((free[k] > edge[0]) & (free[k] < edge[1])).all(axis=1)
                yield pd.DataFrame({"T": part["T"].to_numpy(), key: part[key].to_numpy(), "mu": part["mu"].to_numpy(), "omega": om[r, k], "alpha": par[k, 0], "beta": par[k, 1], "gamma": par[k, 2],
                                    "nu": par[k, 3], "vol": np.sqrt(h[r, k]), "last": last, "ll": ll[r, k], "n": N.astype(float), "Converged": ok})

    out = a.mapInPandas(run, schema)
    return out.withColumn("family", F.lit(family)).withColumn("dist", F.lit("t" if family == "ewma" else dist))


def t_quantile(p: float, nu: float) -> float:
    """Quantile of a unit-variance t by bisection on the integrated density (small driver table)."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, nu)
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)

    def cdf(x):  # substitution x = sqrt(nu) tan(u) makes the integrand smooth and bounded
        u = np.linspace(0, math.atan(x / math.sqrt(nu)), 2001)
        f = np.cos(u) ** (nu - 1)
        s = (u[1] - u[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
        return 0.5 + c * math.sqrt(nu) * s

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2 * math.sqrt((nu - 2) / nu)


def multipliers(taus, dist: str, nus) -> dict:
    """Standard quantiles per (dist, nu)."""
    if dist == "normal":
        return {0.0: [NormalDist().inv_cdf(t) for t in taus]}
    return {float(v): [t_quantile(t, v) for t in taus] for v in nus}


def vol_quantiles(params: DataFrame, taus, h: int = 21, nus=NUS, floor: float = -1.0, cap: float = 50.0) -> DataFrame:
    """params + q: h-day compounded-return quantiles.

    Variance over the horizon is the closed-form sum of the mean-reverting daily forecasts; the
    quantile is exp(h mu + sqrt(variance) z) - 1, clipped to [floor, cap].  `nus` are the degrees of freedom of the parameter sets that
    produced the fit; a row with others raises.
    """
    p = F.col("alpha") + F.col("beta") + F.col("gamma") / 2
    h1 = F.col("omega") + (F.col("alpha") + F.when(F.col("last") < 0, F.col("gamma")).otherwise(0.0)) * F.pow("last", F.lit(2)) + F.col("beta") * F.pow("vol", F.lit(2))
    unit = p >= 1 - 1e-12
    lr = F.when(unit, F.lit(0.0)).otherwise(F.col("omega") / F.nullif(1 - p, F.lit(0.0)))
    var = F.when(unit, h * h1 + F.col("omega") * (h * (h - 1) / 2)).otherwise(h * lr + (h1 - lr) * (1 - F.pow(p, F.lit(h))) / F.nullif(1 - p, F.lit(0.0)))
    table = [("normal", 0.0, multipliers(taus, "normal", ())[0.0]), *[("t", v, z) for v, z in multipliers(taus, "t", nus).items()]]
    z = F.raise_error(F.concat(F.lit("no multipliers for "), "dist", F.lit(" nu="), F.col("nu").cast("string"))).cast("array<double>")
    for d, v, zs in table:
        z = F.when((F.col("dist") == d) & ((F.col("nu") == v) if d == "t" else F.lit(True)), F.array(*[F.lit(x) for x in zs])).otherwise(z)
    d = params.withColumn("_v", F.sqrt(var)).withColumn("_z", z)
    q = F.transform("_z", lambda x: F.least(F.greatest(F.exp(h * F.col("mu") + F.col("_v") * x) - 1, F.lit(floor)), F.lit(cap)))
    return d.withColumn("q", q).withColumn("h_vol", F.col("_v")).drop("_v", "_z")
