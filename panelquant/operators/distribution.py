"""Quantile-vector operators: repair, implied moments, density, scores.

Input is `q` (array<double>, increasing in the shared levels `taus`).  The linear path is array
expressions only, one row at a time, so it never shuffles.  The cubic path needs a spline
and runs vectorised over Arrow batches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.functions.num import let

MIN_DENSITY, EPS = 1e-5, 1e-4  # fixed values


def _taus(taus) -> Column:
    return F.array(*[F.lit(float(t)) for t in taus])


def repair(q: Column, taus) -> Column:
    """array<struct<x, y>>: duplicates of -1 in the lower tail dropped, x forced up by >= 1e-4."""
    return let(q, lambda v: _repair(v, taus))


def _repair(q: Column, taus) -> Column:
    n = len(taus)
    cut = F.size(F.filter(F.slice(q, 2, n - 1), lambda v: v == -1.0))
    pts = F.slice(F.transform(q, lambda v, i: F.struct(v.alias("x"), F.element_at(_taus(taus), i + 1).alias("y"))), cut + 1, F.lit(n) - cut)

    empty = F.filter(pts, lambda p: F.lit(False))

    def push(acc, p):
        prev = F.try_element_at(acc, F.lit(-1))["x"]
        x = F.when(prev.isNull(), p["x"]).otherwise(F.greatest(p["x"], prev + EPS))
        return F.concat(acc, F.array(F.struct(x.alias("x"), p["y"].alias("y"))))

    return F.aggregate(pts, empty, push)


def _segments(pts: Column, lo: int, hi_off: int) -> Column:
    """Consecutive point pairs from index lo to size - hi_off as (a, b, fa, fb)."""
    n = F.size(pts)
    return F.zip_with(F.slice(pts, lo + 1, F.greatest(n - lo - hi_off - 1, F.lit(0))), F.slice(pts, lo + 2, F.greatest(n - lo - hi_off - 1, F.lit(0))),
                      lambda l, r: F.struct(l["x"].alias("a"), r["x"].alias("b"), l["y"].alias("fa"), r["y"].alias("fb")))


def _cdf_at(pts: Column, x: Column) -> Column:
    """Piecewise-linear distribution function at x, constant outside the points."""
    first = F.element_at(pts, 1)["y"]
    return first + F.aggregate(_segments(pts, 0, 0), F.lit(0.0), lambda s, g: s + (g["fb"] - g["fa"]) * F.least(F.greatest((x - g["a"]) / (g["b"] - g["a"]), F.lit(0.0)), F.lit(1.0)))


def _density(seg: Column) -> Column:
    """Segment densities with the floor and monotone tails: (a, b, fa, fb, d, i)."""
    d = F.transform(seg, lambda g, i: F.struct(g["a"].alias("a"), g["b"].alias("b"), g["fa"].alias("fa"), g["fb"].alias("fb"),
                                               F.greatest((g["fb"] - g["fa"]) / (g["b"] - g["a"]), F.lit(MIN_DENSITY)).alias("d"), i.alias("i")))
    tol = 1e-9
    left, right = (lambda s: F.filter(s, lambda g: g["fa"] <= 0.1 + tol)), (lambda s: F.filter(s, lambda g: g["fa"] >= 0.9 - tol))
    mn = lambda s: F.array_min(F.transform(s, lambda g: g["d"]))
    where = lambda s, low: F.transform(F.filter(s, lambda g: g["d"] == low), lambda g: g["i"])

    def tails(d, low):
        loc = F.struct(F.array_max(where(left(d), low["l"])).alias("l"), F.array_min(where(right(d), low["r"])).alias("r"))
        return let(loc, lambda at: F.transform(d, lambda g: F.struct(
            g["a"].alias("a"), g["b"].alias("b"), g["fa"].alias("fa"), g["fb"].alias("fb"),
            F.when(g["i"] < at["l"], low["l"]).when(g["i"] > at["r"], low["r"]).otherwise(g["d"]).alias("d"))))

    return let(d, lambda d: let(F.struct(mn(left(d)).alias("l"), mn(right(d)).alias("r")), lambda low: tails(d, low)))


def moments(df: DataFrame, taus, q: str = "q", method: str = "linear") -> DataFrame:
    """Raw moments m0..m4 implied by the quantiles, then var, std, skew, kurtosis.

    linear: uniform density between neighbouring quantiles from the second to the last but one,
    floored, monotone beyond the 10 % and 90 % levels, cut at -1; the outer mass sits on the
    second and the last but one quantile; everything is normalised by m0.
    """
    if method == "cubic":
        return central_moments(_cubic(df, taus, q))
    n = len(taus)
    d = df.withColumn("_pts", repair(F.col(q), taus))
    d = d.withColumn("_seg", _density(_segments(F.col("_pts"), 1, 1)))
    first = F.element_at(F.col(q), 2)
    lowest = F.element_at(F.col("_seg"), 1)["a"]
    d = d.withColumn("_lo", F.when(lowest < -1, F.lit(-1.0)).otherwise(first)).withColumn("_hi", F.element_at(F.col(q), n - 1))
    d = d.withColumn("_pl", _cdf_at(F.col("_pts"), F.col("_lo"))).withColumn("_pu", 1 - _cdf_at(F.col("_pts"), F.col("_hi")))
    seg = F.filter(F.transform("_seg", lambda g: F.struct(F.greatest(g["a"], F.lit(-1.0)).alias("a"), g["b"].alias("b"), g["d"].alias("d"))), lambda g: g["b"] > g["a"])
    d = d.withColumn("_seg", seg)

    def power(k):
        body = F.aggregate("_seg", F.lit(0.0), lambda s, g: s + g["d"] * (F.pow(g["b"], F.lit(k + 1)) - F.pow(g["a"], F.lit(k + 1))) / (k + 1))
        return body + F.col("_pl") * F.pow("_lo", F.lit(k)) + F.col("_pu") * F.pow("_hi", F.lit(k))

    d = d.withColumns({f"_w{k}": power(k) for k in range(5)})
    d = d.withColumns({"m0": F.col("_w0"), **{f"m{k}": F.col(f"_w{k}") / F.col("_w0") for k in range(1, 5)}})
    return central_moments(d.withColumn("LinearFlag", F.lit(True)).drop("_pts", "_seg", "_lo", "_hi", "_pl", "_pu", *[f"_w{k}" for k in range(5)]))


def central_moments(df: DataFrame) -> DataFrame:
    m1, m2, m3, m4 = (F.col(f"m{k}") for k in range(1, 5))
    d = df.withColumn("var", m2 - m1 * m1)
    v = F.when(F.col("var") > 0, F.col("var"))
    return (d.withColumn("std", F.sqrt(v)).withColumn("skew", (m3 - 3 * m1 * v - m1 * m1 * m1) / F.pow(v, F.lit(1.5)))
            .withColumn("kurtosis", (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (v * v)))


# linear tail corrections: constant, skew, excess kurtosis terms (fixed values)
VAR_ADJ = (1.00232494, -0.0021291, 0.00219741)
SKEW_ADJ = (0.99495005, 0.02609106, 0.01066851)
KURT_ADJ = (1.41849094, 0.04657378, -0.73949787)


def adjust_moments(df: DataFrame) -> DataFrame:
    """Tail-adjusted variance, skewness and kurtosis."""
    s, k = F.col("skew"), F.col("kurtosis") - 3
    return (df.withColumn("var_adj", F.col("var") * (VAR_ADJ[0] + VAR_ADJ[1] * s + VAR_ADJ[2] * k))
            .withColumn("skew_adj", SKEW_ADJ[0] * s + SKEW_ADJ[1] * s * s + SKEW_ADJ[2] * k)
            .withColumn("kurtosis_adj", 3 + KURT_ADJ[0] * k + KURT_ADJ[1] * k * k + KURT_ADJ[2] * s))


def fit_adjustment(df: DataFrame, by=("_all",)) -> DataFrame:
    """Regression of true/implied variance ratio on (skew, excess kurtosis): new coefficients."""
    from panelquant.functions.stage import stage
    from panelquant.operators.series import group_ols

    # null filters would be pushed through the moment expressions and copy them; cut here
    d = stage(df.select("skew", "kurtosis", "var", "var_t")).withColumn("_all", F.lit("all")).withColumn("e_k", F.col("kurtosis") - 3).withColumn("ratio", F.col("var_t") / F.col("var"))
    return group_ols(d, list(by), "ratio", ["skew", "e_k"])


def density(df: DataFrame, taus, q: str = "q", keys=("date", "DTID")) -> DataFrame:
    """Exploded table (keys, pos, x, cdf, density), one row per segment start."""
    d = df.withColumn("_seg", let(repair(F.col(q), taus), lambda pts: _density(_segments(pts, 1, 1))))
    # the plain form would filter on the expression first, in a second copy below every projection
    d = d.select(*keys, F.posexplode_outer("_seg").alias("pos", "g")).filter("pos is not null")
    return d.select(*keys, "pos", F.col("g.a").alias("x"), F.col("g.fa").alias("cdf"), F.col("g.d").alias("density"))


def crps(df: DataFrame, taus, q: str = "q", y: str = "y", out: str = "crps") -> DataFrame:
    """Integral of (F - 1{x >= y})^2 for the piecewise-linear F between the second and the last
    but one quantile, extended to the realised value when that lies outside."""
    d = df.withColumn("_pts", repair(F.col(q), taus)).withColumn("_s", _segments(F.col("_pts"), 1, 1))
    Y = F.col(y)
    sq = lambda w, u, v: w * (u * u + u * v + v * v) / 3

    def part(g):
        w = g["b"] - g["a"]
        fy = g["fa"] + (g["fb"] - g["fa"]) * (Y - g["a"]) / w
        split = sq(Y - g["a"], g["fa"], fy) + sq(g["b"] - Y, fy - 1, g["fb"] - 1)
        return F.when(Y <= g["a"], sq(w, g["fa"] - 1, g["fb"] - 1)).when(Y >= g["b"], sq(w, g["fa"], g["fb"])).otherwise(split)

    total = F.aggregate("_s", F.lit(0.0), lambda s, g: s + part(g))
    lo, hi = F.element_at("_s", 1), F.element_at("_s", -1)
    below = F.when(Y < lo["a"], (lo["a"] - Y) * (1 - lo["fa"]) * (1 - lo["fa"])).otherwise(0.0)
    above = F.when(Y > hi["b"], (Y - hi["b"]) * hi["fb"] * hi["fb"]).otherwise(0.0)
    return d.withColumn(out, total + below + above).drop("_pts", "_s")


def pinball_sum(q: Column, y: Column, taus) -> Column:
    """Sum over levels of the pinball loss of one row."""
    e = F.transform(q, lambda v, i: F.when(y - v >= 0, F.element_at(_taus(taus), i + 1) * (y - v)).otherwise((1 - F.element_at(_taus(taus), i + 1)) * (v - y)))
    return F.aggregate(e, F.lit(0.0), lambda a, b: a + b)


def crps_grid(df: DataFrame, taus, q: str = "q", y: str = "y", out: str = "score") -> DataFrame:
    """Twice the mean pinball loss over the quantile levels."""
    return df.withColumn(out, 2 * pinball_sum(F.col(q), F.col(y), taus) / len(taus))


def trapezoid_mean(df: DataFrame, taus, q: str = "q", out: str = "mean_v") -> DataFrame:
    """Mean from quantiles: trapezoids over the levels."""
    e = F.lit(0.0)
    for i in range(len(taus) - 1):
        e = e + (F.col(q)[i] + F.col(q)[i + 1]) / 2 * (taus[i + 1] - taus[i])
    return df.withColumn(out, e)


def _cubic(df: DataFrame, taus, q: str, points: int = 100) -> DataFrame:
    """Raw moments from the interpolating cubic distribution function, vectorised per batch.

    Rows whose cubic density drops below the floor between the 10 % and 90 % levels fall back to
    the linear density on the same grid.  Stateless per row: no shuffle, no grouping.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    levels = np.array([float(t) for t in taus])
    out_fields = [T.StructField(f"m{k}", T.DoubleType()) for k in range(5)] + [T.StructField("LinearFlag", T.BooleanType()), T.StructField("Error", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *out_fields])

    def run(batches):
        for pdf in batches:
            res = np.full((len(pdf), 5), np.nan)
            lin = np.zeros(len(pdf), dtype=bool)
            Q = np.array([np.asarray(v, dtype=float) for v in pdf[q]]).reshape(len(pdf), len(levels))
            cuts = (Q[:, 1:] == -1).sum(axis=1)
            for c in np.unique(cuts):
                rows = np.where(cuts == c)[0]
                res[rows], lin[rows] = spline_moments(Q[rows], levels, int(c), points)
            ok = np.isfinite(res).all(axis=1)
            add = pd.DataFrame({**{f"m{k}": np.where(ok, res[:, k], np.nan) for k in range(5)}, "LinearFlag": lin, "Error": ~ok}, index=pdf.index)
            yield pd.concat([pdf, add], axis=1)

    return df.mapInPandas(run, schema)


def spline_moments(Q, levels, cut: int, points: int):
    """Batched not-a-knot spline of levels on quantiles; returns (m0..m4, linear flag) per row."""
    import numpy as np

    x, y = Q[:, cut:].copy(), levels[cut:]
    m, n = x.shape
    lo, hi = Q[:, 1].copy(), Q[:, -2]
    i10 = int(np.argmin(np.abs(y - 0.1))) if y.min() < 0.05 else 2
    i90 = int(np.argmin(np.abs(y - 0.9)))
    x10, x90 = x[:, i10].copy(), x[:, i90].copy()
    for i in range(n - 1):
        x[:, i + 1] = np.maximum(x[:, i + 1], x[:, i] + EPS)
    if n < 4:
        return np.full((m, 5), np.nan), np.zeros(m, dtype=bool)
    h = np.diff(x, axis=1)
    slope = np.diff(y)[None, :] / h
    A, rhs = np.zeros((m, n, n)), np.zeros((m, n))
    for i in range(1, n - 1):
        A[:, i, i - 1], A[:, i, i], A[:, i, i + 1] = h[:, i - 1], 2 * (h[:, i - 1] + h[:, i]), h[:, i]
        rhs[:, i] = 6 * (slope[:, i] - slope[:, i - 1])
    for r, (a, b) in ((0, (0, 1)), (n - 1, (n - 3, n - 2))):  # third derivative continuous at the ends
        A[:, r, a], A[:, r, a + 1], A[:, r, a + 2] = h[:, b], -(h[:, a] + h[:, b]), h[:, a]
    M = np.linalg.solve(A, rhs[..., None])[..., 0]
    seg = np.repeat(np.arange(1, n - 2), points)
    frac = np.tile(np.arange(points) / points, n - 3)
    xs, hs = x[:, seg], h[:, seg]
    t = frac[None, :] * hs
    g = xs + t
    b = slope[:, seg] - hs * (2 * M[:, seg] + M[:, seg + 1]) / 6
    k3 = (M[:, seg + 1] - M[:, seg]) / hs
    dens = b + M[:, seg] * t + k3 * t * t / 2
    mid = (g >= x10[:, None]) & (g <= x90[:, None])
    linear = np.where(mid, dens, np.inf).min(axis=1) < MIN_DENSITY
    dens = np.where(linear[:, None], slope[:, seg], dens)

    def cdf(z):
        j = np.clip((x <= z[:, None]).sum(axis=1) - 1, 0, n - 2)
        r = np.arange(m)
        u = z - x[r, j]
        bb = slope[r, j] - h[r, j] * (2 * M[r, j] + M[r, j + 1]) / 6
        cub = y[j] + bb * u + M[r, j] * u ** 2 / 2 + (M[r, j + 1] - M[r, j]) / h[r, j] * u ** 3 / 6
        return np.where(linear, y[j] + slope[r, j] * u, cub)

    dens = np.maximum(dens, MIN_DENSITY)
    pos = np.arange(g.shape[1])[None, :]
    left, right = g <= x10[:, None], g >= x90[:, None]
    lm, rm = np.where(left, dens, np.inf).min(axis=1), np.where(right, dens, np.inf).min(axis=1)
    ll = np.where(left & (dens == lm[:, None]), pos, -1).max(axis=1)
    dens = np.where(pos < ll[:, None], lm[:, None], dens)
    rl = np.where(right & (dens == rm[:, None]), pos, pos.max() + 1).min(axis=1)
    dens = np.where(pos >= rl[:, None], np.where(np.isfinite(rm), rm, 0)[:, None], dens)
    keep = g >= -1
    lo = np.where(keep.all(axis=1), lo, -1.0)
    pl, pu = cdf(lo), 1 - cdf(hi)
    a, c, fa, fc = g[:, :-1], g[:, 1:], dens[:, :-1], dens[:, 1:]
    w = keep[:, :-1]
    s = (fc - fa) / (c - a)
    k0 = fa - s * a
    out = np.zeros((m, 5))
    for k in range(5):
        body = k0 * (c ** (k + 1) - a ** (k + 1)) / (k + 1) + s * (c ** (k + 2) - a ** (k + 2)) / (k + 2)
        out[:, k] = np.where(w, body, 0).sum(axis=1) + pl * lo ** k + pu * hi ** k
    out[:, 1:] /= out[:, :1]
    return out, linear
