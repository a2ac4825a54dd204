"""Model queries.  Training queries are checked for shape here and against NumPy in the tests."""
from pyspark.sql import functions as F

from panelquant.functions.stage import stage
from panelquant.models import forest, quantile as Q, vol
from panelquant.models.splits import split_aggregates, walk_forward
from panelquant.operators import evaluate as V, xsection as X
from panelquant.operators.asof import Grid
from panelquant.queries.base import grid_cte, query
from panelquant.queries.core import PM, monthly
from panelquant.sources.adapters import panel_nation, table

TAUS = (0.1, 0.25, 0.5, 0.75, 0.9)
K = ["date", "DTID"]
XS = ["v", "p", "MC"]
PC = ["ps", PM]


def features(spark, d):
    """Ranked monthly features, next-month target scaled by the cross-sectional spread."""
    m = monthly(spark, d).filter("m is not null").withColumn("y_raw", F.least(F.greatest("m", F.lit(-5.0)), F.lit(5.0)) / 20)
    r = X.rank_pct(m, XS)
    return stage(X.attach(r, ["date"], s=F.avg(F.abs("y_raw"))).filter("s > 0").withColumn("y", F.col("y_raw") / F.col("s")))


def quick(**kw):
    return {"xs": XS, "lr": 0.1, **kw}


def quantile_columns(df, col="q"):
    return df.select(*K, *[F.col(col)[i].alias(f"q{i}") for i in range(len(TAUS))])


QS = [f"q{i}" for i in range(len(TAUS))]


@query("m01_walk_forward_splits", ["train_end", "valid_start", "valid_end"], ["n_train", "n_valid"], """SELECT train_end, valid_start, valid_end, count(*) FILTER (WHERE date BETWEEN DATE '1973-01-01' AND train_end) AS n_train, count(*) FILTER (WHERE date BETWEEN valid_start AND valid_end) AS n_valid FROM pm,
 (SELECT make_date(y - 1, 9, 30) AS train_end, make_date(y, 1, 1) AS valid_start, make_date(y + 1, 12, 31) AS valid_end FROM (VALUES (1997), (1999), (2001)) t(y)) GROUP BY 1, 2, 3""", PC)
def _(spark, d):
    sp = walk_forward(spark, 1997, 2001, 2, "Q")
    n = split_aggregates(monthly(spark, d), sp, [], {"n": ("count", F.lit(1))})
    n = n.groupBy("valid_start").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias("n_" + p) for p in ("train", "valid")])
    return sp.join(n, "valid_start")


@query("m02_linear_quantile_regression", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    return quantile_columns(Q.predict(Q.fit_quantile(f, y="y", taus=TAUS, l1=1e-4, **quick()), f))


@query("m03_two_stage_quantile_regression", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    m = Q.fit_quantile(f, y="y", taus=TAUS, stage2=["v", "p"], y2="y_raw", scale="s", **quick())
    return quantile_columns(Q.predict(m, f), "q_raw")


@query("m04_hidden_layer_quantiles", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    return quantile_columns(Q.predict(Q.fit_quantile(f, y="y", taus=TAUS, hidden=(8, 4), **quick()), f))


@query("m05_losses", ["loss"], ["first", "last"], digits=4)
def _(spark, d):
    f = features(spark, d)
    out = None
    for k in ("pinball", "huber_pinball", "mse", "huber"):
        h = Q.fit_quantile(f, y="y", taus=TAUS, loss=k, **quick()).history
        r = f.limit(1).select(F.lit(k).alias("loss"), F.lit(h[0]).alias("first"), F.lit(h[-1]).alias("last"))
        out = r if out is None else out.unionByName(r)
    return out


@query("m06_ensemble", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    return quantile_columns(Q.predict(Q.fit_quantile(f, y="y", taus=TAUS, members=3, **quick()), f))


@query("m07_fine_tuned_walk_forward", ["valid_start"], ["n", "loss"], digits=3)
def _(spark, d):
    f = Q.walk_forward_forecasts(features(spark, d), walk_forward(spark, 1999, 2001), {"y": "y", "taus": TAUS, **quick()}, fine_tune=True)
    n = f.groupBy("valid_start").agg(F.count(F.lit(1)).alias("n"))
    return n.join(V.mean_pinball(f, TAUS, "y", by=["valid_start"]), "valid_start")


_W = [[0.5, 0.2, 0.0], [-0.3, 0.1, 0.4], [0.1, 0.0, -0.2]]
_B = [-1.0, 0.0, 1.0]


@query("m08_linear_batch_scoring", K, ["q0", "q1", "q2"], "SELECT date, DTID, " + ", ".join(f"{_B[k]} + {_W[0][k]} * v + {_W[1][k]} * (p / 1000) + {_W[2][k]} * (MC / 1e7) AS q{k}" for k in range(3)) + " FROM pm", PC)
def _(spark, d):
    m = monthly(spark, d).withColumn("p", F.col("p") / 1000).withColumn("MC", F.col("MC") / 1e7)
    return Q.linear_quantiles(m, XS, _W, _B).select(*K, *[F.col("q")[k].alias(f"q{k}") for k in range(3)])


@query("m08_batch_scoring_two_heads", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    m = Q.fit_quantile(f, y="y", taus=TAUS, stage2=["v"], y2="y_raw", scale="s", members=2, **quick())
    return quantile_columns(Q.predict(m, f), "q")


@query("m09_bottleneck_activations", K, ["b0", "b1", "b2", "b3"], digits=3)
def _(spark, d):
    f = features(spark, d)
    p = Q.predict(Q.fit_quantile(f, y="y", taus=TAUS, hidden=(4,), **quick()), f, bottleneck=True)
    return p.select(*K, *[F.col("bottleneck")[i].alias(f"b{i}") for i in range(4)])


@query("m09_head_weights", ["window", "member", "tau"], ["weight"], digits=3)
def _(spark, d):
    f = features(spark, d)
    m = Q.fit_quantile(f, y="y", taus=TAUS, stage2=["v"], y2="y_raw", scale="s", heads=3, members=2, **quick())
    return Q.head_weights(m, spark, "all")


@query("m10_mean_regression", K, ["pred"], """SELECT date, DTID, my + b1 * (v - m1) + b2 * (p - m2) AS pred FROM pm, (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (SELECT avg(m) AS my, avg(v) AS m1, avg(p) AS m2,
 covar_pop(v, m) AS c1, covar_pop(p, m) AS c2, covar_pop(v, p) AS c12, var_pop(v) AS v1, var_pop(p) AS v2 FROM pm WHERE m IS NOT NULL))""", PC, digits=4)
def _(spark, d):
    m = stage(monthly(spark, d))
    w, b = Q.fit_mean(m, ["v", "p"], "m")
    return Q.linear_quantiles(m, ["v", "p"], [[x] for x in w], [b]).select(*K, F.col("q")[0].alias("pred"))


@query("m11_quantile_forest", K, QS, digits=3)
def _(spark, d):
    f = features(spark, d)
    return quantile_columns(forest.quantile_forest(f.filter("date < '2000-01-01'"), f.filter("date >= '2000-01-01'"), XS, "y", TAUS, trees=5, depth=4))


@query("m12_boosted_quantile_trees", K, ["pred"], digits=3)
def _(spark, d):
    f = features(spark, d)
    return forest.quantile_boost(f.filter("date < '2000-01-01'"), f.filter("date >= '2000-01-01'"), XS, "y", 0.9, rounds=3)


G = Grid("1995-02-01", "2001-12-01")
PAR = [(0.05, 0.9, 0.0, 0.0), (0.1, 0.85, 0.0, 0.0), (0.2, 0.6, 0.0, 0.0)]
VOLQ = f"""vp AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b, _, _) in enumerate(PAR))}) t(pid, a, b)),
 e0 AS (SELECT T, DTID, row_number() OVER (PARTITION BY T, DTID ORDER BY date) AS i, r - 0.1 AS e FROM pn JOIN g ON date >= T - INTERVAL 12 MONTH AND date < T WHERE r IS NOT NULL),
 s0 AS (SELECT T, DTID, count(*) AS n, avg(e * e) AS s2, arg_max(e, i) AS last FROM e0 GROUP BY 1, 2 HAVING count(*) >= 50),
 hh AS (SELECT x.T, x.DTID, pid, a, b, x.i, x.e, n, s2, last, power(b, x.i - 1) * s2 + coalesce(sum(power(b, x.i - 1 - y.i) * (s2 * (1 - a - b) + a * y.e * y.e)), 0) AS h FROM e0 x JOIN s0 USING (T, DTID) CROSS JOIN vp
   LEFT JOIN e0 y ON y.T = x.T AND y.DTID = x.DTID AND y.i < x.i GROUP BY x.T, x.DTID, pid, a, b, x.i, x.e, n, s2, last),
 fit AS (SELECT T, DTID, a AS alpha, b AS beta, s2 * (1 - a - b) AS omega, sqrt(hl) AS vol, last, ll FROM (SELECT T, DTID, pid, a, b, any_value(s2) AS s2, any_value(last) AS last, arg_max(h, i) AS hl, sum(-0.5 * (ln(2 * pi()) + ln(h) + e * e / h)) AS ll FROM hh GROUP BY 1, 2, 3, 4, 5)
   QUALIFY row_number() OVER (PARTITION BY T, DTID ORDER BY ll DESC) = 1)"""
VC = ["pn", grid_cte("1995-02-01", "2001-12-01"), VOLQ]


def fitted(spark, d):
    return vol.fit_vol(panel_nation(spark, d), G, 12, "garch", "normal", PAR, mu=0.1)


@query("m13_volatility_fit", ["T", "DTID"], ["alpha", "beta", "omega", "vol", "last", "ll"], "SELECT * FROM fit", VC, digits=5)
def _(spark, d):
    return fitted(spark, d)


@query("m13_volatility_fit_t_asymmetric", ["T", "DTID"], ["alpha", "beta", "gamma", "nu", "vol"], digits=4)
def _(spark, d):
    return vol.fit_vol(panel_nation(spark, d), G, 12, "gjr", "t", mu=0.1)


@query("m13_volatility_fit_ewma", ["T", "DTID"], ["vol"], """SELECT T, DTID, sqrt(sum(CASE WHEN k = n - 1 THEN power(0.94, k) ELSE 0.06 * power(0.94, k) END * e * e)) AS vol FROM (SELECT *, n - i AS k FROM e0 JOIN s0 USING (T, DTID)) GROUP BY 1, 2""", VC, digits=5)
def _(spark, d):
    return vol.fit_vol(panel_nation(spark, d), G, 12, "ewma", mu=0.1)


@query("m14_horizon_quantiles", ["T", "DTID"], ["q0", "q1", "q2"], """SELECT T, DTID, least(greatest(exp(5 * 0.01 + s * -1.2815515655446004) - 1, -1), 50) AS q0, least(greatest(exp(5 * 0.01) - 1, -1), 50) AS q1, least(greatest(exp(5 * 0.01 + s * 1.2815515655446004) - 1, -1), 50) AS q2 FROM (
 SELECT T, DTID, sqrt(5 * lr + (h1 - lr) * (1 - power(alpha + beta, 5)) / (1 - alpha - beta)) AS s FROM (SELECT *, omega / (1 - alpha - beta) AS lr, omega + alpha * last * last + beta * vol * vol AS h1 FROM fit))""", VC, digits=5)
def _(spark, d):
    q = vol.vol_quantiles(fitted(spark, d).withColumn("mu", F.lit(0.01)), (0.1, 0.5, 0.9), 5)
    return q.select("T", "DTID", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])


_NUS, _TQ = (5.0, 7.0), (0.05, 0.5, 0.9)
_Z = vol.multipliers(_TQ, "t", _NUS)


@query("m14_custom_nu", ["k"], ["q0", "q1", "q2"], f"""SELECT k, {', '.join(f"least(greatest(exp(10 * 0.001 + s * CASE nu WHEN 5 THEN {_Z[5.0][i]!r} ELSE {_Z[7.0][i]!r} END) - 1, -1), 50) AS q{i}" for i in range(3))} FROM (
 SELECT k, nu, sqrt(10 * lr + (h1 - lr) * (1 - power(alpha + beta, 10)) / (1 - alpha - beta)) AS s FROM (SELECT *, omega / (1 - alpha - beta) AS lr, omega + alpha * last * last + beta * vol * vol AS h1 FROM (
  SELECT c_custkey AS k, 0.05 + 0.001 * (c_custkey % 50) AS alpha, 0.8 AS beta, 0.0001 AS omega, 0.02 AS vol, c_acctbal / 100000 AS last, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 7 END AS nu FROM customer)))""")
def _(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), F.lit("t").alias("dist"), F.lit(0.001).alias("mu"), (0.05 + 0.001 * (k % 50)).alias("alpha"), F.lit(0.8).alias("beta"), F.lit(0.0).alias("gamma"), F.lit(0.0001).alias("omega"),
                                           F.lit(0.02).alias("vol"), (F.col("c_acctbal") / 100000).cast("double").alias("last"), F.when(k % 2 == 0, 5.0).otherwise(7.0).alias("nu"))
    return vol.vol_quantiles(p, _TQ, 10, nus=_NUS).select("k", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])


@query("m15_setting_comparison", ["setting"], ["loss"], digits=3)
def _(spark, d):
    f = features(spark, d)
    s = {"linear": quick(), "hidden4": quick(hidden=(4,)), "strong_l1": quick(l1=0.01)}
    return Q.compare_settings(f.filter("date < '2000-01-01'"), f.filter("date >= '2000-01-01'"), s, "y", TAUS)
