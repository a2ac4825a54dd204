"""Distributions, portfolios, evaluation, panel assembly."""
from pyspark.sql import functions as F

from panelquant.functions.num import nz
from panelquant.functions.stage import stage
from panelquant.operators import distribution as D, evaluate as V, portfolio as R
from panelquant.operators.asof import Grid
from panelquant.operators.series import nw_std
from panelquant.plans import panel as P
from panelquant.queries.base import grid_cte, query
from panelquant.queries.core import PM, monthly
from panelquant.sources.adapters import TAUS, panel_nation, panel_supplier, quantile_vectors, statements, table

K = ["date", "DTID"]
N = len(TAUS)
QX = f"""qx AS (SELECT date, DTID, region, y, i, tau, q0, max(q0 - i * 1e-4) OVER (PARTITION BY date, DTID ORDER BY i) + i * 1e-4 AS x FROM
 (SELECT date, DTID, region, y, unnest(q) AS q0, unnest({list(range(1, N + 1))}) AS i, unnest({list(TAUS)}::DOUBLE[]) AS tau FROM qv))"""
SEG = f"""sg AS (SELECT * FROM (SELECT *, x AS a, lead(x) OVER w AS b, tau AS fa, lead(tau) OVER w AS fb FROM qx WINDOW w AS (PARTITION BY date, DTID ORDER BY i)) WHERE i BETWEEN 2 AND {N - 2})"""
MOM = f"""mo AS (SELECT date, DTID, region, y, w0 AS m0, w1 / w0 AS m1, w2 / w0 AS m2, w3 / w0 AS m3, w4 / w0 AS m4 FROM (SELECT date, DTID, any_value(region) AS region, any_value(y) AS y,
 {', '.join(f"sum(greatest((fb - fa) / (b - a), 1e-5) * (power(b, {k + 1}) - power(a, {k + 1})) / {k + 1}) + any_value(0.1 * power(ql, {k}) + 0.1 * power(qh, {k})) AS w{k}" for k in range(5))}
 FROM sg JOIN (SELECT date, DTID, q[2] AS ql, q[{N - 1}] AS qh FROM qv) USING (date, DTID) GROUP BY 1, 2)),
 mc AS (SELECT *, m2 - m1 * m1 AS var, sqrt(m2 - m1 * m1) AS std, (m3 - 3 * m1 * (m2 - m1 * m1) - power(m1, 3)) / power(m2 - m1 * m1, 1.5) AS skew,
 (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * power(m1, 4)) / power(m2 - m1 * m1, 2) AS kurtosis FROM mo)"""
QC = ["qv", QX]


def qv(spark, d):
    return quantile_vectors(spark, d)


@query("d01_repaired_quantiles", [*K, "i"], ["x", "y"], "SELECT date, DTID, i - 1 AS i, x, tau AS y FROM qx", QC)
def _(spark, d):
    r = qv(spark, d).select(*K, F.posexplode(D.repair(F.col("q"), TAUS)).alias("i", "p"))
    return r.select(*K, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("d02_linear_moments", K, ["m0", "m1", "m2", "m3", "m4"], "SELECT * FROM mo", [*QC, SEG, MOM], digits=4)
def _(spark, d):
    return D.moments(qv(spark, d), TAUS)


@query("d03_cubic_moments", K, ["m0", "m1", "m2", "m3", "m4", "lin"], digits=4)
def _(spark, d):
    return D.moments(qv(spark, d), TAUS, method="cubic").withColumn("lin", F.col("LinearFlag").cast("int"))


@query("d04_central_moments", K, ["var", "std", "skew", "kurtosis"], "SELECT * FROM mc", [*QC, SEG, MOM], digits=5)
def _(spark, d):
    return D.moments(qv(spark, d), TAUS)


@query("d05_adjusted_moments", K, ["var_adj", "skew_adj", "kurtosis_adj"], """SELECT date, DTID, var * (1.00232494 - 0.0021291 * skew + 0.00219741 * (kurtosis - 3)) AS var_adj, 0.99495005 * skew + 0.02609106 * skew * skew + 0.01066851 * (kurtosis - 3) AS skew_adj,
 3 + 1.41849094 * (kurtosis - 3) + 0.04657378 * (kurtosis - 3) * (kurtosis - 3) - 0.73949787 * skew AS kurtosis_adj FROM mc""", [*QC, SEG, MOM], digits=5)
def _(spark, d):
    return D.adjust_moments(D.moments(qv(spark, d), TAUS))


_EMP = "emp AS (SELECT g.date, DTID, var_pop(r) AS var_t, avg(r) AS mean_t FROM ps p JOIN qg g ON p.date >= g.date - INTERVAL 12 MONTH AND p.date < g.date WHERE r IS NOT NULL GROUP BY 1, 2)"


def _implied(spark, d):
    """Implied moments beside the mean and variance of the values that the quantiles were taken from."""
    return D.moments(quantile_vectors(spark, d, spread=True), TAUS)


@query("d06_adjustment_refit", ["s"], ["b0", "b1", "b2"], """SELECT 'all' AS s, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (
 SELECT avg(z) AS my, avg(skew) AS m1, avg(k) AS m2, covar_pop(skew, z) AS c1, covar_pop(k, z) AS c2, covar_pop(skew, k) AS c12, var_pop(skew) AS v1, var_pop(k) AS v2 FROM (SELECT skew, kurtosis - 3 AS k, var_t / var AS z FROM mc JOIN emp USING (date, DTID))))""", [*QC, SEG, MOM, _EMP])
def _(spark, d):
    return D.fit_adjustment(_implied(spark, d)).withColumnRenamed("_all", "s")


@query("d07_density_table", [*K, "pos"], ["x", "cdf", "density"], "SELECT date, DTID, i - 2 AS pos, a AS x, fa AS cdf, greatest((fb - fa) / (b - a), 1e-5) AS density FROM sg", [*QC, SEG])
def _(spark, d):
    return D.density(qv(spark, d), TAUS)


@query("d08_crps", K, ["crps"], """SELECT date, DTID, sum(CASE WHEN y <= a THEN (b - a) * ((fa - 1) * (fa - 1) + (fa - 1) * (fb - 1) + (fb - 1) * (fb - 1)) / 3 WHEN y >= b THEN (b - a) * (fa * fa + fa * fb + fb * fb) / 3
  ELSE (y - a) * (fa * fa + fa * fy + fy * fy) / 3 + (b - y) * ((fy - 1) * (fy - 1) + (fy - 1) * (fb - 1) + (fb - 1) * (fb - 1)) / 3 END) + any_value(greatest(x2 - y, 0) * 0.81 + greatest(y - x6, 0) * 0.81) AS crps
 FROM (SELECT *, fa + (fb - fa) * (y - a) / (b - a) AS fy, first_value(a) OVER w AS x2, last_value(b) OVER w AS x6 FROM sg WINDOW w AS (PARTITION BY date, DTID ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1, 2""", [*QC, SEG])
def _(spark, d):
    return D.crps(qv(spark, d), TAUS)


_PB = "CASE WHEN y >= q0 THEN tau * (y - q0) ELSE (1 - tau) * (q0 - y) END"


@query("d09_crps_quantile_grid", K, ["score"], f"SELECT date, DTID, 2 * avg({_PB}) AS score FROM qx GROUP BY 1, 2", QC)
def _(spark, d):
    return D.crps_grid(qv(spark, d), TAUS)


@query("d10_trapezoid_mean", K, ["mean_v"], "SELECT date, DTID, sum((q0 + n) / 2 * (t2 - tau)) AS mean_v FROM (SELECT *, lead(q0) OVER w AS n, lead(tau) OVER w AS t2 FROM qx WINDOW w AS (PARTITION BY date, DTID ORDER BY i)) GROUP BY 1, 2", QC)
def _(spark, d):
    return D.trapezoid_mean(qv(spark, d), TAUS)


@query("d11_implied_against_sample", ["region"], ["bias_mean", "mad_var", "ratio"], """SELECT region, avg(m1 - mean_t) AS bias_mean, avg(abs(var - var_t)) AS mad_var, avg(var / var_t) AS ratio FROM mc JOIN emp USING (date, DTID) GROUP BY 1""", [*QC, SEG, MOM, _EMP])
def _(spark, d):
    return _implied(spark, d).groupBy("region").agg(F.avg(F.col("m1") - F.col("mean_t")).alias("bias_mean"), F.avg(F.abs(F.col("var") - F.col("var_t"))).alias("mad_var"), F.avg(F.col("var") / F.col("var_t")).alias("ratio"))


# ------------------------------------------------------------------ portfolios
def both(spark, d):
    """Monthly table and daily returns, from one written panel."""
    p = stage(panel_supplier(spark, d).select("DTID", "date", "region", "PRC", "VOL", "MC", "r"))
    r = F.least(F.greatest(nz("r"), F.lit(-0.5)), F.lit(0.5)) / 10
    return monthly(spark, d, p), p.withColumn("r", r)


def sorted_portfolios(spark, d):
    m, r = both(spark, d)
    return R.portfolios(R.sorts(m, "v", n=5), r)


RD = "rd AS (SELECT DTID, date, region, MC, least(greatest(coalesce(r, 0), -0.5), 0.5) / 10 AS r FROM ps)"
CUT = lambda v, n, part: f"SELECT *, " + " + ".join(f"CASE WHEN {v} >= quantile_cont({v}, {i / n}) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END" for i in range(1, n))
S1 = f"s1 AS ({CUT('v', 5, 'region, date')} AS b FROM pm)"
PC = ["ps", PM]


def ls(m, frac=0.2):
    return R.signal_ls(m, "v", frac)


LS = "ls AS (SELECT date, DTID, region, v >= h AS long, v <= l AS short FROM (SELECT *, quantile_cont(v, 0.8) OVER w AS h, quantile_cont(v, 0.2) OVER w AS l FROM pm WINDOW w AS (PARTITION BY region, date)) WHERE v >= h OR v <= l)"


@query("r01_long_short_signal", ["date", "DTID"], ["lo", "sh"], "SELECT date, DTID, long::INT AS lo, short::INT AS sh FROM ls", [*PC, LS])
def _(spark, d):
    return ls(monthly(spark, d)).withColumn("lo", F.col("long").cast("int")).withColumn("sh", F.col("short").cast("int"))


@query("r02_single_sort", ["date", "DTID", "Var"], [], "SELECT date, DTID, 'Var1_' || b AS \"Var\" FROM s1", [*PC, S1])
def _(spark, d):
    return R.sorts(monthly(spark, d), "v", n=5)


@query("r03_double_sort_independent", ["date", "DTID", "Var"], [], f"SELECT date, DTID, 'Var1_' || b || '_Var2_' || c AS \"Var\" FROM ({CUT('p', 3, 'region, date')} AS c FROM ({CUT('v', 3, 'region, date')} AS b FROM pm))", PC)
def _(spark, d):
    return R.sorts(monthly(spark, d), "v", "p", 3, "independent")


_MB = " UNION ALL ".join(f"SELECT date, DTID, region, p, {i} AS k FROM (SELECT *, quantile_cont(v, {i / 3}) OVER w AS a, quantile_cont(v, {(i + 1) / 3}) OVER w AS b FROM pm WINDOW w AS (PARTITION BY region, date)) WHERE v >= a AND v <= b" for i in range(3))


@query("r03_double_sort_dependent", ["date", "DTID", "Var"], [], f"SELECT date, DTID, 'Var1_' || arg_max(k, k * 10 + c) || '_Var2_' || arg_max(c, k * 10 + c) AS \"Var\" FROM ({CUT('p', 3, 'region, date, k')} AS c FROM ({_MB})) GROUP BY date, DTID", PC)
def _(spark, d):
    return R.sorts(monthly(spark, d), "v", "p", 3, "dependent")


@query("r04_rebalancing_map", ["date", "pred_date"], [], "SELECT r.date, s.date AS pred_date FROM (SELECT DISTINCT date FROM ps) r ASOF JOIN (SELECT DISTINCT date FROM pm) s ON r.date >= s.date", PC)
def _(spark, d):
    return R.rebalancing_map(monthly(spark, d), panel_supplier(spark, d))


WT = """cal AS (SELECT r.date, s.date AS pd FROM (SELECT DISTINCT date FROM ps) r ASOF JOIN (SELECT DISTINCT date FROM pm) s ON r.date >= s.date),
 fm AS (SELECT DTID, pd, arg_min(region, date) AS region, arg_min(MC, date) AS MC FROM rd JOIN cal USING (date) GROUP BY 1, 2),
 h0 AS (SELECT x.*, row_number() OVER w AS k, product(1 + r) OVER (PARTITION BY DTID, pd, pt ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gr FROM (SELECT c.date, c.pd, s.DTID, s.pt, f.region, f.MC, coalesce(r.r, 0) AS r
  FROM sg0 s JOIN cal c ON c.pd = s.date JOIN fm f ON f.DTID = s.DTID AND f.pd = c.pd LEFT JOIN rd r ON r.DTID = s.DTID AND r.date = c.date) x WINDOW w AS (PARTITION BY DTID, pd, pt ORDER BY date)),
 hw AS (SELECT *, w0 / sum(CASE WHEN k = 1 THEN w0 END) OVER (PARTITION BY pd, region, pt) * coalesce(gr, 1) AS wgt FROM (SELECT *, {w} AS w0 FROM h0))"""
SG0 = "sg0 AS (SELECT date, DTID, 'Var1_' || b AS pt FROM s1)"
PORT = "po AS (SELECT region, date, pt AS bucket, sum(r * wgt) AS ret FROM hw GROUP BY 1, 2, 3), pr AS (SELECT * FROM po UNION ALL SELECT 'Global', date, bucket, avg(ret) FROM po GROUP BY date, bucket)"


@query("r05_drifted_weights_vw", ["date", "DTID"], ["wgt"], "SELECT date, DTID, wgt FROM hw", [*PC, RD, S1, SG0, WT.format(w="MC")], digits=8)
def _(spark, d):
    m, r = both(spark, d)
    return R.weights(R.sorts(m, "v", n=5), r, "VW")


@query("r06_sorted_portfolio_returns", ["region", "date", "bucket"], ["ret"], "SELECT * FROM pr", [*PC, RD, S1, SG0, WT.format(w="1.0"), PORT], digits=8)
def _(spark, d):
    return sorted_portfolios(spark, d)


LSW = ["sg0 AS (SELECT date, DTID, long::INT * 2 + short::INT AS pt FROM ls)", WT.format(w="1.0"),
       """lp AS (SELECT region, date, sum(r * wgt) FILTER (WHERE pt >= 2) AS long, sum(r * wgt) FILTER (WHERE pt IN (1, 3)) AS short FROM hw GROUP BY 1, 2),
 lg AS (SELECT *, long - short AS ls FROM (SELECT * FROM lp UNION ALL SELECT 'Global', date, avg(long), avg(short) FROM lp GROUP BY date))"""]


@query("r06_long_short_returns", ["region", "date", "bucket"], ["ret"], "SELECT * FROM (SELECT region, date, unnest(['long', 'short', 'ls']) AS bucket, unnest([long, short, ls]) AS ret FROM lg) WHERE ret IS NOT NULL", [*PC, RD, LS, *LSW], digits=8)
def _(spark, d):
    m, r = both(spark, d)
    return R.portfolios(ls(m), r, "EW", "LS")


@query("r07_high_minus_low", ["region", "date", "bucket"], ["ret"], "SELECT * FROM pr UNION ALL SELECT a.region, a.date, 'Var1_5', a.ret - b.ret FROM pr a JOIN pr b USING (region, date) WHERE a.bucket = 'Var1_4' AND b.bucket = 'Var1_0'", [*PC, RD, S1, SG0, WT.format(w="1.0"), PORT], digits=8)
def _(spark, d):
    return R.high_minus_low(sorted_portfolios(spark, d), 5)


def nw_sql(src, key, x="x", date="date"):
    lagp = " + ".join(f"2 * (1 - {z} / 13.0) * coalesce(CASE WHEN rn - {z} >= 2 THEN hd * lag(hd, {z}) OVER w END, 0)" for z in range(1, 13))
    return (f"SELECT {key}, n, mean, sd, CASE WHEN n >= 14 AND ss >= 0 THEN sqrt(ss / n) END AS nw FROM (SELECT {key}, count(*) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd, sum(hd * hd + q) AS ss FROM (SELECT *, {lagp} AS q FROM (SELECT *, "
            f"{x} - avg({x}) OVER (PARTITION BY {key}) AS hd, row_number() OVER (PARTITION BY {key} ORDER BY {date}) AS rn FROM {src} WHERE {x} IS NOT NULL) WINDOW w AS (PARTITION BY {key} ORDER BY {date})) GROUP BY {key})")


DD = lambda src, key, x: f"SELECT {key}, min(y / greatest(pk, y) - 1) AS dd FROM (SELECT *, max(y) OVER (PARTITION BY {key} ORDER BY date) AS pk FROM (SELECT *, product(1 + {x}) OVER (PARTITION BY {key} ORDER BY date) AS y FROM {src})) GROUP BY {key}"


@query("r08_portfolio_metrics", ["region", "bucket"], ["n", "mean", "std_nw", "t", "sr", "max_dd"], f"""SELECT region, bucket, n, mean * 100 AS mean, nw * 100 AS std_nw, mean / nw * sqrt(n) AS t, mean / sd * sqrt(260) AS sr, least(dd, 0) * 100 AS max_dd
 FROM ({nw_sql('pr', 'region, bucket', 'ret')}) JOIN ({DD('pr', 'region, bucket', 'ret')}) USING (region, bucket)""", [*PC, RD, S1, SG0, WT.format(w="1.0"), PORT], digits=5)
def _(spark, d):
    return R.metrics(sorted_portfolios(spark, d), "D")


def _leg(c):
    return f"(SELECT date, DTID, {c} >= h AS long, {c} <= l AS short FROM (SELECT *, quantile_cont({c}, 0.8) OVER w AS h, quantile_cont({c}, 0.2) OVER w AS l FROM pm WINDOW w AS (PARTITION BY region, date)) WHERE {c} >= h OR {c} <= l)"


def _legsql(c, t):
    return WT.format(w="1.0").replace("sg0", f"sg{t}").replace("cal AS", f"cal{t} AS").replace("cal c", f"cal{t} c").replace("JOIN cal ", f"JOIN cal{t} ").replace("fm", f"fm{t}").replace("h0", f"h{t}0").replace("hw", f"hw{t}")


@query("r09_cross_variable_long_short", ["region", "date"], ["ret"], """SELECT a.region, a.date, a.x - b.x AS ret FROM (SELECT region, date, sum(r * wgt) AS x FROM hwA WHERE pt >= 2 GROUP BY 1, 2 UNION ALL SELECT 'Global', date, avg(x) FROM (SELECT region, date, sum(r * wgt) AS x FROM hwA WHERE pt >= 2 GROUP BY 1, 2) GROUP BY 2) a
 JOIN (SELECT region, date, sum(r * wgt) AS x FROM hwB WHERE pt IN (1, 3) GROUP BY 1, 2 UNION ALL SELECT 'Global', date, avg(x) FROM (SELECT region, date, sum(r * wgt) AS x FROM hwB WHERE pt IN (1, 3) GROUP BY 1, 2) GROUP BY 2) b USING (region, date)""",
       [*PC, RD, f"sgA AS (SELECT date, DTID, long::INT * 2 + short::INT AS pt FROM {_leg('v')})", _legsql("v", "A"), f"sgB AS (SELECT date, DTID, long::INT * 2 + short::INT AS pt FROM {_leg('p')})", _legsql("p", "B")], digits=8)
def _(spark, d):
    return R.cross_quantile_ls(*both(spark, d), "v", "p", 0.2)


@query("r10_strategy_difference", ["region"], ["n", "diff", "t"], f"""SELECT region, n, mean AS diff, mean / nw * sqrt(n) AS t FROM ({nw_sql('dx', 'region')})""",
       [*PC, RD, S1, SG0, WT.format(w="1.0"), PORT, "dx AS (SELECT a.region, a.date, a.ret - b.ret AS x FROM pr a JOIN pr b USING (region, date) WHERE a.bucket = 'Var1_4' AND b.bucket = 'Var1_2')"])
def _(spark, d):
    p = sorted_portfolios(spark, d)
    return R.strategy_difference(p.filter("bucket = 'Var1_4'"), p.filter("bucket = 'Var1_2'"))


# ------------------------------------------------------------------ evaluation
@query("v01_pinball_by_level", ["region", "tau"], ["loss"], f"SELECT region, tau, avg({_PB}) AS loss FROM qx GROUP BY 1, 2", QC)
def _(spark, d):
    return V.pinball(qv(spark, d), TAUS, by=["region"])


@query("v01_mean_pinball_by_date", ["date", "region"], ["loss"], f"SELECT date, region, avg({_PB}) AS loss FROM qx GROUP BY 1, 2", QC)
def _(spark, d):
    return V.mean_pinball(qv(spark, d), TAUS, by=["date", "region"])


_ZERO = "CASE WHEN y >= 0 THEN tau * y ELSE (tau - 1) * y END"


@query("v02_loss_against_benchmark", ["region"], ["n", "diff", "t"], f"SELECT region, n, mean AS diff, mean / nw * sqrt(n) AS t FROM ({nw_sql('dx', 'region')})",
       [*QC, f"dx AS (SELECT region, date, avg({_ZERO}) - avg({_PB}) AS x FROM qx GROUP BY 1, 2)"])
def _(spark, d):
    q = qv(spark, d)
    zero = q.withColumn("q", F.transform("q", lambda v: v * 0.0))
    by = ["region", "date"]
    return V.compare_losses(V.mean_pinball(q, TAUS, by=by), V.mean_pinball(zero, TAUS, by=by), ["region"])


@query("v03_fit_statistics", ["region"], ["r2", "rmse", "mad"], """SELECT region, 1 - sum((y - p) * (y - p)) / sum(y * y) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mad FROM (
 SELECT region, y, q[4] AS p FROM qv UNION ALL SELECT 'Global', y, q[4] FROM qv) GROUP BY 1""", ["qv"])
def _(spark, d):
    return V.fit_statistics(qv(spark, d).withColumn("p", F.col("q")[3]), "p", "y")


@query("v04_newey_west", ["DTID"], ["n", "mean", "nw"], nw_sql("pn", "DTID", "r"), ["pn"], digits=7)
def _(spark, d):
    return nw_std(panel_nation(spark, d), "DTID", "date", "r")


@query("v05_diebold_mariano", ["region"], ["n", "t"], f"SELECT region, n, mean / nw * sqrt(n) AS t FROM ({nw_sql('dx', 'region')})",
       ["qv", "dx AS (SELECT region, date, avg(power(y - q[3], 2)) - avg(power(y - q[4], 2)) AS x FROM (SELECT * FROM qv UNION ALL SELECT * REPLACE ('Global' AS region) FROM qv) GROUP BY 1, 2)"])
def _(spark, d):
    q = qv(spark, d).withColumn("a", F.col("q")[3]).withColumn("b", F.col("q")[2])
    return V.diebold_mariano(q, "a", "b", "y")


@query("v06_excess_returns", ["date", "DTID"], ["m_excess"], "SELECT p.date, DTID, m - rf / 100 AS m_excess FROM pm p LEFT JOIN (SELECT date, avg(p) / 10000 AS rf FROM pm GROUP BY 1) r ON p.date = r.date", PC)
def _(spark, d):
    m = monthly(spark, d)
    return V.excess_returns(m, m.groupBy("date").agg((F.avg("p") / 10000).alias("RF")), "m")


@query("v07_observation_counts", ["region"], ["min", "mean", "max"], "SELECT region, min(n) AS min, avg(n) AS mean, max(n) AS max FROM (SELECT region, date, count(*) AS n FROM pm GROUP BY 1, 2) GROUP BY 1", PC)
def _(spark, d):
    return V.observation_counts(monthly(spark, d))


@query("v08_moment_summary", ["var"], ["mean", "median", "std"], "SELECT var, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std FROM (SELECT unnest(['m1', 'std', 'skew', 'kurtosis']) AS var, unnest([m1, std, skew, kurtosis]) AS x FROM mc) GROUP BY 1", [*QC, SEG, MOM])
def _(spark, d):
    return V.moment_summary(D.moments(qv(spark, d), TAUS), ["m1", "std", "skew", "kurtosis"])


@query("v08_trimmed_histogram", ["var"], {"bin": 0, "n": 0, "lo": 4, "hi": 4}, """SELECT var, bin, any_value(a + bin * (b - a) / 20) AS lo, any_value(a + (bin + 1) * (b - a) / 20) AS hi, count(*) AS n FROM (SELECT *, least(floor((x - a) / ((b - a) / 20)), 19) AS bin FROM (SELECT *, quantile_cont(x, 0.01) OVER w AS a, quantile_cont(x, 0.99) OVER w AS b FROM (SELECT unnest(['v', 'p']) AS var, unnest([v, p]) AS x FROM pm) WINDOW w AS (PARTITION BY var))
 WHERE x >= a AND x <= b) GROUP BY 1, 2""", PC)
def _(spark, d):
    return V.trimmed_histogram(monthly(spark, d), ["v", "p"], 20)


@query("v09_moment_rank_correlations", ["a", "b"], ["rho"], """SELECT a, b, avg(rho) FILTER (WHERE NOT isnan(rho)) AS rho FROM (SELECT date, x.k AS a, y.k AS b, corr(x.rk, y.rk) AS rho FROM rk x JOIN rk y USING (date, DTID) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
       [*QC, SEG, MOM, "rk AS (SELECT date, DTID, k, rank() OVER (PARTITION BY date, k ORDER BY x) + (count(*) OVER (PARTITION BY date, k, x) - 1) / 2.0 AS rk FROM (SELECT date, DTID, unnest(['m1', 'std', 'skew']) AS k, unnest([m1, std, skew]) AS x FROM mc))"])
def _(spark, d):
    return V.rank_correlations(D.moments(qv(spark, d), TAUS), ["m1", "std", "skew"])


@query("v10_common_sample", ["date", "DTID"], [], "SELECT date, DTID FROM pm WHERE v > 20 INTERSECT SELECT date, DTID FROM pm WHERE p > 1500 INTERSECT SELECT date, DTID FROM pm WHERE m > 0", PC)
def _(spark, d):
    m = monthly(spark, d)
    return V.common_sample({"a": m.filter("v > 20"), "b": m.filter("p > 1500"), "c": m.filter("m > 0")})


@query("v11_implied_scaler", ["date"], ["scaler"], "SELECT date, quantile_cont(p / (v * MC), 0.5) AS scaler FROM pm GROUP BY 1", PC, digits=10)
def _(spark, d):
    return V.implied_scaler(monthly(spark, d), "p", "v", "MC")


@query("v12_volatility_comparison", ["region"], ["r2a", "r2b", "t"], f"""SELECT region, r2a, r2b, mean / nw * sqrt(n) AS t FROM ({nw_sql('dx', 'region')}) JOIN (SELECT region, 1 - sum(power(vol - f1, 2)) / sum(vol * vol) AS r2a, 1 - sum(power(vol - f2, 2)) / sum(vol * vol) AS r2b FROM vv GROUP BY 1) USING (region)""",
       ["pn", """v0 AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, DTID, region, sqrt(sum(r * r)) AS vol FROM pn WHERE r IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 15),
  v1 AS (SELECT a.date, a.DTID, a.region, a.vol / 10 AS vol, b.vol / 10 AS f1, c.vol / 10 AS f2 FROM v0 a JOIN v0 b ON a.DTID = b.DTID AND b.date = a.date - INTERVAL 1 MONTH JOIN v0 c ON a.DTID = c.DTID AND c.date = a.date - INTERVAL 2 MONTH WHERE b.vol / 10 < 1 AND c.vol / 10 < 1),
  vv AS (SELECT * FROM v1 UNION ALL SELECT * REPLACE ('Global' AS region) FROM v1), dx AS (SELECT region, date, avg(power(vol - f2, 2)) - avg(power(vol - f1, 2)) AS x FROM vv GROUP BY 1, 2)"""])
def _(spark, d):
    p = panel_nation(spark, d)
    reg = p.select("DTID", "region").distinct()
    v = P.realised_variance(p).select("date", "DTID", (F.col("vol") / 10).alias("vol"))
    lag = lambda k: v.select(F.add_months("date", k).alias("date"), "DTID", F.col("vol").alias(f"f{k}"))
    j = v.join(lag(1), K).join(lag(2), K).join(reg, "DTID").filter("f1 < 1 and f2 < 1")
    st = lambda f, n: V.fit_statistics(j, f, "vol").select("region", F.col("r2").alias(n))
    return st("f1", "r2a").join(st("f2", "r2b"), "region").join(V.diebold_mariano(j, "f1", "f2", "vol"), "region")


# ------------------------------------------------------------------ panel assembly
G = Grid("1995-02-01", "2001-12-01")
GC = grid_cte("1995-02-01", "2001-12-01")
FR = """fr AS (SELECT DTID, T AS date, arg_max(RI, date) / arg_max(RI, date) FILTER (WHERE date < T) - 1 AS r FROM ps JOIN g ON date >= T - 7 AND date < T + INTERVAL 1 MONTH GROUP BY 1, 2 HAVING count(*) FILTER (WHERE date < T) > 0)"""


def fwd(spark, d):
    return P.forward_returns(panel_supplier(spark, d), G.df(spark).select(F.col("T").alias("start"), F.add_months("T", 1).alias("end")))


@query("a01_forward_returns", K, ["r"], "SELECT * FROM fr", ["ps", GC, FR])
def _(spark, d):
    return fwd(spark, d)


@query("a02_return_cleaning", K, ["r"], """SELECT DTID, date, CASE WHEN (r > 0.9 OR f > 0.9) AND (1 + f) * (1 + r) < 1.1 THEN NULL ELSE r END AS r FROM (SELECT DTID, date, f, CASE WHEN (r > 0.9 OR l > 0.9) AND (1 + l) * (1 + r) < 1.1 THEN NULL ELSE r END AS r FROM (
 SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS f FROM (SELECT DTID, date, CASE WHEN r <= 5 THEN r END AS r FROM (SELECT DTID, date, CASE WHEN year(date) < 2001 THEN least(greatest(r, quantile_cont(r, 0.05) OVER v), quantile_cont(r, 0.95) OVER v) ELSE r END AS r FROM fr WINDOW v AS (PARTITION BY date)))
 WINDOW w AS (PARTITION BY DTID ORDER BY date)))""", ["ps", GC, FR])
def _(spark, d):
    return P.clean_returns(fwd(spark, d), eras=((2001, 0.05),), cap=5.0, spike=0.9, back=1.1)


CH = """ch AS (SELECT T AS date, DTID, arg_max(region, date) AS region, arg_max(MC, date) AS MC, arg_max(PRC, date) AS PRC, arg_max(RI, date) AS RI, arg_max(FTID, date) AS COID, CASE WHEN count(*) >= 50 THEN avg(VOL * PRC) / 1e6 END AS VOL
 FROM ps JOIN g ON date >= T - INTERVAL 12 MONTH AND date < T GROUP BY T, DTID HAVING max(date) > T - 7)"""


@query("a03_universe_characteristics", [*K, "region", "COID"], {"MC": 3, "PRC": 6, "RI": 6, "VOL": 6}, "SELECT * FROM ch", ["ps", GC, CH])
def _(spark, d):
    return P.characteristics(panel_supplier(spark, d), G)


UN = """un AS (SELECT date, DTID, COID, region, MC, VOL, PRC, CASE WHEN mcs <= 0.2 OR (vs <= 0.1 AND (vs <> 0 OR mcs <= 0.4)) OR PRC <= CASE region WHEN 'ASIA' THEN 900 ELSE 600 END THEN 0 ELSE 1 END AS ok FROM (
 SELECT *, sum(MC) OVER (PARTITION BY date, region ORDER BY MC, DTID) / sum(MC) OVER v AS mcs, sum(VOL) OVER (PARTITION BY date, region ORDER BY VOL, DTID) / sum(VOL) OVER v AS vs FROM (SELECT * REPLACE (coalesce(VOL, 0) AS VOL) FROM ch) WINDOW v AS (PARTITION BY date, region)) WHERE RI >= 300)"""
_PRL = {"ASIA": 900.0, "AFRICA": 600.0, "AMERICA": 600.0, "EUROPE": 600.0, "MIDDLE EAST": 600.0}


def uni(spark, d):
    return P.universe(panel_supplier(spark, d), G, 0.2, 0.1, _PRL, 300.0)


@query("a04_universe_eligibility", [*K, "COID"], {"MC": 3, "VOL": 6, "ok": 0}, "SELECT * FROM un", ["ps", GC, CH, UN])
def _(spark, d):
    return uni(spark, d).withColumn("ok", F.col("Eligible").cast("int"))


def sigs(spark, d):
    from panelquant.signals import compute_signals

    return compute_signals({"dt": panel_supplier(spark, d), "FT": statements(spark, d, ["at", "sale"], with_mc=False)}, G, ["TV3M", "Mom", "CT"])


SGN = """sn AS (SELECT b.T AS date, b.DTID, f.FTID, "TV3M", "Mom", "CT" FROM (SELECT DISTINCT T, DTID FROM ps JOIN g ON date >= T - INTERVAL 1 MONTH AND date < T) b
 LEFT JOIN (SELECT T, DTID, stddev_samp(r) AS "TV3M" FROM ps JOIN g ON date >= T - INTERVAL 3 MONTH AND date < T GROUP BY 1, 2) x ON x.T = b.T AND x.DTID = b.DTID
 LEFT JOIN (SELECT T, DTID, arg_max(RI, date) / arg_max(RI, date) FILTER (WHERE date <= T - INTERVAL 7 MONTH) - 1 AS "Mom" FROM ps JOIN g ON date >= T - INTERVAL 8 MONTH AND date < T - INTERVAL 1 MONTH GROUP BY 1, 2) y ON y.T = b.T AND y.DTID = b.DTID
 LEFT JOIN (SELECT T, DTID, arg_max(FTID, date) AS FTID FROM ft JOIN g ON date >= T - INTERVAL 18 MONTH AND date < T GROUP BY 1, 2) f ON f.T = b.T AND f.DTID = b.DTID
 LEFT JOIN (SELECT T, FTID, arg_max(ct, date) FILTER (WHERE ct IS NOT NULL) AS "CT" FROM (SELECT T, FTID, date, sale / lag("at") OVER (PARTITION BY T, FTID ORDER BY date) AS ct FROM ft JOIN g ON date >= T - INTERVAL 30 MONTH AND date < T) GROUP BY 1, 2) c ON c.T = b.T AND c.FTID = f.FTID)"""


@query("e07_assembled_signals", ["T", "DTID", "FTID"], ["TV3M", "Mom", "CT"], 'SELECT date AS T, DTID, FTID, "TV3M", "Mom", "CT" FROM sn', ["ps", "ft", GC, SGN])
def _(spark, d):
    return sigs(spark, d)


_RK = lambda c: f"coalesce((CASE WHEN \"{c}\" IS NOT NULL THEN rank() OVER (PARTITION BY date, region, \"{c}\" IS NULL ORDER BY \"{c}\") + (count(*) OVER (PARTITION BY date, region, \"{c}\") - 1) / 2.0 END) / count(\"{c}\") OVER (PARTITION BY date, region), 0.5) AS \"{c}\""
MT = """mt AS (SELECT * FROM (SELECT u.date, u.DTID, u.region, u.MC, u.COID, coalesce(f.r, 0) AS r, "TV3M", "Mom", "CT", row_number() OVER (PARTITION BY u.COID, u.date ORDER BY CASE WHEN s.FTID IS NULL THEN 1 ELSE 0 END, u.DTID) AS k FROM un u
 LEFT JOIN fr f ON f.date = u.date AND f.DTID = u.DTID LEFT JOIN sn s ON s.date = u.date AND s.DTID = u.DTID WHERE u.ok = 1) WHERE k = 1 OR COID IS NULL)"""


@query("a05_model_table_ranked", [*K, "region"], ["MC", "r", "TV3M", "Mom", "CT"], f"SELECT date, DTID, region, MC, r, {', '.join(_RK(c) for c in ('TV3M', 'Mom', 'CT'))} FROM mt", ["ps", "ft", GC, FR, CH, UN, SGN, MT])
def _(spark, d):
    return P.model_table(fwd(spark, d), sigs(spark, d), uni(spark, d))


@query("a05_model_table_standardised", K, ["TV3M"], 'SELECT date, DTID, coalesce(("TV3M" - avg("TV3M") OVER w) / nullif(stddev_samp("TV3M") OVER w, 0), 0) AS "TV3M" FROM mt WINDOW w AS (PARTITION BY date, region)', ["ps", "ft", GC, FR, CH, UN, SGN, MT])
def _(spark, d):
    return P.model_table(fwd(spark, d), sigs(spark, d), uni(spark, d), "Standardize", exclude=["Mom", "CT"])


@query("o02_dedup_by_priority", ["FTID", "date"], ["PRC"], "SELECT FTID, date, arg_min(PRC, (-MC, DTID)) AS PRC FROM ps GROUP BY 1, 2", ["ps"])
def _(spark, d):
    return panel_supplier(spark, d).groupBy("FTID", "date").agg(F.min_by("PRC", F.struct(-F.col("MC"), F.col("DTID"))).alias("PRC"))


@query("o04_one_security_per_firm", [*K, "COID"], ["MC"], "SELECT date, DTID, COID, MC FROM mt", ["ps", "ft", GC, FR, CH, UN, SGN, MT])
def _(spark, d):
    s = sigs(spark, d).withColumnRenamed("T", "date").select("date", "DTID", "FTID")
    return P.one_per_firm(uni(spark, d).filter("Eligible").join(s, K, "left"))


EWP = """ew AS (SELECT region, date, avg(r) AS x, row_number() OVER (PARTITION BY region ORDER BY date) AS i FROM ps WHERE r IS NOT NULL GROUP BY 1, 2),
 mm AS (SELECT region, lead(date) OVER (PARTITION BY region ORDER BY date) AS date, a10, a1 FROM (SELECT a.region, a.date, sum(CASE WHEN b.i = 1 THEN power(0.9, a.i - 1) ELSE 0.1 * power(0.9, a.i - b.i) END * b.x) AS a10,
  sum(CASE WHEN b.i = 1 THEN power(0.99, a.i - 1) ELSE 0.01 * power(0.99, a.i - b.i) END * b.x) AS a1 FROM ew a JOIN ew b ON a.region = b.region AND b.i <= a.i GROUP BY 1, 2))"""


@query("a06_market_mean_series", ["region", "date"], ["a10", "a1"], "SELECT * FROM mm WHERE date IS NOT NULL", ["ps", EWP])
def _(spark, d):
    m = P.market_mean(panel_supplier(spark, d), (10, 1))
    return m.select("region", "date", F.col("MktAvg10_EW").alias("a10"), F.col("MktAvg1_EW").alias("a1"))


@query("a07_daily_return_lagged_mc", ["DTID", "date"], {"r": 6, "MC": 3}, "SELECT DTID, date, r, m AS MC FROM (SELECT *, lag(MC) OVER (PARTITION BY DTID ORDER BY date) AS m FROM ps) WHERE r IS NOT NULL AND date >= DATE '1995-01-01' AND date <= DATE '2001-12-31'", ["ps"])
def _(spark, d):
    return P.daily_returns(panel_supplier(spark, d), "1995-01-01", "2001-12-31")


@query("a08_realised_variance", ["DTID", "date"], ["var", "vol"], "SELECT DTID, date_trunc('month', date)::DATE AS date, sum(r * r) AS var, sqrt(sum(r * r)) AS vol FROM pn WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15", ["pn"])
def _(spark, d):
    return P.realised_variance(panel_nation(spark, d))


@query("a09_monthly_returns", K, {"r": 6, "MC": 3}, "SELECT f.date, f.DTID, f.r, u.MC FROM fr f JOIN un u ON f.date = u.date AND f.DTID = u.DTID WHERE f.date BETWEEN DATE '1995-02-01' AND DATE '2001-12-01'", ["ps", GC, FR, CH, UN])
def _(spark, d):
    return P.monthly_returns(fwd(spark, d), uni(spark, d), "1995-02-01", "2001-12-01")


@query("a10_enriched_features", K, ["v", "v_raw", "v_mean", "r", "r_scale", "mkt"], """SELECT date, DTID, v / g AS v, v / 0.022 AS v_raw, g / 0.022 AS v_mean, r / (g / 0.022 * 0.11) AS r, g / 0.022 * 0.11 AS r_scale, a10 / (g / 0.022 * 0.11) AS mkt FROM (
 SELECT f.*, m.a10 FROM (SELECT *, avg(v) OVER (PARTITION BY date, region) AS g FROM (SELECT date, DTID, region, r, coalesce(m, avg(m) OVER (PARTITION BY date, region)) AS v FROM (SELECT date, DTID, region, p / 10000 AS r, abs(m) AS m FROM pm))) f
 ASOF LEFT JOIN (SELECT * FROM mm WHERE date IS NOT NULL) m ON f.region = m.region AND f.date >= m.date)""", ["ps", PM, EWP], digits=5)
def _(spark, d):
    m = monthly(spark, d).select("date", "DTID", "region", (F.col("p") / 10000).alias("r"), F.abs("m").alias("EWMAVol6"))
    e = P.enrich(m, ["EWMAVol6"], P.market_mean(panel_supplier(spark, d), (10,)), ["MktAvg10_EW"])
    return e.select(*K, F.col("EWMAVol6").alias("v"), F.col("EWMAVol6_raw").alias("v_raw"), F.col("EWMAVol6_mean").alias("v_mean"), "r", "r_scale", F.col("MktAvg10_EW").alias("mkt"))


@query("a11_statement_market_value", ["FTID", "FinYearEnd", "DTID"], ["MC", "ajex"], """SELECT f.FTID, f.FinYearEnd, coalesce(m.DTID, f.DTID) AS DTID, m.MC, m.ajex FROM (SELECT CAST(s_nationkey AS VARCHAR) AS FTID, DTID, FinYearEnd FROM ft JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ft.FTID) f
 ASOF LEFT JOIN (SELECT FTID, date, arg_min(DTID, (mj, DTID)) AS DTID, arg_min(MC, (mj, DTID)) AS MC, arg_min(AF, (mj, DTID)) AS ajex FROM (SELECT *, CASE WHEN CAST(DTID AS BIGINT) % 3 = 0 THEN 0 ELSE 1 END AS mj FROM ps) GROUP BY 1, 2) m ON f.FTID = m.FTID AND f.FinYearEnd >= m.date""", ["ps", "ft"])
def _(spark, d):
    su = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("DTID"), F.col("s_nationkey").cast("string").alias("FTID"))
    mj = su.withColumn("MAJOR", F.when(F.col("DTID").cast("long") % 3 == 0, "Y").otherwise("N"))
    ft = statements(spark, d, ["sale"], with_mc=False).drop("FTID").join(su, "DTID")
    return P.attach_market_value(ft, panel_supplier(spark, d), mj, factor=True)


@query("flagship_momentum_strategy", ["region", "bucket"], ["n", "mean", "t", "sr", "max_dd"], digits=5)
def _(spark, d):
    from panelquant.plans.flagship import flagship

    return flagship(spark, d)
