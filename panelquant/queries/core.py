"""Joins, as-of engine, cross-sections, windows, aggregations."""
from pyspark.sql import Window as W, functions as F

from panelquant.functions.num import dated_mean, fdiv, fln, fpow, month_no, month_start, null_if, nz
from panelquant.operators import asof as A, series as S, xsection as X
from panelquant.operators.asof import Agg, Grid
from panelquant.queries.base import grid_cte, query
from panelquant.sources.adapters import (analyst_sum, events_panel, link_intervals, panel_nation, panel_supplier,
                                         statements, table)

G = Grid("1995-02-01", "2001-12-01")
GC = grid_cte("1995-02-01", "2001-12-01")


# ------------------------------------------------------------------ joins
@query("j01_inner_equi_join", ["DTID", "date", "INDM"], ["PRC"], """
 SELECT DTID, date, INDM, PRC FROM ps JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS k, n_name AS INDM FROM supplier JOIN nation ON s_nationkey = n_nationkey) m ON k = DTID""", ["ps"])
def _(spark, d):
    m = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = m.select(F.col("s_suppkey").cast("string").alias("DTID"), F.col("n_name").alias("INDM"))
    return panel_supplier(spark, d).join(m, "DTID")


@query("j02_outer_equi_join", ["DTID", "T"], ["a", "b"], """
 SELECT coalesce(x.DTID, y.DTID) AS DTID, coalesce(x.m, y.m) AS T, a, b FROM
  (SELECT DTID, CAST(date_trunc('month', date) AS DATE) AS m, sum(VOL) AS a FROM pn WHERE PRC > 1500 GROUP BY 1, 2) x FULL JOIN
  (SELECT DTID, CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS b FROM pn WHERE r > 0.5 GROUP BY 1, 2) y ON x.DTID = y.DTID AND x.m = y.m""", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d).withColumn("T", month_start(month_no("date")))
    return p.filter("PRC > 1500").groupBy("DTID", "T").agg(F.sum("VOL").alias("a")).join(
        p.filter("r > 0.5").groupBy("DTID", "T").agg(F.count(F.lit(1)).alias("b")), ["DTID", "T"], "outer")


@query("j03_asof_join", ["o_orderkey", "date", "src"], ["PRC"], """
 SELECT o_orderkey, o.date, p.date AS src, p.PRC FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 25 AS VARCHAR) AS k FROM orders) o
 ASOF LEFT JOIN pn p ON o.k = p.DTID AND o.date >= p.date""", ["pn"])
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 25).cast("string").alias("DTID"))
    return A.asof_join(o, panel_nation(spark, d).select("DTID", "date", "PRC"), "date", "DTID", keep_date="src")


@query("j03_asof_join_strict", ["o_orderkey"], ["PRC"], """
 SELECT o_orderkey, p.PRC FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 25 AS VARCHAR) AS k FROM orders) o
 ASOF LEFT JOIN pn p ON o.k = p.DTID AND o.date > p.date""", ["pn"])
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 25).cast("string").alias("DTID"))
    return A.asof_join(o, panel_nation(spark, d).select("DTID", "date", "PRC"), "date", "DTID", allow_exact=False)


@query("j04_validity_interval_join", ["TICKER", "date", "FPI", "PERMNO"], ["MEANEST"], """
 SELECT a.TICKER, a.date, FPI, CASE WHEN l."end" IS NULL OR a.date <= l."end" THEN l.PERMNO END AS PERMNO, MEANEST
 FROM asum a ASOF LEFT JOIN link l ON a.TICKER = l.TICKER AND a.date >= l.start""", ["asum", "link"])
def _(spark, d):
    return A.interval_join(analyst_sum(spark, d), link_intervals(spark, d), "date", "TICKER", "start", "end")


@query("j05_overlapping_interval_join", ["o_orderkey", "lab"], [], """
 SELECT o_orderkey, (SELECT arg_min(lab, n) FROM iv WHERE iv.TICKER = o.TICKER AND o.date >= a AND (b IS NULL OR o.date <= b)) AS lab
 FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS VARCHAR) AS TICKER, CAST(o_orderdate AS DATE) AS date FROM orders) o""",
       ["link", """iv AS (SELECT TICKER, lab, a, b, row_number() OVER (PARTITION BY TICKER ORDER BY a, lab) AS n FROM (
  SELECT TICKER, PERMNO AS lab, start AS a, "end" AS b FROM link UNION ALL SELECT TICKER, PERMNO || 'x', start - 90, start + 400 FROM link))"""])
def _(spark, d):
    l = link_intervals(spark, d)
    iv = l.select("TICKER", F.col("PERMNO").alias("lab"), F.col("start").alias("a"), F.col("end").alias("b")).unionByName(
        l.select("TICKER", F.concat("PERMNO", F.lit("x")).alias("lab"), F.date_sub("start", 90).alias("a"), F.date_add("start", 400).alias("b")))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("string").alias("TICKER"), F.to_date("o_orderdate").alias("date"))
    return A.overlap_join(o, iv, "date", "TICKER", "a", "b", ["a", "lab"])


@query("j06_anti_semi_join", ["DTID", "date"], ["PRC"], """
 SELECT DTID, date, PRC FROM ps WHERE DTID NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)
 AND DTID IN (SELECT DTID FROM ps WHERE date >= DATE '2001-06-01')""", ["ps"])
def _(spark, d):
    p = panel_supplier(spark, d)
    bad = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("DTID"))
    live = p.filter("date >= '2001-06-01'").select("DTID").distinct()
    return p.join(bad, "DTID", "left_anti").join(live, "DTID", "left_semi")


@query("j07_date_range_join", ["DTID", "valid_start", "part"], ["n", "s"], """
 SELECT DTID, valid_start, part, count(*) AS n, sum(PRC) AS s FROM ps JOIN (
  SELECT make_date(y, 1, 1) AS valid_start, 'train' AS part, DATE '1973-01-01' AS a, make_date(y - 1, 11, 29) AS b FROM (VALUES (1998), (1999), (2000), (2001)) t(y)
  UNION ALL SELECT make_date(y, 1, 1), 'valid', make_date(y, 1, 1), make_date(y, 12, 31) FROM (VALUES (1998), (1999), (2000), (2001)) t(y)) w
 ON date >= a AND date <= b GROUP BY 1, 2, 3""", ["ps"], digits=3)
def _(spark, d):
    from panelquant.models.splits import split_aggregates, walk_forward

    return split_aggregates(panel_supplier(spark, d), walk_forward(spark, 1998, 2001), "DTID", {"n": ("count", F.lit(1)), "s": ("sum", "PRC")})


@query("j08_id_by_grid", ["DTID", "m"], [], """
 SELECT DISTINCT DTID, m FROM (SELECT DISTINCT DTID FROM pn), (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m)""", ["pn"])
def _(spark, d):
    ids = panel_nation(spark, d).select("DTID").distinct()
    return ids.withColumn("m", F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-01', interval 1 month)")))


@query("j09_self_lag_asof", ["DTID", "date"], ["RI", "RI_lag", "ret"], """
 SELECT p.DTID, p.date, p.RI, q.RI AS RI_lag, p.RI / q.RI - 1 AS ret FROM pn p ASOF LEFT JOIN (SELECT DTID, CAST(date + INTERVAL 12 MONTH AS DATE) AS d2, max_by(RI, date) AS RI FROM pn GROUP BY 1, 2) q
 ON p.DTID = q.DTID AND p.date >= q.d2""", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d).select("DTID", "date", "RI")
    lag = p.select("DTID", F.add_months("date", 12).alias("date"), F.col("RI").alias("RI_lag"), F.col("date").alias("src"))
    return A.asof_join(p, lag, "date", "DTID", tie="src").withColumn("ret", F.col("RI") / F.col("RI_lag") - 1)


@query("j10_broadcast_back", ["DTID", "date"], ["rel"], """
 SELECT DTID, date, PRC / avg(PRC) OVER (PARTITION BY region, date) AS rel FROM pn""", ["pn"])
def _(spark, d):
    return X.attach(panel_nation(spark, d), ["region", "date"], m=F.avg("PRC")).withColumn("rel", F.col("PRC") / F.col("m"))


@query("j03_asof_unkeyed_ties", ["o_orderkey"], ["v", "w"], """
 SELECT o_orderkey, v, w FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) o ASOF LEFT JOIN (
  SELECT date, v, w FROM (SELECT date_trunc('week', date)::DATE AS date, round(VOL, 0) AS v, round(PRC, 2) AS w FROM ps) QUALIFY row_number() OVER (PARTITION BY date ORDER BY v DESC, w DESC) = 1) r ON o.date >= r.date""", ["ps"])
def _(spark, d):
    r = panel_supplier(spark, d).select(F.trunc("date", "week").alias("date"), F.round("VOL", 0).alias("v"), F.round("PRC", 2).alias("w"))
    return A.asof_series(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), r, "date", tie=["v", "w"])


# ------------------------------------------------------------------ as-of engine
@query("e01_date_grid", ["f", "T"], ["n"], """
 SELECT f, T, count(*) AS n FROM (SELECT 'M' AS f, CAST(unnest(generate_series(DATE '1995-02-01', DATE '2001-11-15', INTERVAL 1 MONTH)) AS DATE) AS T
 UNION ALL SELECT 'W', CAST(unnest(generate_series(DATE '1995-01-03', DATE '2001-11-15', INTERVAL 7 DAY)) AS DATE)) g
 JOIN ps ON date >= T - 7 AND date < T GROUP BY 1, 2""", ["ps"])
def _(spark, d):
    out = None
    for f, a, fr in (("M", "1995-01-15", "MS"), ("W", "1995-01-03", "7D")):
        g = A.date_grid(spark, a, "2001-11-15", fr).withColumn("date", F.explode(F.sequence(F.date_sub("T", 7), F.date_sub("T", 1))))
        x = panel_supplier(spark, d).join(F.broadcast(g), "date").groupBy("T").agg(F.count(F.lit(1)).alias("n")).withColumn("f", F.lit(f))
        out = x if out is None else out.unionByName(x)
    return out


@query("e02_snapshot_weekly", ["T", "DTID"], ["n", "s", "lo"], """
 SELECT T, DTID, count(*) AS n, sum(RI) AS s, min(datediff('day', DATE '2024-01-01', date)) AS lo FROM ev JOIN g ON date >= T - INTERVAL 1 MONTH AND date < T GROUP BY 1, 2""",
       ["ev", grid_cte("2024-01-08", "2024-02-12", "7 DAY")])
def _(spark, d):
    s = A.snapshot(events_panel(spark, d), Grid("2024-01-08", "2024-02-12", "7D"), -1, 0, ["RI"])
    return s.groupBy("T", "DTID").agg(F.count(F.lit(1)).alias("n"), F.sum("RI").alias("s"), F.min(F.datediff("date", F.lit("2024-01-01"))).alias("lo"))


@query("e02_std_large_mean", ["T", "DTID"], {"sd": 2, "sdp": 2}, """
 SELECT T, DTID, stddev_samp(x) FILTER (WHERE date >= T - INTERVAL 3 MONTH) AS sd, stddev_pop(x) AS sdp FROM (SELECT *, PRC + 1e9 AS x FROM pn) JOIN g ON date >= T - INTERVAL 12 MONTH AND date < T GROUP BY 1, 2""", ["pn", GC])
def _(spark, d):
    p = panel_nation(spark, d).withColumn("x", F.col("PRC") + 1e9)
    return A.win_agg(p, G, {"sd": Agg("std", "x", -3), "sdp": Agg("stdp", "x", -12), "n": Agg("n", "x", -12)}).filter("n > 0")


_WA = {"n3": Agg("n", "r", -3), "s6": Agg("sum", "VOL", -6), "m12": Agg("avg", "PRC", -12), "sd3": Agg("std", "r", -3), "sp1": Agg("stdp", "r", -1),
       "mx": Agg("max", "r", -1), "mn": Agg("min", "r", -2), "la": Agg("last", "PRC", -1), "fi": Agg("first", "PRC", -6), "as7": Agg("asof", "RI", -8, -1, 7)}
_WSQL = """ SELECT T, DTID, count(r) FILTER (WHERE date >= T - INTERVAL 3 MONTH) AS n3, sum(VOL) FILTER (WHERE date >= T - INTERVAL 6 MONTH) AS s6,
  avg(PRC) AS m12, stddev_samp(r) FILTER (WHERE date >= T - INTERVAL 3 MONTH) AS sd3, stddev_pop(r) FILTER (WHERE date >= T - INTERVAL 1 MONTH) AS sp1,
  max(r) FILTER (WHERE date >= T - INTERVAL 1 MONTH) AS mx, min(r) FILTER (WHERE date >= T - INTERVAL 2 MONTH) AS mn, arg_max(PRC, date) FILTER (WHERE date >= T - INTERVAL 1 MONTH) AS la,
  arg_min(PRC, date) FILTER (WHERE date >= T - INTERVAL 6 MONTH) AS fi, arg_max(RI, date) FILTER (WHERE date >= T - INTERVAL 8 MONTH AND date <= T - INTERVAL 7 MONTH) AS as7
 FROM ps JOIN g ON date >= T - INTERVAL 12 MONTH AND date < T GROUP BY 1, 2"""


@query("e02_snapshot_month_frames", ["T", "DTID"], list(_WA), _WSQL, ["ps", GC], digits=5)
def _(spark, d):
    p = panel_supplier(spark, d)
    return A.win_agg(p, G, {**_WA, "alive": Agg("n", "PRC", -12)}, path="month").filter("alive > 0")


@query("e02_snapshot_fanout", ["T", "DTID"], list(_WA), _WSQL, ["ps", GC], digits=5)
def _(spark, d):
    return A.win_agg(panel_supplier(spark, d), G, _WA, path="fanout")


@query("e05_analyst_ids", ["DTID", "date", "FPI"], ["MEANEST"], """
 SELECT CASE WHEN l."end" IS NULL OR a.date <= l."end" THEN l.PERMNO END AS DTID, a.date, FPI, MEANEST FROM asum a ASOF JOIN link l ON a.TICKER = l.TICKER AND a.date >= l.start
 WHERE l."end" IS NULL OR a.date <= l."end" """, ["asum", "link"])
def _(spark, d):
    from panelquant.signals.analyst import resolve_ids

    a = A.interval_join(analyst_sum(spark, d).drop("DTID"), link_intervals(spark, d), "date", "TICKER", "start", "end").withColumn("DTID", F.col("TICKER"))
    return resolve_ids(a, "PERMNO")


@query("e06_base_index", ["T", "DTID", "FTID"], [], """
 SELECT a.T, a.DTID, f.FTID FROM (SELECT DISTINCT T, DTID FROM ps JOIN g ON date >= T - INTERVAL 1 MONTH AND date < T) a LEFT JOIN
 (SELECT T, DTID, arg_max(FTID, date) AS FTID FROM (SELECT DTID, FTID, date FROM ft WHERE sale > 500000) f JOIN g ON date >= T - INTERVAL 18 MONTH AND date < T GROUP BY 1, 2) f ON a.T = f.T AND a.DTID = f.DTID""", ["ft", GC])
def _(spark, d):
    ft = statements(spark, d, ["sale"], with_mc=False).filter("sale > 500000")
    return A.base_index(panel_supplier(spark, d), ft, G)


@query("e08_two_point_lag", ["T", "DTID"], ["now", "past"], """
 SELECT T, DTID, arg_max(RI, date) AS now, arg_max(RI, date) FILTER (WHERE date <= T - INTERVAL 6 MONTH) AS past FROM ps JOIN g ON date >= T - INTERVAL 7 MONTH AND date < T GROUP BY 1, 2""", ["ps", GC])
def _(spark, d):
    return A.two_point(panel_supplier(spark, d), G, "RI", -7, 0, 6).filter("now is not null")


@query("e09_asof_grid", ["T", "DTID", "j", "src"], ["RI", "VOL"], """
 SELECT g.T, i.DTID, g.j, p.date AS src, RI, VOL FROM gj g CROSS JOIN (SELECT DISTINCT DTID FROM ps) i ASOF JOIN ps p ON p.DTID = i.DTID AND g.cut >= p.date WHERE p.date >= g.T - INTERVAL 13 MONTH""",
       ["ps", GC, "gj AS (SELECT T, j, CASE WHEN j = 0 THEN T - 1 ELSE CAST(T - to_months(CAST(j AS INTEGER)) AS DATE) END AS cut FROM g, (SELECT unnest(generate_series(0, 12)) AS j))"])
def _(spark, d):
    return A.asof_grid(panel_supplier(spark, d), G, 13, ["RI", "VOL"], -13)


@query("e10_recent_observation", ["T", "DTID"], ["n"], """
 SELECT T, DTID, n FROM (SELECT T, DTID, count(*) AS n, max(date) AS mx FROM ps JOIN g ON date >= T - INTERVAL 12 MONTH AND date < T GROUP BY 1, 2) WHERE mx > T - 7""", ["ps", GC])
def _(spark, d):
    s = A.snapshot(panel_supplier(spark, d), G, -12, 0, [])
    return s.groupBy("T", "DTID").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("mx")).filter("mx > date_sub(T, 7)")


# ------------------------------------------------------------------ cross-sections
PM = """pm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, DTID, region, sum(VOL) AS v, avg(PRC) AS p, CASE WHEN count(r) > 3 THEN sum(r) END AS m, max(MC) AS MC FROM ps GROUP BY 1, 2, 3)"""


def monthly(spark, d, p=None):
    p = panel_supplier(spark, d) if p is None else p
    return p.groupBy(month_start(month_no("date")).alias("date"), "DTID", "region").agg(
        F.sum("VOL").alias("v"), dated_mean("PRC", "date").alias("p"), F.when(F.count("r") > 3, F.sum("r")).alias("m"), F.max("MC").alias("MC"))


def _rk(c):
    w = f"PARTITION BY date, region, {c} IS NULL"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE rank() OVER ({w} ORDER BY {c}) + (count(*) OVER (PARTITION BY date, region, {c}) - 1) / 2.0 END"


@query("c01_percentile_rank", ["date", "DTID"], ["v", "p", "m"], f"""
 SELECT date, DTID, {', '.join(f"coalesce(({_rk(c)}) / count({c}) OVER (PARTITION BY date, region), 0.5) AS {c}" for c in 'vpm')} FROM pm""", ["ps", PM])
def _(spark, d):
    return X.rank_pct(monthly(spark, d), ["v", "p", "m"])


_Z = lambda c: f"coalesce(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0), 0)"


@query("c02_standardise", ["date", "DTID"], ["v", "m"], f"SELECT date, DTID, {_Z('v')} AS v, {_Z('m')} AS m FROM pm WINDOW w AS (PARTITION BY date, region)", ["ps", PM])
def _(spark, d):
    return X.standardize(monthly(spark, d), ["v", "m"])


@query("c03_winsorise_standardise", ["date", "DTID"], ["m"], """
 SELECT date, DTID, coalesce((m - avg(m) OVER w) / nullif(stddev_samp(m) OVER w, 0), 0) AS m FROM (
  SELECT date, DTID, region, CASE WHEN m < quantile_cont(m, 0.025) OVER w THEN quantile_cont(m, 0.025) OVER w ELSE m END AS m FROM (
   SELECT date, DTID, region, CASE WHEN m > quantile_cont(m, 0.975) OVER w THEN quantile_cont(m, 0.975) OVER w ELSE m END AS m FROM pm WINDOW w AS (PARTITION BY date, region))
  WINDOW w AS (PARTITION BY date, region)) WINDOW w AS (PARTITION BY date, region)""", ["ps", PM])
def _(spark, d):
    return X.winsor_standardize(monthly(spark, d), ["m"])


@query("c04_winsorise", ["date", "DTID"], ["p"], """
 SELECT date, DTID, least(greatest(p, quantile_cont(p, 0.1) OVER w), quantile_cont(p, 0.9) OVER w) AS p FROM pm WINDOW w AS (PARTITION BY date)""", ["ps", PM])
def _(spark, d):
    return X.winsorize(monthly(spark, d), ["p"], ["date"], 0.1)


@query("c05_double_quantile_indicator", ["date", "DTID"], ["ind"], """
 SELECT date, DTID, CASE WHEN v < quantile_cont(v, 0.2) OVER w AND p > quantile_cont(p, 0.8) OVER w THEN 1.0 ELSE 0.0 END - CASE WHEN v > quantile_cont(v, 0.8) OVER w AND p < quantile_cont(p, 0.2) OVER w THEN 1.0 ELSE 0.0 END AS ind
 FROM pm WINDOW w AS (PARTITION BY date)""", ["ps", PM])
def _(spark, d):
    from panelquant.signals.base import double_quantile

    return double_quantile(monthly(spark, d), "v", "p", "ind", ["date"])


@query("c06_fill_and_ratio_to_mean", ["date", "DTID"], ["m", "ratio"], """
 SELECT date, DTID, coalesce(m, avg(m) OVER w) AS m, coalesce(m, avg(m) OVER w) / nullif(avg(coalesce(m, mm)) OVER w, 0) AS ratio FROM (SELECT *, avg(m) OVER (PARTITION BY date, region) AS mm FROM pm) WINDOW w AS (PARTITION BY date, region)""", ["ps", PM], digits=4)
def _(spark, d):
    f = X.fill_group_mean(monthly(spark, d), ["m"])
    return X.attach(f, ["date", "region"], mm=F.avg("m")).withColumn("ratio", F.col("m") / F.nullif("mm", F.lit(0.0)))


@query("c07_median_centre_abs_scale", ["date", "DTID"], ["m", "r_scale"], """
 SELECT date, DTID, c / (avg(abs(c)) OVER w / 1.4) AS m, avg(abs(c)) OVER w / 1.4 AS r_scale FROM (SELECT date, DTID, region, m - quantile_cont(m, 0.5) OVER (PARTITION BY date, region) AS c FROM pm) WINDOW w AS (PARTITION BY date, region)""", ["ps", PM])
def _(spark, d):
    return X.median_scale(monthly(spark, d), "m")


@query("c08_cumulative_share", ["date", "DTID"], ["share"], """
 SELECT date, DTID, sum(MC) OVER (PARTITION BY date ORDER BY MC, DTID) / sum(MC) OVER (PARTITION BY date) AS share FROM pm""", ["ps", PM])
def _(spark, d):
    return X.cumulative_share(monthly(spark, d), "MC", ["date"], "DTID", "share")


@query("c08_ties_shared_prefix", ["g", "id"], {"share": 9}, """
 SELECT g, id, sum(v) OVER (PARTITION BY g ORDER BY v, id) / sum(v) OVER (PARTITION BY g) AS share FROM (
  SELECT c_nationkey % 3 AS g, 'US00' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, greatest(floor(c_acctbal / 2000), 0) AS v FROM customer)""")
def _(spark, d):
    p = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("g"), F.concat(F.lit("US00"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"),
                                           F.greatest(F.floor(F.col("c_acctbal") / 2000), F.lit(0)).cast("double").alias("v"))
    return X.cumulative_share(p, "v", ["g"], "id", "share")


@query("c09_market_factor", ["date"], ["rm"], "SELECT date, sum(r * MC) / sum(MC) AS rm FROM ps WHERE r IS NOT NULL AND MC IS NOT NULL GROUP BY 1", ["ps"])
def _(spark, d):
    return X.mkt_factor(panel_supplier(spark, d), "date")


# ------------------------------------------------------------------ windows
def wn():
    return W.partitionBy("DTID").orderBy("date")


@query("w01_lag_lead", ["DTID", "date"], ["l1", "l5", "f2"], "SELECT DTID, date, lag(RI) OVER w AS l1, lag(RI, 5) OVER w AS l5, lead(RI, 2) OVER w AS f2 FROM pn WINDOW w AS (PARTITION BY DTID ORDER BY date)", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).select("DTID", "date", F.lag("RI").over(wn()).alias("l1"), F.lag("RI", 5).over(wn()).alias("l5"), F.lead("RI", 2).over(wn()).alias("f2"))


@query("w02_running_max_min", ["DTID", "date"], ["hi", "lo"], "SELECT DTID, date, max(RI) OVER w AS hi, min(RI) OVER w AS lo FROM pn WINDOW w AS (PARTITION BY DTID ORDER BY date)", ["pn"])
def _(spark, d):
    w = wn().rowsBetween(W.unboundedPreceding, 0)
    return panel_nation(spark, d).select("DTID", "date", F.max("RI").over(w).alias("hi"), F.min("RI").over(w).alias("lo"))


@query("w03_reverse_running_min", ["DTID", "date"], ["lo"], "SELECT DTID, date, min(RI) OVER (PARTITION BY DTID ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo FROM pn", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).select("DTID", "date", F.min("RI").over(wn().rowsBetween(0, W.unboundedFollowing)).alias("lo"))


@query("w04_order_number", ["DTID", "date"], ["no"], "SELECT DTID, date, row_number() OVER (PARTITION BY DTID ORDER BY date) AS no FROM pn", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).select("DTID", "date", F.row_number().over(wn()).alias("no"))


@query("w05_average_tie_rank", ["date", "DTID"], ["rk"], "SELECT date, DTID, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rk FROM pm", ["ps", PM])
def _(spark, d):
    return X.rank_avg(monthly(spark, d), "v", ["date"], "rk")


@query("w06_running_product", ["DTID", "date"], ["cum"], "SELECT DTID, date, product(1 + coalesce(r, 0)) OVER (PARTITION BY DTID ORDER BY date) AS cum FROM pn", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).select("DTID", "date", S.running_product(1 + nz("r"), wn().rowsBetween(W.unboundedPreceding, 0)).alias("cum"))


_EW = "SELECT DTID, sum(CASE WHEN i = n - 1 THEN power({b}, i) ELSE {a} * power({b}, i) END * x) AS y FROM (SELECT DTID, r * r AS x, row_number() OVER (PARTITION BY DTID ORDER BY date DESC) - 1 AS i, count(*) OVER (PARTITION BY DTID) AS n FROM pn WHERE r IS NOT NULL) GROUP BY 1"


@query("w07_ewma_last", ["DTID"], ["y"], _EW.format(a=0.06, b=0.94), ["pn"], digits=8)
def _(spark, d):
    return S.ewma_last(panel_nation(spark, d).withColumn("x", F.col("r") * F.col("r")), "DTID", "date", "x", 0.06, "y")


@query("w07_ewma_path", ["DTID", "date"], ["y"], """
 SELECT a.DTID, a.date, sum(CASE WHEN b.i = 1 THEN power(0.9, a.i - 1) ELSE 0.1 * power(0.9, a.i - b.i) END * b.x) AS y FROM x a JOIN x b ON a.DTID = b.DTID AND b.i <= a.i GROUP BY 1, 2""",
       ["pn", "x AS (SELECT DTID, date, r * r AS x, row_number() OVER (PARTITION BY DTID ORDER BY date) AS i FROM pn WHERE r IS NOT NULL)"])
def _(spark, d):
    return S.ewma_path(panel_nation(spark, d).withColumn("x", F.col("r") * F.col("r")), "DTID", "date", "x", {"y": 0.1})


@query("w08_group_transform", ["date", "DTID"], ["dev"], "SELECT date, DTID, v - avg(v) OVER (PARTITION BY date, region) AS dev FROM pm", ["ps", PM])
def _(spark, d):
    return X.attach(monthly(spark, d), ["date", "region"], mv=F.avg("v")).withColumn("dev", F.col("v") - F.col("mv"))


@query("w09_last_k_rows", ["DTID"], ["sd"], "SELECT DTID, stddev_samp(RI) AS sd FROM (SELECT DTID, RI, row_number() OVER (PARTITION BY DTID ORDER BY date DESC) AS k FROM pn) WHERE k <= 10 GROUP BY 1", ["pn"])
def _(spark, d):
    w = W.partitionBy("DTID").orderBy(F.col("date").desc())
    return panel_nation(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 10").groupBy("DTID").agg(F.stddev_samp("RI").alias("sd"))


@query("w10_rolling_calendar_window", ["T", "DTID"], ["vol", "n"], "SELECT T, DTID, stddev_samp(r) AS vol, count(r) AS n FROM pn JOIN g ON date >= T - INTERVAL 6 MONTH AND date < T GROUP BY 1, 2", ["pn", GC])
def _(spark, d):
    return A.win_agg(panel_nation(spark, d), G, {"vol": Agg("std", "r", -6), "n": Agg("n", "r", -6)}).filter("n > 0")


# ------------------------------------------------------------------ aggregations
@query("g01_basic_aggregates", ["DTID"], ["s", "m", "sd", "va", "mn", "mx", "n", "md"], """
 SELECT DTID, sum(r) AS s, avg(r) AS m, stddev_samp(r) AS sd, var_samp(r) AS va, min(r) AS mn, max(r) AS mx, count(r) AS n, median(r) AS md FROM ps GROUP BY 1""", ["ps"])
def _(spark, d):
    p = panel_supplier(spark, d)
    g = p.groupBy("DTID").agg(F.sum("r").alias("s"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.var_samp("r").alias("va"),
                              F.min("r").alias("mn"), F.max("r").alias("mx"), F.count("r").alias("n"))
    return g.join(X.group_quantiles(p, ["DTID"], {"md": ("r", 0.5)}), "DTID")


@query("g02_first_last_non_null", ["DTID"], ["f", "l"], "SELECT DTID, arg_min(r, date) AS f, arg_max(r, date) AS l FROM ps WHERE r IS NOT NULL GROUP BY 1", ["ps"])
def _(spark, d):
    p = panel_supplier(spark, d).filter("r is not null or VOL > 0")
    return (A.first_nn(p, "DTID", "date", ["r"]).withColumnRenamed("r", "f")
            .join(A.last_nn(p, "DTID", "date", ["r"]).withColumnRenamed("r", "l"), "DTID"))


@query("g03_minimum_observation_gate", ["DTID", "m"], ["sd"], "SELECT DTID, date_trunc('month', date)::DATE AS m, CASE WHEN count(r) >= 15 THEN stddev_samp(r) END AS sd FROM pn GROUP BY 1, 2", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).groupBy("DTID", month_start(month_no("date")).alias("m")).agg(F.when(F.count("r") >= 15, F.stddev_samp("r")).alias("sd"))


@query("g04_weighted_mean", ["region", "date"], ["wm"], "SELECT region, date, sum(r * MC) / sum(MC) AS wm FROM ps WHERE r IS NOT NULL GROUP BY 1, 2", ["ps"])
def _(spark, d):
    return panel_supplier(spark, d).filter("r is not null").groupBy("region", "date").agg((F.sum(F.col("r") * F.col("MC")) / F.sum("MC")).alias("wm"))


@query("g05_exact_quantile", ["region", "date"], ["q1", "q5", "q9"], "SELECT region, date, quantile_cont(PRC, 0.1) AS q1, quantile_cont(PRC, 0.5) AS q5, quantile_cont(PRC, 0.9) AS q9 FROM ps GROUP BY 1, 2", ["ps"])
def _(spark, d):
    return X.group_quantiles(panel_supplier(spark, d), ["region", "date"], {"q1": ("PRC", 0.1), "q5": ("PRC", 0.5), "q9": ("PRC", 0.9)})


@query("g06_two_level_aggregate", ["region"], ["avg_n", "max_n"], "SELECT region, avg(n) AS avg_n, max(n) AS max_n FROM (SELECT region, date, count(*) AS n FROM ps GROUP BY 1, 2) GROUP BY 1", ["ps"])
def _(spark, d):
    return panel_supplier(spark, d).groupBy("region", "date").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.avg("n").alias("avg_n"), F.max("n").alias("max_n"))


@query("g07_single_factor_ols", ["DTID"], ["slope", "icpt", "r2", "sd_resid"], """
 SELECT DTID, regr_slope(r, rm) AS slope, regr_intercept(r, rm) AS icpt, regr_r2(r, rm) AS r2, sqrt(var_pop(r) - regr_slope(r, rm) * covar_pop(r, rm)) AS sd_resid
 FROM pn JOIN (SELECT date, sum(r * MC) / sum(MC) AS rm FROM pn WHERE r IS NOT NULL GROUP BY 1) USING (date) WHERE r IS NOT NULL GROUP BY 1""", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d).filter("r is not null")
    c = S.group_ols(p.join(X.mkt_factor(p, "date"), "date"), "DTID", "r", ["rm"])
    return c.select("DTID", F.col("b1").alias("slope"), F.col("b0").alias("icpt"), "r2", F.sqrt(F.col("ssr") / F.col("n")).alias("sd_resid"))


@query("g08_multi_factor_ols", ["DTID"], ["b0", "b1", "b2"], """
 SELECT DTID, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (
  SELECT DTID, avg(r) AS my, avg(VOL) AS m1, avg(PRC) AS m2, covar_pop(VOL, r) AS c1y, covar_pop(PRC, r) AS c2y, covar_pop(VOL, PRC) AS c12, var_pop(VOL) AS v1, var_pop(PRC) AS v2
  FROM pn WHERE r IS NOT NULL GROUP BY 1))""", ["pn"], digits=7)
def _(spark, d):
    return S.group_ols(panel_nation(spark, d), "DTID", "r", ["VOL", "PRC"])


@query("g09_correlation", ["DTID"], ["c", "cv"], "SELECT DTID, corr(VOL, PRC) AS c, covar_samp(VOL, PRC) AS cv FROM ps GROUP BY 1", ["ps"])
def _(spark, d):
    return panel_supplier(spark, d).groupBy("DTID").agg(S.safe_corr("VOL", "PRC").alias("c"), F.covar_samp("VOL", "PRC").alias("cv"))


@query("g10_spearman_matrix", ["a", "b"], ["rho"], """
 SELECT a, b, avg(rho) AS rho FROM (SELECT date, x.k AS a, y.k AS b, corr(x.rk, y.rk) AS rho FROM rk x JOIN rk y USING (date, DTID) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
       ["ps", PM, """rk AS (SELECT date, DTID, k, rank() OVER (PARTITION BY date, k ORDER BY x) + (count(*) OVER (PARTITION BY date, k, x) - 1) / 2.0 AS rk
  FROM (SELECT date, DTID, unnest(['v', 'p', 'MC']) AS k, unnest([v, p, MC]) AS x FROM pm))"""])
def _(spark, d):
    from panelquant.operators.evaluate import rank_correlations

    return rank_correlations(monthly(spark, d), ["v", "p", "MC"], ["date"], ["date", "DTID"])


@query("g11_compounded_return", ["DTID", "y"], ["ret"], "SELECT DTID, year(date) AS y, product(1 + r) - 1 AS ret FROM pn WHERE r IS NOT NULL GROUP BY 1, 2", ["pn"])
def _(spark, d):
    return panel_nation(spark, d).filter("r is not null").groupBy("DTID", F.year("date").alias("y")).agg((S.product_agg(1 + F.col("r")) - 1).alias("ret"))


@query("g12_concentration", ["region", "FinYearEnd"], ["h"], "SELECT region, FinYearEnd, sum(power(sale / t, 2)) AS h FROM (SELECT *, sum(sale) OVER (PARTITION BY region, FinYearEnd) AS t FROM ft) GROUP BY 1, 2", ["ft"])
def _(spark, d):
    f = statements(spark, d, ["sale"], with_mc=False)
    return f.groupBy("region", "FinYearEnd").agg(fdiv(F.sum(F.col("sale") * F.col("sale")), F.pow(F.sum("sale"), F.lit(2))).alias("h"))


# ------------------------------------------------------------------ scalar functions
@query("x01_math", ["DTID", "date"], ["a", "l", "s", "p", "e", "c", "k"], """
 SELECT DTID, date, abs(r) AS a, CASE WHEN 1 + r > 0 THEN ln(1 + r) END AS l, sqrt(VOL) AS s, power(VOL, 1.0 / 3) AS p, exp(least(r, 5)) AS e, ceil(PRC / 30) AS c, least(greatest(r, -0.5), 0.5) AS k FROM pn WHERE r IS NOT NULL""", ["pn"])
def _(spark, d):
    r = F.col("r")
    return panel_nation(spark, d).filter("r is not null").select("DTID", "date", F.abs("r").alias("a"), fln(1 + r).alias("l"), F.sqrt("VOL").alias("s"), fpow("VOL", 1 / 3).alias("p"),
                                        F.exp(F.least("r", F.lit(5.0))).alias("e"), F.ceil(F.col("PRC") / 30).alias("c"), F.least(F.greatest(r, F.lit(-0.5)), F.lit(0.5)).alias("k"))


@query("x02_null_handling", ["FTID", "FinYearEnd"], ["be", "ratio", "keep"], """
 SELECT FTID, FinYearEnd, coalesce(seq - coalesce(pstkrv, pstkl, pstk, 0), ceq + pstk - coalesce(pstkrv, pstkl, pstk), at - lt - coalesce(pstkrv, pstkl, pstk, 0)) AS be,
 xrd / sale AS ratio, CASE WHEN xrd <= 0 THEN NULL ELSE xrd END AS keep FROM ft""", ["ft"], digits=4)
def _(spark, d):
    from panelquant.functions.num import book_equity

    return statements(spark, d, with_mc=False).select("FTID", "FinYearEnd", book_equity().alias("be"), fdiv("xrd", "sale").alias("ratio"), null_if("xrd", F.col("xrd") <= 0).alias("keep"))


@query("x03_dates", ["DTID", "date", "p15", "ms"], ["dd", "age", "yb", "mb"], """
 SELECT DTID, date, CAST(date + INTERVAL 15 MONTH AS DATE) AS p15, CAST(date_trunc('month', date) AS DATE) AS ms, datediff('day', date, DATE '2002-01-01') AS dd, datediff('day', date, DATE '2002-01-01') / 365.0 AS age,
  -ceil(datediff('day', date, DATE '2002-01-01') / 365.0) AS yb, -ceil(datediff('day', date, DATE '2002-01-01') / 30.0) AS mb FROM pn""", ["pn"])
def _(spark, d):
    dd = F.datediff(F.lit("2002-01-01").cast("date"), "date")
    return panel_nation(spark, d).select("DTID", "date", F.add_months("date", 15).alias("p15"), month_start(month_no("date")).alias("ms"), dd.alias("dd"), (dd / 365).alias("age"),
                                         (-F.ceil(dd / 365)).alias("yb"), (-F.ceil(dd / 30)).alias("mb"))


@query("x04_strings", ["p_partkey", "up", "first", "tail", "cat"], ["has"], """
 SELECT p_partkey, upper(p_name) AS up, split_part(p_name, ' ', 1) AS first, substr(p_brand, 7) AS tail, p_brand || '/' || p_type AS cat, CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END AS has FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.split("p_name", " ")[0].alias("first"), F.substr("p_brand", F.lit(7)).alias("tail"),
                                          F.concat("p_brand", F.lit("/"), "p_type").alias("cat"), F.col("p_name").contains("ring").cast("int").alias("has"))
