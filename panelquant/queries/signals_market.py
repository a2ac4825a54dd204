"""Market and volatility signal classes, one query per class."""
from panelquant.operators.asof import Grid
from panelquant.queries.base import CLASS_SQL, grid_cte, query
from panelquant.signals import CLASSES, SignalContext
from panelquant.sources.adapters import panel_nation, panel_supplier, statements

G = Grid("1995-02-01", "2001-12-01")
GC = grid_cte("1995-02-01", "2001-12-01")
# windows longer than this panel's seven years are filled as far as the data goes


def ctx(spark, d, panel="pn", ft=False, **kw):
    src = {"dt": panel_nation(spark, d) if panel == "pn" else panel_supplier(spark, d)}
    if ft:
        src["FT"] = statements(spark, d)
    return SignalContext(src, G, **kw)


def signal(name, cls, sql, ctes=(), panel="pn", ft=False, digits=6, key="DTID", where=None, **kw):
    outs = CLASSES[cls].outputs
    CLASS_SQL[cls] = (sql, ctes, key, outs, digits, kw.get("min_obs", {}))

    def run(spark, d):
        df = ctx(spark, d, panel, ft, **kw).cls(cls)
        return df.filter(where) if where else df

    query(name, ["T", key], {o: digits for o in outs}, sql, [panel, *(["ft"] if ft else []), GC, *ctes], digits)(run)


def win(start, end=0, sel="", where="", panel="pn"):
    w = f" WHERE {where}" if where else ""
    return (f"SELECT T, DTID, {sel} FROM (SELECT *, VOL * PRC AS pv FROM {panel}) p JOIN g ON date >= T + INTERVAL ({start}) MONTH AND date < T + INTERVAL ({end}) MONTH{w} GROUP BY 1, 2")


def lastv(x, cond=""):
    return f"arg_max({x}, date) FILTER (WHERE {x} IS NOT NULL{' AND ' + cond if cond else ''})"


def back(x, k):
    return lastv(x, f"date <= T - INTERVAL {k} MONTH")


signal("mk01_share_issuance_5y", "ShareIssuance5Y", win(-61, 0, f'ln({lastv("MC")} / {back("MC", 60)}) - ln({lastv("RI")} / {back("RI", 60)}) AS "CEI5Y"'))
signal("mk02_share_issuance_1y", "ShareIssuance1Y", win(-13, 0, f'ln({lastv("SHROUT / AF")} / {back("SHROUT / AF", 12)}) AS "SI1Y"'))
signal("mk04_bid_ask_spread", "BidAskSpread", win(-1, 0, 'CASE WHEN count(r) >= 10 THEN 8 * power(stddev_samp(r), 2.0/3) / power(sum(pv) FILTER (WHERE r IS NOT NULL), 1.0/3) END AS "BidAsk"'))
signal("mk05_amihud", "Amihud", win(-12, 0, 'CASE WHEN count(abs(r) / pv) >= 50 THEN avg(abs(r) / pv) END AS "Amihud"'), digits=12)
signal("mk06_liquidity_shocks", "LiquidityShocks", """SELECT T, DTID, avg(a) FILTER (WHERE b = 1) - avg(a) FILTER (WHERE b <> 1) AS "LiqShck" FROM (
 SELECT T, DTID, ceil(datediff('day', date, T) / 30.0) AS b, avg(abs(r) / (VOL * PRC)) AS a FROM pn JOIN g ON date >= T - INTERVAL 13 MONTH AND date < T WHERE r IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10)
 GROUP BY 1, 2 HAVING count(a) FILTER (WHERE b = 1) > 0 AND count(a) FILTER (WHERE b <> 1) > 0""", digits=12)
signal("mk07_size", "Size", win(-1, 0, f'{lastv("MC")} AS "Size"'), digits=3)
signal("mk08_volatility", "Volatility", win(-1, 0, 'CASE WHEN count(r) >= 15 THEN stddev_samp(r) END AS "TV"'))
signal("mk09_share_turnover", "ShareTurnover", win(-3, 0, f'CASE WHEN count(VOL) >= 40 THEN sum(VOL) / {lastv("SHROUT")} / 1e6 END AS "ST"'), digits=12)
signal("mk10_share_turnover_var", "ShareTurnoverVar", win(-6, 0, 'CASE WHEN count(VOL) >= 50 THEN stddev_samp(VOL / SHROUT) / avg(VOL / SHROUT) END AS "CVoST"'))
signal("mk11_volume_to_market_cap", "VolumeToMarketCap", win(-12, 0, f'CASE WHEN count(pv) >= 100 THEN sum(pv) / {lastv("MC")} / 1e6 END AS "VolMV"'), digits=12)
signal("mk12_volume_variance", "VolumeVariance", win(-36, 0, 'CASE WHEN count(pv) >= 250 THEN stddev_samp(pv) END AS "VarVol"'), digits=3)
signal("mk13_max_return", "MaxReturn", win(-1, 0, 'CASE WHEN count(r) >= 15 THEN max(r) END AS "Max"'))
signal("mk14_price", "Price", win(-1, 0, f'{lastv("PRC")} AS "PRC"'))
AGE = """(SELECT a.T, a.DTID, datediff('day', least(a.d, coalesce(f.d, a.d)), a.T) / 365.0 AS "Age" FROM (SELECT T, DTID, min(date) AS d FROM pn JOIN g ON date >= T - INTERVAL 240 MONTH AND date < T GROUP BY 1, 2) a
 LEFT JOIN (SELECT T, DTID, min(date) AS d FROM ft JOIN g ON date >= T - INTERVAL 240 MONTH AND date < T GROUP BY 1, 2) f ON a.T = f.T AND a.DTID = f.DTID)"""
MOM = win(-8, -1, f'{lastv("RI")} / {back("RI", 7)} - 1 AS "Mom"')
LTR = win(-61, -12, f'{lastv("RI")} / {back("RI", 60)} - 1 AS "LTR"')
signal("mk15_age", "Age", f"""SELECT a.T, a.DTID, "Age", "MomAge" FROM {AGE} a LEFT JOIN (SELECT T, DTID, "Mom" AS "MomAge" FROM (SELECT m.*, a."Age", quantile_cont("Age", 0.2) OVER (PARTITION BY m.T) AS q FROM ({MOM}) m
 JOIN {AGE} a ON a.T = m.T AND a.DTID = m.DTID WHERE "Age" >= 1) WHERE "Age" < q) m ON a.T = m.T AND a.DTID = m.DTID""", panel="pn", ft=True, min_obs={"Age.years": 1})
signal("mk16_year_high", "YearHigh", win(-12, 0, f'{lastv("RI")} / max(RI) AS "52WH"'))
for _n, _c, _o, _s, _e, _l in [("mk17_short_term_reversal", "ShortTermReversal", "STR", -2, 0, 1), ("mk18_momentum", "Momentum", "Mom", -8, -1, 7), ("mk19_lagged_momentum", "LaggedMomentum", "MomLag", -13, -6, 12),
                               ("mk20_long_term_reversal", "LongTermReversal", "LTR", -61, -12, 60), ("mk21_momentum_reversal", "MomentumReversal", "MomRev", -19, -12, 18)]:
    signal(_n, _c, win(_s, _e, f'{lastv("RI")} / {back("RI", _l)} - 1 AS "{_o}"'))
signal("mk22_momentum_lt_reversal", "MomentumLTReversal", f"""SELECT T, DTID, CASE WHEN "LTR" < l2 AND "Mom" > m8 THEN 1 ELSE 0 END - CASE WHEN "LTR" > l8 AND "Mom" < m2 THEN 1 ELSE 0 END AS "MomLTRev" FROM (
 SELECT coalesce(a.T, b.T) AS T, coalesce(a.DTID, b.DTID) AS DTID, "LTR", "Mom", quantile_cont("LTR", 0.2) OVER w AS l2, quantile_cont("LTR", 0.8) OVER w AS l8, quantile_cont("Mom", 0.2) OVER w AS m2, quantile_cont("Mom", 0.8) OVER w AS m8
 FROM ({MOM}) a FULL JOIN ({LTR}) b ON a.T = b.T AND a.DTID = b.DTID WINDOW w AS (PARTITION BY coalesce(a.T, b.T)))""")
signal("mk23_momentum_volume", "MomentumVolume", f"""SELECT T, DTID, "Mom" AS "MomVol" FROM (SELECT m.*, v, quantile_cont(v, 0.8) OVER (PARTITION BY m.T) AS q FROM ({MOM}) m JOIN ({win(-6, 0, 'coalesce(sum(pv), 0) AS v')}) v ON m.T = v.T AND m.DTID = v.DTID) WHERE v >= q""")
PS_RET = win(-7, 0, f'{lastv("RI")} / {back("RI", 6)} - 1 AS r, {lastv("MC")} AS MC', panel="ps")
signal("mk24_industry_momentum", "IndustryMomentum", f"""SELECT T, DTID, sum(r * MC) OVER w / sum(MC) OVER w AS "IndMom" FROM (SELECT p.*, INDM3 FROM ({PS_RET}) p JOIN (SELECT T, DTID, arg_max(INDM3, date) AS INDM3 FROM ft JOIN g ON date >= T - INTERVAL 18 MONTH AND date < T GROUP BY 1, 2) f
 ON p.T = f.T AND p.DTID = f.DTID WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY T, INDM3)""", panel="ps", ft=True)


def points(n, start, cols, panel="pn", src="", j0=0):
    """(T, DTID, j, r, cols): month points as of T-j months and the return since the previous point."""
    sel = ", ".join(cols)
    return f"""(SELECT *, CASE WHEN lag(j) OVER w = j + 1 THEN RI / lag(RI) OVER w - 1 END AS r FROM (SELECT q.T, i.DTID, q.j, p.date AS src, {sel} FROM
 (SELECT T, j, CASE WHEN j = 0 THEN T - 1 ELSE CAST(T - to_months(CAST(j AS INTEGER)) AS DATE) END AS cut FROM g, (SELECT unnest(generate_series({j0}, {n - 1})) AS j)) q
 CROSS JOIN (SELECT DISTINCT DTID FROM {panel}) i ASOF JOIN {src or panel} p ON p.DTID = i.DTID AND q.cut >= p.date WHERE p.date >= q.T + INTERVAL ({start}) MONTH) WINDOW w AS (PARTITION BY T, DTID ORDER BY j DESC))"""


from panelquant.signals.market import SEASON  # noqa: E402

signal("mk25_seasonality", "Seasonality", "SELECT T, DTID, " + ", ".join(f'avg(r) FILTER (WHERE j + 1 IN ({", ".join(map(str, sorted(s)))})) AS "{k}"' for k, s in SEASON.items()) +
       f""" FROM {points(241, -241, ['RI'])} JOIN (SELECT DISTINCT T, DTID FROM pn JOIN g ON date > T - INTERVAL 1 MONTH AND date < T) USING (T, DTID) GROUP BY 1, 2""")
MKT = lambda n, s: f"m AS (SELECT *, sum(r * MC) OVER (PARTITION BY T, j) / sum(MC) OVER (PARTITION BY T, j) AS rm FROM {points(n, s, ['RI', 'MC'])} WHERE r IS NOT NULL AND MC IS NOT NULL)"
signal("mk26_residual_momentum", "ResidualMomentum", """SELECT T, DTID, product(1 + e) / stddev_pop(e) AS "ResidMom" FROM (SELECT T, DTID, r - my - b * (rm - mx) AS e, row_number() OVER (PARTITION BY T, DTID ORDER BY j DESC) - 1 AS i FROM m
 JOIN (SELECT T, DTID, regr_slope(r, rm) AS b, avg(r) AS my, avg(rm) AS mx FROM m GROUP BY 1, 2 HAVING count(*) >= 36) USING (T, DTID)) WHERE i >= 24 AND i < 35 GROUP BY 1, 2""", [MKT(37, -37)], digits=0)
DAY = lambda k: f"m AS (SELECT *, sum(r * MC) OVER (PARTITION BY T, date) / sum(MC) OVER (PARTITION BY T, date) AS rm FROM pn JOIN g ON date >= T - INTERVAL {k} MONTH AND date < T WHERE r IS NOT NULL AND MC IS NOT NULL)"
signal("mk27_idiosyncratic_risk", "IdiosyncraticRisk", """SELECT T, DTID, sqrt(greatest(var_pop(r) - covar_pop(r, rm) * covar_pop(r, rm) / var_pop(rm), 0)) AS "IdioRisk" FROM m GROUP BY 1, 2 HAVING count(*) >= 15""", [DAY(1)])
SQL_BETA = """SELECT T, DTID, avg(e * d * d) / (sqrt(avg(e * e)) * avg(d * d)) AS "Coskew", any_value(b) AS "Beta" FROM (SELECT T, DTID, b, rm - mx AS d, r - my - b * (rm - mx) AS e FROM m
 JOIN (SELECT T, DTID, regr_slope(r, rm) AS b, avg(r) AS my, avg(rm) AS mx FROM m GROUP BY 1, 2 HAVING count(*) >= 36) USING (T, DTID)) GROUP BY 1, 2"""
signal("mk28_beta_and_coskewness", "BetaAndCoskewness", SQL_BETA, [MKT(61, -61)])
signal("mk29_downside_beta", "DownsideBeta", """SELECT T, DTID, regr_slope(r, rm) AS "DownBeta" FROM m JOIN (SELECT T, avg(rm) AS k FROM (SELECT DISTINCT T, date, rm FROM m) GROUP BY 1) USING (T) WHERE rm < k GROUP BY 1, 2 HAVING count(*) >= 50""", [DAY(12)])
signal("mk30_tail_risk", "TailRisk", f"""SELECT T, DTID, regr_slope(r, idx) AS "TailRisk" FROM (SELECT p.T, p.DTID, p.r, t.idx FROM (SELECT T, DTID, j, CASE WHEN lag(j) OVER w = j + 1 THEN RI / lag(RI) OVER w - 1 END AS r
  FROM (SELECT * FROM {points(121, -121, ['RI'], src="(SELECT * FROM pn WHERE r IS NOT NULL)")} WHERE src > T - INTERVAL 120 MONTH) WINDOW w AS (PARTITION BY T, DTID ORDER BY j DESC)) p
 JOIN (SELECT mo, avg(ln(r / q)) AS idx FROM (SELECT date_trunc('month', date) AS mo, r, quantile_cont(r, 0.05) OVER (PARTITION BY date_trunc('month', date)) AS q FROM pn WHERE r IS NOT NULL) WHERE r < q GROUP BY 1) t
 ON t.mo = p.T - to_months(CAST(p.j + 1 AS INTEGER)) WHERE p.r IS NOT NULL AND (p.T, p.DTID) IN (SELECT T, DTID FROM pn JOIN g ON date > T - INTERVAL 1 MONTH AND date < T WHERE r IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) >= 36""", digits=5)
signal("mk31_betting_against_beta", "MarketBetaBAB", """SELECT T, DTID, corr(r3, rm3) * stddev_samp(r) FILTER (WHERE y) / stddev_samp(rm) FILTER (WHERE y) AS "BAB" FROM (SELECT T, DTID, r, rm, date > T - INTERVAL 12 MONTH AS y,
  r + lag(r) OVER w + lag(r, 2) OVER w AS r3, rm + lag(rm) OVER w + lag(rm, 2) OVER w AS rm3 FROM m WINDOW w AS (PARTITION BY T, DTID ORDER BY date)) GROUP BY 1, 2 HAVING count(*) >= 250 AND count(*) FILTER (WHERE y) >= 100""",
       ["m AS (SELECT *, sum(r * MC) OVER (PARTITION BY T, date) / sum(MC) OVER (PARTITION BY T, date) AS rm FROM pn JOIN g ON date >= T - INTERVAL 60 MONTH AND date < T JOIN (SELECT DISTINCT T, DTID FROM pn JOIN g ON date > T - INTERVAL 1 MONTH AND date < T) USING (T, DTID) WHERE r IS NOT NULL AND MC IS NOT NULL)"])
signal("mk32_volume_trend", "VolumeTrend", """SELECT T, DTID, regr_slope(v, b) / avg(v) AS "VolTrend" FROM (SELECT T, DTID, -ceil(datediff('day', date, T) / 30.0) AS b, sum(VOL * PRC) AS v FROM pn JOIN g ON date >= T - INTERVAL 60 MONTH AND date < T GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 36""", digits=8)
OLS2 = lambda k, y: f"""SELECT {k}, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (SELECT {k}, avg({y}) AS my, avg(l1) AS m1, avg(l2) AS m2,
  covar_pop(l1, {y}) AS c1, covar_pop(l2, {y}) AS c2, covar_pop(l1, l2) AS c12, var_pop(l1) AS v1, var_pop(l2) AS v2 FROM {{}} GROUP BY {k} HAVING count(*) >= {{}}))"""
signal("mk33_liquidity_risk", "LiquidityRisk", f"""SELECT T, DTID, "LB1", "LB2", "LB3", "LB4", "LB1" + "LB2" - "LB3" - "LB4" AS "LB5" FROM (SELECT T, DTID, covar_samp(r, rm) / var_samp(rm - ml) AS "LB1", covar_samp(i, ml) / var_samp(rm - ml) AS "LB2",
  covar_samp(r, ml) / var_samp(rm - ml) AS "LB3", covar_samp(i, rm) / var_samp(rm - ml) AS "LB4" FROM (SELECT n.*, n.liq - b0 - b1 * l1 - b2 * l2 AS i FROM nm n JOIN ({OLS2('T, DTID', 'liq').format('nm', 24)}) USING (T, DTID)) WHERE j < 60 GROUP BY 1, 2 HAVING count(*) >= 24)""",
       [f"""li AS (SELECT T, DTID, CAST(j AS BIGINT) AS j, CASE WHEN count(*) >= 10 THEN 8 * power(stddev_samp(r), 2.0/3) / power(sum(VOL * PRC), 1.0/3) END AS liq
  FROM (SELECT *, datediff('month', date_trunc('month', date), T) - CASE WHEN day(date) = 1 THEN 0 ELSE 1 END AS j FROM pn JOIN g ON date >= T - INTERVAL 121 MONTH AND date < T WHERE r IS NOT NULL) GROUP BY 1, 2, 3)""",
        f"dm AS (SELECT p.T, p.DTID, p.j, p.r, p.MC, liq FROM {points(121, -121, ['RI', 'MC'], src='(SELECT * FROM pn WHERE r IS NOT NULL)')} p JOIN li USING (T, DTID, j) WHERE p.r IS NOT NULL)",
        "mk AS (SELECT *, lag(liq) OVER w AS l1, lag(liq, 2) OVER w AS l2 FROM (SELECT T, j, sum(r * MC) / sum(MC) AS rm, coalesce(sum(liq * MC), 0) / sum(MC) AS liq FROM dm GROUP BY 1, 2) WINDOW w AS (PARTITION BY T ORDER BY j DESC))",
        "mk2 AS (SELECT * FROM mk WHERE l1 IS NOT NULL AND l2 IS NOT NULL)",
        f"mi AS (SELECT T, j, rm, liq - b0 - b1 * l1 - b2 * l2 AS ml FROM mk2 JOIN ({OLS2('T', 'liq').format('mk2', 1)}) USING (T))",
        """nm AS (SELECT * FROM (SELECT d.T, d.DTID, d.j, d.r, liq, lag(liq) OVER w AS l1, lag(liq, 2) OVER w AS l2, rm, ml FROM dm d LEFT JOIN mi ON d.T = mi.T AND d.j = mi.j WHERE (d.T, d.DTID) IN (SELECT T, DTID FROM dm WHERE j = 0)
  WINDOW w AS (PARTITION BY d.T, d.DTID ORDER BY d.j DESC)) WHERE liq IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND ml IS NOT NULL)"""], digits=5)
signal("mk03_cash_flow_variance", "CashFlowVariance", """SELECT T, DTID, stddev_pop(cf) AS "CFV" FROM (SELECT q.T, q.DTID, (s.ib + s.dp) / q.MC AS cf FROM (SELECT q.T, i.DTID, q.j, q.cut, p.MC FROM
 (SELECT T, j, CAST(T - to_months(CAST(j AS INTEGER)) AS DATE) AS cut FROM g, (SELECT unnest(generate_series(0, 59)) AS j)) q CROSS JOIN (SELECT DISTINCT DTID FROM ps) i
 ASOF JOIN ps p ON p.DTID = i.DTID AND CASE WHEN q.j = 0 THEN q.T - 1 ELSE q.cut END >= p.date WHERE p.date >= q.T - INTERVAL 61 MONTH) q
 ASOF JOIN (SELECT T, DTID, FinYearEnd, ib, dp FROM ft JOIN g ON date >= T - INTERVAL 78 MONTH AND date < T) s ON s.T = q.T AND s.DTID = q.DTID AND q.cut >= s.FinYearEnd) WHERE cf IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 36""",
       panel="ps", ft=True)


def ewma(x, outs, where):
    sel = ", ".join(f'sqrt(sum(CASE WHEN i = n - 1 THEN power({1 - a / 100}, i) ELSE {a / 100} * power({1 - a / 100}, i) END * x)) AS "{o}"' for o, a in outs)
    return f"""SELECT T, DTID, {sel} FROM (SELECT T, DTID, x, row_number() OVER (PARTITION BY T, DTID ORDER BY date DESC) - 1 AS i, count(*) OVER (PARTITION BY T, DTID) AS n FROM (SELECT *, {x} AS x FROM pn WHERE {where}) JOIN g ON date >= T - INTERVAL 30 MONTH AND date < T) GROUP BY 1, 2"""


D6 = (20, 10, 6, 4, 2, 1)
RNG = "0.361 * power((H - L) / (H + L) * 2, 2)"
signal("vo01_ewma_volatility", "EWMAVolatility", ewma("least(r * r, 0.09)", [(f"EWMAVol{a}", a) for a in D6], "r IS NOT NULL"))
signal("vo02_ewma_range", "EWMARange", ewma(f"least(CASE WHEN {RNG} = 0 THEN r * r ELSE {RNG} END, 0.09)", [(f"EWMARange{a}", a) for a in D6], "r IS NOT NULL"))
signal("vo03_ewma_downside", "EWMAVolatilityD", ewma("CASE WHEN r > 0 THEN 0 ELSE r * r END", [(f"EWMAVolD{a}", a) for a in D6[:3]], "r IS NOT NULL"))
for _k, _m in ((4, 3), (5, 6), (6, 12)):
    signal(f"vo0{_k}_volatility_{_m}m", f"Volatility{_m}M", win(-_m, 0, f'stddev_samp(r) AS "TV{_m}M"'))


# ------------------------------------------------------------------ weekly grid
GWK = Grid("1995-02-01", "2001-12-05", "7D")
GWC = grid_cte("1995-02-01", "2001-12-05", "7 DAY")


def weekly(name, cls, sql, ctes=(), panel="pn", digits=6, **kw):
    outs = CLASSES[cls].outputs

    def run(spark, d):
        x = SignalContext({"dt": panel_nation(spark, d)}, GWK, **kw)
        return x.cls(cls)

    query(name, ["T", "DTID"], {o: digits for o in outs}, sql, [panel, GWC, *ctes], digits)(run)


weekly("mk18_momentum_weekly", "Momentum", MOM)
weekly("mk28_beta_and_coskewness_weekly", "BetaAndCoskewness", SQL_BETA, [MKT(61, -61)])
weekly("mk30_tail_risk_weekly", "TailRisk", f"""SELECT T, DTID, regr_slope(r, idx) AS "TailRisk" FROM (SELECT p.T, p.DTID, p.r, t.idx FROM (SELECT T, DTID, j, CASE WHEN lag(j) OVER w = j + 1 THEN RI / lag(RI) OVER w - 1 END AS r
  FROM (SELECT * FROM {points(121, -121, ['RI'], src="(SELECT * FROM pn WHERE r IS NOT NULL)")} WHERE src > T - INTERVAL 120 MONTH) WINDOW w AS (PARTITION BY T, DTID ORDER BY j DESC)) p
 JOIN (SELECT T, b, avg(ln(r / q)) AS idx FROM (SELECT T, b, r, quantile_cont(r, 0.05) OVER (PARTITION BY T, b) AS q FROM (SELECT T, r, (SELECT min(k) FROM (SELECT unnest(generate_series(0, 121)) AS k) WHERE date >= CAST(T - to_months(CAST(k + 1 AS INTEGER)) AS DATE)) AS b
   FROM pn JOIN g ON date >= T - INTERVAL 121 MONTH AND date < T WHERE r IS NOT NULL)) WHERE r < q GROUP BY 1, 2) t ON t.T = p.T AND t.b = p.j
 WHERE p.r IS NOT NULL AND (p.T, p.DTID) IN (SELECT T, DTID FROM pn JOIN g ON date > T - INTERVAL 1 MONTH AND date < T WHERE r IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) >= 36""", digits=5)
weekly("vo01_ewma_volatility_weekly", "EWMAVolatility", ewma("least(r * r, 0.09)", [(f"EWMAVol{a}", a) for a in D6], "r IS NOT NULL"))
