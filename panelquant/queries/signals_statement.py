"""Statement and analyst signal classes, one query per class."""
from pyspark.sql import functions as F

from panelquant.operators.asof import Grid
from panelquant.queries.base import CLASS_SQL, grid_cte, query
from panelquant.signals import CLASSES, SignalContext
from panelquant.sources.adapters import analyst_det, analyst_sum, panel_supplier, statements

GS = Grid("1996-07-01", "2002-11-01")
GC = grid_cte("1996-07-01", "2002-11-01")
# statement snapshot: newest row per fiscal-year bucket, last market value on recent rows
SNAP = """s AS (SELECT * EXCLUDE (MC, k, MClast), CASE WHEN date > T - INTERVAL 12 MONTH AND MClast IS NOT NULL THEN MClast ELSE MC END AS MC FROM (
 SELECT f.*, g.T, m.MClast, row_number() OVER (PARTITION BY g.T, FTID, ceil(datediff('day', FinYearEnd, g.T) / 365.0) ORDER BY date DESC) AS k
 FROM ft f JOIN g ON date >= T - INTERVAL 258 MONTH AND date < T LEFT JOIN (SELECT g.T, DTID, arg_max(MC, date) AS MClast FROM ps JOIN g ON date >= g.T - INTERVAL 241 MONTH AND date < g.T GROUP BY 1, 2) m
 ON m.T = g.T AND m.DTID = f.DTID) WHERE k = 1)"""


class Sources(dict):
    """Source tables built on first use, so a class pays only for what it reads."""

    BUILD = {"dt": panel_supplier, "FT": statements, "IBESsum": analyst_sum, "IBESdet": analyst_det}

    def __init__(self, spark, d):
        super().__init__()
        self.args = (spark, d)

    def __missing__(self, key):
        self[key] = self.BUILD[key](*self.args)
        return self[key]

    def get(self, key, default=None):
        return self[key] if key in self.BUILD else default


def ctx(spark, d, **kw):
    return SignalContext(Sources(spark, d), GS, **kw)


def signal(name, cls, sql, ctes=(), key="FTID", digits=6, **kw):
    outs = CLASSES[cls].outputs
    nums = {o: digits for o in outs}
    CLASS_SQL[cls] = (sql, ctes, key, outs, digits, kw.get("min_obs", {}))

    def run(spark, d):
        df = ctx(spark, d, **kw).cls(cls)
        return df.filter(F.coalesce(*[F.col(o) for o in outs]).isNotNull())

    nn = " OR ".join(f'("{o}" IS NOT NULL AND NOT isnan(CAST("{o}" AS DOUBLE)))' for o in outs)
    query(name, ["T", key], nums, f"SELECT * FROM ({sql}) WHERE {nn}", ["ft", GC, SNAP, *ctes], digits)(run)


def L(x, k=1):
    return f"lag({x}, {k}) OVER w"


def D(x):
    return f"(({x}) - lag({x}) OVER w)"


def Z(x):
    return f"coalesce({x}, 0)"


def last(o):
    return f'arg_max("{o}", date) FILTER (WHERE "{o}" IS NOT NULL AND NOT isnan(CAST("{o}" AS DOUBLE))) AS "{o}"'


def formula(start, inner="s", **outs):
    """Last value per firm of row formulas over [T+start, T); `inner` may pre-compute columns."""
    body = ", ".join(f'{e} AS "{o}"' for o, e in outs.items())
    return (f"SELECT T, FTID, {', '.join(last(o) for o in outs)} FROM (SELECT T, FTID, date, {body} FROM {inner} WHERE date >= T + INTERVAL ({start}) MONTH "
            f"WINDOW w AS (PARTITION BY T, FTID ORDER BY date)) GROUP BY 1, 2")


def stage(start, src="s", **cols):
    """The snapshot rows of a window with extra columns, so lags can be taken of them."""
    return (f"(SELECT *, {', '.join(f'{e} AS {o}' for o, e in cols.items())} FROM {src} WHERE date >= T + INTERVAL ({start}) MONTH WINDOW w AS (PARTITION BY T, FTID ORDER BY date))")


PS = "coalesce(pstkrv, pstkl, pstk)"
BE = f"coalesce(seq - {Z(PS)}, ceq + pstk - {PS}, at - lt - {Z(PS)})"
EX = "(INDM3 = 'Utilities' OR INDM = 'Waste, Disposal Svs.')"
NOA = f"((at - che) - (lt - {Z('dltt')} - {Z('dlc')} - {Z('mib')}))"
ACC = f"(({Z(D('act'))} - {Z(D('che'))}) - ({Z(D('lct'))} - {Z(D('dlc'))} - {Z(D('txp'))}) - dp)"
BM = formula(-18, BM=f"ln(({BE}) / MC)")
ACCR = formula(-30, Accr=f"{ACC} / ((at + {L('at')}) / 2)")

signal("fu01_book_to_market", "BookToMarket", BM)
signal("fu02_accruals", "Accruals", ACCR)
signal("fu03_accruals_and_bm", "AccrualsAndBM", f"""SELECT T, FTID, CASE WHEN "Accr" < a2 AND "BM" > b8 THEN 1 ELSE 0 END - CASE WHEN "Accr" > a8 AND "BM" < b2 THEN 1 ELSE 0 END AS "MBaAC" FROM (
 SELECT coalesce(a.T, b.T) AS T, coalesce(a.FTID, b.FTID) AS FTID, "Accr", "BM", quantile_cont("Accr", 0.2) OVER w AS a2, quantile_cont("Accr", 0.8) OVER w AS a8, quantile_cont("BM", 0.2) OVER w AS b2, quantile_cont("BM", 0.8) OVER w AS b8
 FROM ({BM}) b FULL JOIN ({ACCR}) a ON a.T = b.T AND a.FTID = b.FTID WINDOW w AS (PARTITION BY coalesce(a.T, b.T)))""")
signal("fu04_asset_growth", "AssetGrowth", formula(-30, AGr=f"at / {L('at')} - 1"))
_ok = lambda e: f"CASE WHEN noa < 0 OR oiadp < 0 THEN NULL ELSE {e} END"
_S1 = stage(-42, noa=NOA, wc="(act - che) - (lct - dlc)", pmx="oiadp / sale")
_S2 = stage(-42, _S1, turn=_ok(f"sale / ((noa + {L('noa')}) / 2)"))
SOL = formula(-42, _S2, ATurn="turn", dATurn=_ok(D("turn")), dPM=_ok(D("pmx")), RNOA=_ok(f"oiadp / {L('noa')}"), PM="pmx",
              dNOA=_ok(f"((at - act - {Z('ivaeq')}) - (lt - lct - dltt)) / {L('at')}"), dNWC=_ok(f"{D('wc')} / {L('at', 2)}"))
signal("fu05_soliman", "SolimanFundamental", SOL)
signal("fu06_cash_flow_to_mv", "CashFlowMV", formula(-18, CFoMV="(ib + dp) / MC"))
signal("fu07_debt_issuance", "DebtIssuance", formula(-18, DI="CASE WHEN dltis > 0 THEN 1 ELSE 0 END"))
_E = stage(-102, gr=f"CASE WHEN epspx * {L('epspx')} < 0 OR abs({D('epspx')} / ((abs({L('epspx')}) + abs({L('epspx', 2)})) / 2)) > 6 THEN NULL ELSE {D('epspx')} / ((abs({L('epspx')}) + abs({L('epspx', 2)})) / 2) END")
signal("fu08_earnings_consistency", "EarningsConsistency", formula(-102, _E, EConsit="power((1 + gr) * " + " * ".join(f"(1 + {L('gr', k)})" for k in range(1, 5)) + ", 0.2) - 1"))
_ND = f"(dltt + dlc + {Z('pstk')} + {Z('dvpa')} - {Z('tstkp')} - che)"
signal("fu09_components_of_bm", "ComponentsOfBM", formula(-18, ECoBP=f"({BE} + {_ND}) / ({_ND} + MC)", LCoBP=f"{BE} / MC - ({BE} + {_ND}) / ({_ND} + MC) + ({Z('tstkp')} - {Z('dvpa')}) / ln(MC)"))
signal("fu10_enterprise_multiple", "EnterpriseMultiple", formula(-42, EM=f"CASE WHEN count(oibdp) OVER (PARTITION BY T, FTID) >= 2 THEN (MC + dltt + dlc + {Z('pstk')} - che) / oibdp END"))
signal("fu11_gross_profitability", "GrossProfitability", formula(-30, GP=f"(revt - cogs) / {L('at')}"))
signal("fu12_growth_in_inventory", "GrowthInInventory", formula(-30, dINVoAvgA=f"{D('invt')} / (at + {L('at')}) / 2", dINVoLagA=f"{D('invt')} / {L('at')}", InventGr=f"{D('invt')} / {L('invt')}"))
signal("fu13_growth_in_lt_noa", "GrowthInLTNOA", f"""SELECT x.T, x.FTID, {last('dLTNOA')} FROM (SELECT g.T, g.FTID, date, gr - "Accr" AS "dLTNOA" FROM {stage(-30, gr=f"{D(NOA)} / (at + {L('at')}) / 2")} g JOIN ({ACCR}) a ON a.T = g.T AND a.FTID = g.FTID) x GROUP BY 1, 2""")
signal("fu14_investment", "Investment", formula(-54, Invest=f"CASE WHEN sale < 10 THEN NULL ELSE (capx / sale) / (({L('capx / sale')} + {L('capx / sale', 2)} + {L('capx / sale', 3)}) / 3) END"))
_f = lambda e: f"CASE WHEN {e} THEN 1 ELSE 0 END"
_FS = formula(-30, p=" + ".join(_f(e) for e in ["ni > 0", "oancf > 0", f"{D('ni / at')} > 0", "ni - oancf < 0", f"{D('dltt / at')} < 0", f"{D('act / lct')} > 0", f"coalesce(sstk - coalesce({D('pstk')}, 0), 0) <= 0", f"{D('oiadp / sale')} > 0"]))
signal("fu15_f_score", "FScore", f"""SELECT f.T, f.FTID, CASE WHEN "BM" < q THEN NULL ELSE p + CASE WHEN "dATurn" > 0 THEN 1 ELSE 0 END END AS "FSc" FROM ({_FS}) f
 LEFT JOIN (SELECT *, quantile_cont("BM", 0.8) OVER (PARTITION BY T) AS q FROM ({BM})) b ON b.T = f.T AND b.FTID = f.FTID LEFT JOIN ({SOL}) d ON d.T = f.T AND d.FTID = f.FTID""")
signal("fu16_herfindahl", "HerfindahlIndex", f"""SELECT T, FTID, "HI", "HIAT", "HIBE" FROM (SELECT DISTINCT T, FTID, INDM3 FROM s WHERE date > T - INTERVAL 36 MONTH) JOIN (SELECT T, INDM3, avg(a) AS "HI", avg(b) AS "HIAT", avg(c) AS "HIBE" FROM (
 SELECT T, INDM3, y, sum(power(sale / ts, 2)) AS a, sum(power(at / ta, 2)) AS b, sum(power(be / tb, 2)) AS c FROM (SELECT *, sum(sale) OVER v AS ts, sum(at) OVER v AS ta, sum(be) OVER v AS tb FROM (SELECT *, {BE} AS be,
 CASE WHEN date > T - INTERVAL 12 MONTH THEN 1 WHEN date > T - INTERVAL 24 MONTH THEN 2 WHEN date > T - INTERVAL 36 MONTH THEN 3 END AS y FROM s) WHERE y IS NOT NULL WINDOW v AS (PARTITION BY T, INDM3, y)) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (T, INDM3)""")
_N2 = f"((at - che) - (lt - dltt - dlc - {Z('mib')}))"
signal("fu17_net_operating_assets", "NetOperatingAssets", formula(-30, NOA=f"{_N2} / {L('at')}", ChNOA=f"{D(_N2)} / {L('at')}"))
signal("fu18_operating_leverage", "OperatingLeverage", formula(-18, OperLvrg="(xsga + cogs) / at"))
signal("fu19_org_capital", "OrgCapital", """SELECT T, FTID, k AS "OrgCap", (k - avg(k) OVER v) / stddev_samp(k) OVER v AS "IAOrgCap" FROM (SELECT T, FTID, any_value(INDM3) AS INDM3, sum(coalesce(xsga / CPI, 0) * CASE WHEN o = 1 THEN 4 ELSE 1 END * power(0.85, n - o)) / arg_max(at, date) AS k
 FROM (SELECT *, row_number() OVER (PARTITION BY T, FTID ORDER BY date) AS o, count(*) OVER (PARTITION BY T, FTID) AS n, max(date) OVER (PARTITION BY T, FTID) AS mx FROM s) WHERE mx > T - INTERVAL 18 MONTH GROUP BY 1, 2) WHERE k <> 0 WINDOW v AS (PARTITION BY T, INDM3)""")
signal("fu20_o_score", "OScore", formula(-30, OSc=f"""CASE WHEN {EX} THEN NULL ELSE -1.32 - 0.407 * ln(at / CPI) + 6.03 * ((dltt + dlc) / at) - 1.43 * ((act - lct) / at) + 0.076 * (lct / act) - 1.72 * {_f('lt > at')} - 2.37 * (ni / at) - 1.83 * ((pi + dp) / lt)
 + 0.285 * {_f(f"ni < 0 AND {L('ni')} < 0")} - 0.521 * ({D('ni')} / (abs(ni) + abs({L('ni')}))) END"""))
signal("fu21_percent_operating_accrual", "PercentOperatingAccrual", formula(-18, prcOA="(ib - oancf) / abs(ib)"))
signal("fu22_percent_total_accrual", "PercentTotalAccrual", formula(-18, prcTA=f"(ib - oancf - ivncf - fincf + {Z('sstk')} - {Z('prstkc')} - {Z('dv')}) / abs(ib)"))
signal("fu23_rd_to_mv", "RDtoMV", formula(-18, RDoMV="CASE WHEN xrd > 0 THEN xrd / MC END"))
signal("fu24_return_on_equity", "ReturnOnEquity", formula(-18, RoE=f"ib / {BE}"))
_YB = lambda n: "CASE " + " ".join(f"WHEN date < T - INTERVAL {12 * i} MONTH THEN {-(i + 1)}" for i in reversed(range(n))) + " END"
_SG = f"(SELECT *, CASE WHEN gr IS NULL THEN NULL ELSE rank() OVER (PARTITION BY T, y, gr IS NULL ORDER BY gr) + (count(*) OVER (PARTITION BY T, y, gr) - 1) / 2.0 END AS rk FROM {stage(-78, gr='sale / ' + L('sale') + ' - 1', y=_YB(7))})"
signal("fu25_sales_growth", "SalesGrowth", formula(-78, _SG, SalesGr=f"(5 * rk + 4 * {L('rk')} + 3 * {L('rk', 2)} + 2 * {L('rk', 3)} + {L('rk', 4)}) / 15.0"))
signal("fu26_sales_to_price", "SalesToPrice", formula(-18, SaleToMV="CASE WHEN sale > 0 THEN sale / MC END"))
signal("fu27_share_repurchases", "ShareRepurchases", formula(-18, SR=_f("prstkc > 0")))
signal("fu28_sustainable_growth", "SustainableGrowth", formula(-54, SuGr=f"CASE WHEN count(at) OVER (PARTITION BY T, FTID) >= 3 THEN {BE} / {L(BE)} - 1 END"))
signal("fu29_total_xfin", "TotalXFIN", formula(-18, TXFIN=f"({Z('sstk')} - {Z('prstkc')} - dv + dltis - dltr + dlcch) / at"))
signal("fu30_unexpected_rd", "UnexpectedRDIncreases", formula(-18, URDI=_f(f"xrd / revt > 0.05 AND xrd / at > 0.05 AND xrd / {L('xrd')} > 1.05 AND (xrd / at) / {L('xrd / at')} > 1.05")))
signal("fu31_z_score", "ZScore", formula(-18, ZSc=f"CASE WHEN {EX} THEN NULL ELSE 1.2 * ((act - lct) / at) + 1.4 * (re / at) + 3.3 * (oiadp / at) + 0.6 * (MC / lt) + sale / at END"))
_A2 = lambda x: f"(({L(x)} + {L(x, 2)}) / 2)"
_G2 = lambda x: f"(({x} - {_A2(x)}) / {_A2(x)})"
_PAIR = lambda a, b, p, q: f"CASE WHEN {_A2(p)} <= 0 OR {_A2(q)} <= 0 THEN NULL ELSE {_G2(a)} - {_G2(b)} END"
_AB = f"(SELECT *, avg(capx) OVER (PARTITION BY T, INDM3, y) AS ci FROM {stage(-42, y=_YB(5), gm='sale - cogs')})"
signal("fu32_abarbanell_bushee", "AbarbanellBushee", formula(-42, _AB, indCAPEX=f"(capx / ({L('capx')} + {L('capx', 2)}) / 2 - 1) - (ci / ({L('ci')} + {L('ci', 2)}) / 2 - 1)", SmI=_PAIR("sale", "invt", "sale", "invt"),
       SmSGA=_PAIR("sale", "xsga", "sale", "xsga"), dSdAR=_PAIR("sale", "rect", "sale", "rect"), dGMdS=_PAIR("gm", "sale", "sale", "gm")))
_AL = f"(che + 0.75 * (act - che) - (at - {Z('gdwl')} - {Z('intan')}))"
signal("fu33_asset_liquidity", "AssetLiquidity", formula(-30, AL=f"CASE WHEN {EX} THEN NULL ELSE {_AL} / {L('at')} END", AL2=f"CASE WHEN {EX} THEN NULL ELSE {_AL} / {L('MC')} END"))
signal("fu34_cash_to_assets", "CashToAssets", formula(-18, CtA="che / at"))
signal("fu35_cash_based_profitability", "CashBasedOperatingProfitability", formula(-30, CBOP=f"(revt - cogs - xsga + {Z('xrd')} - {Z(D('rect'))} - {Z(D('invt'))} - {Z(D('xpp'))} + {Z(D('(drc + drlt)'))} + {Z(D('ap'))} + {Z(D('xacc'))}) / at"))
_CF = f"ib - ({D('act')} - {D('lct')} - {D('che')} + {D('dlc')} - dp)"
_ES = f"(SELECT *, count(*) OVER (PARTITION BY T, FTID) AS n, row_number() OVER (PARTITION BY T, FTID ORDER BY date DESC) AS i FROM {stage(-138, e='ib / ' + L('at'), cf=_CF)} WHERE e IS NOT NULL AND cf IS NOT NULL)"
signal("fu36_earnings_smoothness", "EarningsSmoothness", f'SELECT T, FTID, stddev_samp(e) / stddev_samp(cf) AS "ES" FROM {_ES} WHERE n >= 4 AND i <= 10 GROUP BY 1, 2', min_obs={"EarningsSmoothness": 4})
signal("fu37_hiring_rate", "HiringRate", formula(-30, HR=f"CASE WHEN {EX} OR {D('emp')} = 0 THEN NULL ELSE {D('emp')} / (emp + {L('emp')}) * 2 END"))
signal("fu38_labor_force_efficiency", "LaborForceEfficiency", formula(-30, LFE=f"(sale / emp) / {L('sale / emp')} - 1"))
signal("fu39_operating_profits_to_equity", "OperatingProfitsToEquity", formula(-18, OPoE=f"CASE WHEN coalesce(xint, cogs, xsga) IS NOT NULL THEN (revt - {Z('cogs')} - {Z('xsga')} - {Z('xint')}) / {BE} END"))
signal("fu40_operating_profits_to_assets", "OperatingProfitsToAssets", formula(-18, OPoA=f"(revt - cogs - xsga + {Z('xrd')}) / at"))
signal("fu41_industry_adj_real_estate", "IndustryAdjRealEstateRatio", f"""SELECT T, FTID, CASE WHEN INDM3 = 'Real Estate' OR count(*) OVER v <= 2 THEN NULL ELSE rer - avg(rer) OVER v END AS "IARER" FROM (SELECT T, FTID, arg_max((fatb + {Z('fatl')}) / ppent, date) AS rer, arg_max(INDM3, date) AS INDM3
 FROM s WHERE date >= T - INTERVAL 18 MONTH GROUP BY 1, 2) WINDOW v AS (PARTITION BY T, INDM3)""")
signal("fu42_tangibility", "Tangibility", formula(-18, TAN="(che + 0.715 * rect + 0.547 * invt + 0.535 * ppegt) / at"))
_Q = lambda e: f"(power(1 + ({e}) / 4, 0.25) - 1)"
_WW = """(SELECT s.*, isg FROM s LEFT JOIN (SELECT T, INDM3, sum(sale) FILTER (WHERE date > T - INTERVAL 12 MONTH) / nullif(sum(sale) FILTER (WHERE date > T - INTERVAL 24 MONTH AND date <= T - INTERVAL 12 MONTH), 0) - 1 AS isg FROM s GROUP BY 1, 2
 HAVING count(sale) FILTER (WHERE date > T - INTERVAL 12 MONTH) > 2 AND count(sale) FILTER (WHERE date > T - INTERVAL 24 MONTH AND date <= T - INTERVAL 12 MONTH) > 2) i ON i.T = s.T AND i.INDM3 = s.INDM3)"""
signal("fu43_whited_wu", "WhitedWuIndex", formula(-30, _WW, WWI=f"CASE WHEN {EX} THEN NULL ELSE -0.091 * {_Q('(ib + dp) / at')} - 0.062 * {_f('dv > 0')} + 0.021 * (dltt / at) - 0.044 * ln(at) + 0.102 * {_Q('isg')} - 0.035 * {_Q('sale / ' + L('sale') + ' - 1')} END"))
signal("fu44_earnings_to_price", "EarningsToPrice", formula(-18, EoP="CASE WHEN ib > 0 THEN ib / MC END"))
signal("fu45_leverage", "Leverage", formula(-18, Lvrg="(dltt + dlc) / MC"))
signal("fu46_payout_yield", "PayoutYield", formula(-30, PY=f"(dvc + prstkc - {D('pstkrv')}) / MC", NPY="(dvc + prstkc - sstk) / MC"))
signal("fu47_ppe_and_inventory", "ChPPEIA", formula(-30, ChPPEIA=f"({D('ppegt')} + {D('invt')}) / {L('at')}"))
_AV = f"((at + {L('at')}) / 2)"
signal("fu48_net_finance", "NetFinance", formula(-30, NDF=f"(dltis - dltr + dlcch) / {_AV}", NEF=f"({Z('sstk')} - {Z('prstkc')} - dv) / {_AV}"))
signal("fu49_capital_turnover", "CapitalTurnover", formula(-30, CT=f"sale / {L('at')}"))
_COL, _NCA, _NCL = f"(lct - {Z('dlc')})", f"(at - act - {Z('ivao')})", f"(lt - lct - {Z('dltt')})"
_FNA = f"CASE WHEN ivst IS NULL AND ivao IS NULL THEN NULL ELSE {Z('ivst')} + {Z('ivao')} END"
_FNL = f"CASE WHEN dltt IS NULL AND dlc IS NULL AND pstk IS NULL THEN NULL ELSE {Z('dltt')} + {Z('dlc')} + {Z('pstk')} END"
_RV = stage(-30, coa="act - che", col=_COL, nca=_NCA, ncl=_NCL, fna=_FNA, fnl=_FNL)
signal("fu50_richardson", "RichardsonVars", formula(-30, _RV, **{k: f"{D(e)} / {L('at')}" for k, e in {"dNNCWC": "(coa - col)", "dCOA": "coa", "dCOL": "col", "dNNCOA": "(nca - ncl)", "dNCOA": "nca", "dNCOL": "ncl",
       "dNFA": "(fna - fnl)", "dSTI": "ivst", "dLTI": "ivao", "dCE": "ceq", "dFL": "fnl", "TA": "(nca - ncl + coa - col + fna - fnl)"}.items()}))
signal("fu51_assets_to_market", "AssetsTomarket", formula(-18, AtM="at / MC"))
signal("fu52_composite_debt_issuance", "CompositeDebtIssuance", formula(-78, CDI=f"ln((dltt + dlc) / {L('(dltt + dlc)', 5)} - 1)"))
signal("fu53_rd_to_sales", "RDtoSales", formula(-18, RDtS="CASE WHEN xrd > 0 THEN xrd / sale END"))
_RC = f"({Z('xrd')} + 0.8 * {L(Z('xrd'))} + 0.6 * {L(Z('xrd'), 2)} + 0.4 * {L(Z('xrd'), 3)} + 0.2 * {L(Z('xrd'), 4)})"
signal("fu54_rd_to_assets", "RDtoAssets", formula(-66, RDtA=f"CASE WHEN {_RC} <= 0 OR xrd IS NULL THEN NULL ELSE {_RC} / at END"))


def _duration():
    """Closed form: g_k and roe_k are affine in the starting values."""
    g0, r0 = f"(sale / {L('sale')} - 1)", f"(ib / {L('ceq')})"
    aff = lambda a, b, k, x: f"({a} * {(1 - b ** k) / (1 - b)!r} + {b ** k!r} * {x})"
    be = lambda k: "ceq" if k == 0 else f"(ceq * (1 + {aff(0.06, 0.24, k, g0)}))"
    pv = " + ".join(f"{aff(0.12, 0.57, k, r0)} * {be(k - 1)} / {1.12 ** k!r} * ({k} - 58.0 / 3)" for k in range(1, 11))
    bad = " OR ".join(f"{be(k)} <= 0" for k in range(10))
    return f"CASE WHEN {bad} THEN NULL ELSE 58.0 / 3 + ({pv}) / MC END"


signal("fu55_duration_of_equity", "DurationOfEquity", formula(-30, DurE=_duration()))


def _ols_sql(src, by, y, xs):
    """Residual form by successive projection (Frisch-Waugh), independent of the matrix code."""
    q, cur = src, {v: v for v in [*xs, y]}
    sel = ", ".join(f"{v} - avg({v}) OVER (PARTITION BY {by}) AS r0_{v}" for v in cur)
    q = f"(SELECT *, {sel} FROM {src})"
    for i, x in enumerate(xs):
        rest = [*xs[i + 1:], y]
        sel = ", ".join(f"r{i}_{v} - CASE WHEN sum(r{i}_{x} * r{i}_{x}) OVER (PARTITION BY {by}) > 1e-12 * sum(r0_{x} * r0_{x}) OVER (PARTITION BY {by}) THEN r{i}_{x} * sum(r{i}_{v} * r{i}_{x}) OVER (PARTITION BY {by}) / sum(r{i}_{x} * r{i}_{x}) OVER (PARTITION BY {by}) ELSE 0 END AS r{i + 1}_{v}" for v in rest)
        q = f"(SELECT *, {sel} FROM {q})"
    return f"(SELECT *, r{len(xs)}_{y} AS e FROM {q})"


_DA = formula(-30, stage(-30, a0=f"{ACC} / {L('at')}", a1=f"1 / {L('at')}", a2=f"({D('sale')} - {D('rect')}) / {L('at')}", a3=f"ppegt / {L('at')}"), eg="a0", x1="a1", x2="a2", x3="a3")
_DA2 = f"(SELECT x.*, INDM3 FROM ({_DA}) x JOIN (SELECT DISTINCT T, FTID, INDM3 FROM s) USING (T, FTID) WHERE eg IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)"
signal("fu56_discretionary_accrual", "DiscretionaryAccrual", f'SELECT T, FTID, e AS "DA" FROM {_ols_sql(_DA2, "T, INDM3", "eg", ["x1", "x2", "x3"])}')
_PX = lambda shift, lag, start, cols: f"""SELECT s.*, {', '.join(f'CASE WHEN p.date >= s.T + INTERVAL ({start}) MONTH THEN p.{v} END AS {v}, CASE WHEN q.od >= s.T + INTERVAL ({start}) MONTH AND q.od < s.T THEN q.{v} END AS {v}_lag' for v in cols)}
 FROM (SELECT *, least(CAST(FinYearEnd + INTERVAL {shift} MONTH AS DATE), T - 1) AS d1, CAST(FinYearEnd + INTERVAL {shift} MONTH AS DATE) AS d2 FROM {{}}) s ASOF LEFT JOIN ps p ON p.DTID = s.DTID AND s.d1 >= p.date
 ASOF LEFT JOIN (SELECT DTID, CAST(date + INTERVAL {lag} MONTH AS DATE) AS date, max(date) AS od, {', '.join(f'arg_max({v}, date) AS {v}' for v in cols)} FROM ps GROUP BY 1, 2) q ON q.DTID = s.DTID AND s.d2 >= q.date"""
_EF = _PX(3, 15, -161, ["RI"]).format("(SELECT * FROM s WHERE date >= T - INTERVAL 138 MONTH AND (T, DTID) IN (SELECT T, DTID FROM s WHERE date > T - INTERVAL 18 MONTH))")
_EF2 = f"(SELECT T, FTID, ib / MC AS earn, RI / RI_lag - 1 AS ret, CASE WHEN RI / RI_lag - 1 < 0 THEN 1 ELSE 0 END AS neg, CASE WHEN RI / RI_lag - 1 < 0 THEN RI / RI_lag - 1 ELSE 0 END AS rneg FROM px WHERE ib / MC IS NOT NULL AND RI / RI_lag IS NOT NULL)"


_FEATURES = f"""SELECT coalesce(a.T, b.T) AS T, coalesce(a.FTID, b.FTID) AS FTID, "EPer", "EPred", "ETime" FROM
 (SELECT T, FTID, regr_slope(eps, l) AS "EPer", regr_syy(eps, l) - regr_slope(eps, l) * regr_sxy(eps, l) AS "EPred" FROM (SELECT T, FTID, epspx / ajex AS eps, lag(epspx / ajex) OVER (PARTITION BY T, FTID ORDER BY FinYearEnd) AS l FROM px) WHERE l IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) a
 FULL JOIN (SELECT T, FTID, 1 - sum(e * e) / sum(r0_earn * r0_earn) AS "ETime" FROM {_ols_sql(_EF2, 'T, FTID', 'earn', ['neg', 'ret', 'rneg'])} GROUP BY 1, 2 HAVING count(*) >= 5) b ON a.T = b.T AND a.FTID = b.FTID"""
# the dummy and its product with the return split the fit in two lines, one per sign; a side with one row takes the other's slope
_SIDE = lambda k: ", ".join(f"{f} FILTER (WHERE neg = {k}) AS {n}{k}" for f, n in (("count(*)", "n"), ("regr_slope(earn, ret)", "b"), ("avg(earn)", "y"), ("avg(ret)", "x")))
_ECON = f"""SELECT T, FTID, (d + s0) / nullif(d, 0) AS "ECon" FROM (SELECT *, (y1 - s1 * x1) - (y0 - s0 * x0) AS d FROM (SELECT *, CASE WHEN n0 > 1 THEN b0 ELSE b1 END AS s0, CASE WHEN n1 > 1 THEN b1 ELSE b0 END AS s1
 FROM (SELECT T, FTID, {_SIDE(0)}, {_SIDE(1)} FROM {_EF2} GROUP BY 1, 2 HAVING count(*) >= 5)))"""
CLASS_SQL["EarningsFeatures"] = (f'SELECT coalesce(f.T, e.T) AS T, coalesce(f.FTID, e.FTID) AS FTID, "EPer", "EPred", "ETime", "ECon" FROM ({_FEATURES}) f FULL JOIN ({_ECON}) e ON f.T = e.T AND f.FTID = e.FTID', [f"px AS ({_EF})"], "FTID",
                                 CLASSES["EarningsFeatures"].outputs, 6, {"EarningsFeatures": 5})


@query("fu57_earnings_features", ["T", "FTID"], ["EPer", "EPred", "ETime"], _FEATURES, ["ft", GC, SNAP, f"px AS ({_EF})"])
def _(spark, d):
    return ctx(spark, d, min_obs={"EarningsFeatures": 5}).cls("EarningsFeatures")


@query("fu57_earnings_conservatism", ["T", "FTID"], ["ECon"], f'SELECT T, FTID, "ECon" FROM ({_FEATURES}) f FULL JOIN ({_ECON}) e USING (T, FTID)', ["ft", GC, SNAP, f"px AS ({_EF})"])
def _(spark, d):
    return ctx(spark, d, min_obs={"EarningsFeatures": 5}).cls("EarningsFeatures")


_IR = f"""(SELECT T, FTID, arg_max(r5, FinYearEnd) AS r5, arg_max(b5, FinYearEnd) AS b5, arg_max(rb, FinYearEnd) AS rb FROM (SELECT T, FTID, FinYearEnd, r12 + {L('r12')} + {L('r12', 2)} + {L('r12', 3)} + {L('r12', 4)} AS r5, ln({L('bm', 5)}) AS b5,
 be / {L('be', 5)} + {L('br')} + {L('br', 2)} + {L('br', 3)} + {L('br', 4)} + {L('br', 5)} AS rb FROM (SELECT *, ln(RI / RI_lag) AS r12, ln(RI / RI_lag) - ln(PRC / PRC_lag) AS br FROM px) WINDOW w AS (PARTITION BY T, FTID ORDER BY FinYearEnd))
 WHERE r5 IS NOT NULL AND b5 IS NOT NULL AND NOT isnan(b5) AND rb IS NOT NULL GROUP BY 1, 2)"""
signal("fu58_intangible_return", "IntangibleReturn", f'SELECT T, FTID, e AS "IntanRet" FROM {_ols_sql(_IR, "T", "r5", ["b5", "rb"])}',
       [f"px AS ({_PX(0, 12, -101, ['RI', 'PRC']).format(f'(SELECT *, {BE} AS be, {BE} / MC AS bm, count({BE} / MC) OVER (PARTITION BY T, FTID) AS n FROM s WHERE date >= T - INTERVAL 78 MONTH) WHERE n >= 6 AND bm IS NOT NULL')})"])


# ------------------------------------------------------------------ statement snapshot and analyst classes
@query("e04_statement_snapshot", ["T", "FTID", "FinYearEnd", "date"], {"sale": 3, "MC": 3}, "SELECT * FROM s", ["ft", GC, SNAP])
def _(spark, d):
    return ctx(spark, d).statements()


def asum(months, fpi, extra=""):
    return f"(SELECT a.*, g.T{extra} FROM asum a JOIN g ON date >= T - INTERVAL {months} MONTH AND date < T WHERE FPI = {fpi} WINDOW w AS (PARTITION BY T, DTID ORDER BY date))"


def analyst(name, cls, sql, ctes=(), **kw):
    signal(name, cls, sql, ["asum", *ctes], key="DTID", **kw)


def alast(o, src):
    return f"SELECT T, DTID, {last(o)} FROM {src} GROUP BY 1, 2"


_CH = asum(2, 1, ", MEANEST - lag(MEANEST) OVER w AS ch, lag(MEDEST) OVER w AS pm")
analyst("an01_forecast_change", "IBESForecastChange", f"""SELECT T, DTID, arg_max(CASE WHEN ch < 0 THEN 1 ELSE 0 END, date) AS "DF", arg_max(CASE WHEN ch > 0 THEN 1 ELSE 0 END, date) AS "UF" FROM {_CH} GROUP BY 1, 2""")
analyst("an02_forecast_dispersion", "IBESForecastDispersion", alast("FD", f"(SELECT *, CASE WHEN NUMEST < 3 THEN NULL ELSE STDEV / MEANEST END AS \"FD\" FROM {asum(1, 1)})"))
analyst("an03_analyst_coverage", "IBESAnalystsCoverage", f'SELECT T, DTID, arg_max(NUMEST, date) AS "AC" FROM {asum(1, 1)} GROUP BY 1, 2')
analyst("an04_long_term_dispersion", "IBESDispLT", f'SELECT T, DTID, arg_max(STDEV, date) FILTER (WHERE NUMEST >= 2) AS "DispLT" FROM {asum(1, 0)} GROUP BY 1, 2', min_obs={"IBESDispLT": 2})
_EP = "(SELECT T, DTID, arg_max(epspi, date) AS e FROM s WHERE date >= T - INTERVAL 18 MONTH GROUP BY 1, 2)"
analyst("an05_long_short_disparity", "IBESDispLTST", f"""SELECT a.T, a.DTID, l - 100 * (m - e) / abs(e) AS "DispLTST" FROM (SELECT T, DTID, arg_max(MEDEST, date) AS m FROM {asum(1, 1)} GROUP BY 1, 2) a
 JOIN (SELECT T, DTID, arg_max(MEDEST, date) AS l FROM {asum(1, 0)} GROUP BY 1, 2) b ON a.T = b.T AND a.DTID = b.DTID JOIN {_EP} f ON a.T = f.T AND a.DTID = f.DTID""")
analyst("an06_forecast_change_scaled", "ChangesInAnalystFC", alast("dAEF", f'(SELECT *, ch / (abs(MEDEST) / 2 + abs(pm) / 2) AS "dAEF" FROM {_CH})'))
analyst("an07_long_term_growth", "LongtermGrowthForecasts", f'SELECT T, DTID, arg_max(MEDEST, date) AS "LTGrF" FROM {asum(1, 0)} GROUP BY 1, 2')
analyst("an08_forecast_and_accrual", "IBESChForecastAccrual", f"""SELECT c.T, c.DTID, CASE WHEN a < 0 AND ch > 0 THEN 1 ELSE 0 END - CASE WHEN a > 0 AND ch < 0 THEN 1 ELSE 0 END AS "ChiFA" FROM (SELECT T, DTID, arg_max(ch, date) FILTER (WHERE ch IS NOT NULL) AS ch FROM {_CH} GROUP BY 1, 2) c
 JOIN (SELECT f.T, f.DTID, CASE WHEN at < 150000 OR sale < 25 THEN NULL ELSE "Accr" - quantile_cont("Accr", 0.5) OVER (PARTITION BY f.T) END AS a FROM (SELECT T, FTID, arg_max(at, date) AS at, arg_max(sale, date) AS sale, arg_max(DTID, date) AS DTID FROM s
 WHERE date >= T - INTERVAL 18 MONTH GROUP BY 1, 2) f JOIN ({ACCR}) r ON f.T = r.T AND f.FTID = r.FTID) x ON x.T = c.T AND x.DTID = c.DTID""", min_obs={"IBESChForecastAccrual.at": 150000})
_PR = "(SELECT T, DTID, arg_max(PRC, date) AS PRC FROM ps JOIN g ON date >= T - INTERVAL 1 MONTH AND date < T GROUP BY 1, 2)"
analyst("an09_analyst_value", "IBESChAnalystValue", f"""SELECT T, DTID, (1 + (fr - 0.1) / 1.1 + (fr - 0.1) / (1.1 * 0.1)) * (be / PRC) AS "AV" FROM (SELECT a.T, a.DTID, be, PRC, CASE WHEN m / be > 1 OR be < 0 THEN NULL ELSE m / be END AS fr FROM
 (SELECT T, DTID, arg_max(MEDEST, date) AS m FROM {asum(1, 1)} GROUP BY 1, 2) a JOIN (SELECT T, DTID, arg_max(b, date) AS be FROM (SELECT T, DTID, date, coalesce((bkvlps + {L('bkvlps')}) / 2, bkvlps) AS b FROM s WHERE date >= T - INTERVAL 30 MONTH
 WINDOW w AS (PARTITION BY T, FTID ORDER BY date)) GROUP BY 1, 2) b ON a.T = b.T AND a.DTID = b.DTID JOIN {_PR} p ON a.T = p.T AND a.DTID = p.DTID)""")
analyst("an10_change_in_recommendation", "ChangeInRecommendation", """SELECT T, DTID, avg(rec) AS "ChR" FROM (SELECT T, TICKER, ESTIMID, arg_max(DTID, date) AS DTID, arg_max(rec, date) AS rec FROM (SELECT T, TICKER, ESTIMID, DTID, date,
 CASE WHEN date < T - INTERVAL 1 MONTH THEN 0 WHEN ITEXT = 'STRONG BUY' AND coalesce(lag(ITEXT) OVER w, '') <> 'STRONG BUY' THEN 1 WHEN lag(ITEXT) OVER w IS NULL THEN 0 WHEN ITEXT <> lag(ITEXT) OVER w THEN -1 ELSE 0 END AS rec
 FROM (SELECT TICKER, ESTIMID, DTID, date, arg_max(ITEXT, seq) AS ITEXT FROM adet GROUP BY 1, 2, 3, 4) JOIN g ON date >= T - INTERVAL 60 MONTH AND date < T WINDOW w AS (PARTITION BY T, TICKER, ESTIMID ORDER BY date)) GROUP BY 1, 2, 3) GROUP BY 1, 2""", ["adet"])
analyst("an11_forecast_to_price", "EarningsForecastToPrice", f'SELECT a.T, a.DTID, m / PRC AS "EFoP" FROM (SELECT T, DTID, arg_max(MEDEST, date) AS m FROM {asum(1, 1)} GROUP BY 1, 2) a JOIN {_PR} p ON a.T = p.T AND a.DTID = p.DTID', digits=9)
