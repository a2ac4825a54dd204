"""Market signals: trailing-window aggregates, two-point lags, month-grid regressions."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import clean, fdiv, finite, fln, fpow, month_no, nz
from panelquant.functions.stage import stage
from panelquant.operators import xsection as X
from panelquant.operators.asof import BROADCAST_ROWS, Agg, asof_grid, last_of, month_bucket, snapshot, win_agg
from panelquant.operators.series import group_ols, product_agg, residuals, safe_corr
from panelquant.signals.base import SignalClass, SignalContext, WindowSpec, double_quantile, register

c = F.col
INF = math.inf


def _win(name, outputs, items, start, end, spec, min_obs=0):
    register(SignalClass(name, outputs, {"dt": (start, end, items)}, min_obs={"n": min_obs}, window=spec))


def _both(x, *others):
    """x where every other column is present (row-wise drop of incomplete rows)."""
    cond = None
    for o in others:
        k = (c(o) if isinstance(o, str) else o).isNotNull()
        cond = k if cond is None else cond & k
    return F.when(cond, x if not isinstance(x, str) else c(x))


def _gate(n, k, x):
    return F.when(n >= k, x)


def pv():
    """Traded value."""
    return c("VOL") * c("PRC")


def amihud():
    return F.when(pv() != 0, fdiv(F.abs("r"), pv()))


_win("ShareIssuance5Y", ["CEI5Y"], ["MC", "RI"], -61, 0, lambda g: WindowSpec(
    {"mc": F.when(c("MC") != 0, c("MC"))},
    {"m": Agg("last", "mc", -61), "m0": Agg("asof", "mc", -61, 0, 60), "i": Agg("last", "RI", -61), "i0": Agg("asof", "RI", -61, 0, 60)},
    {"CEI5Y": lambda a: fln(fdiv(a["m"], a["m0"])) - fln(fdiv(a["i"], a["i0"]))}))

_win("ShareIssuance1Y", ["SI1Y"], ["SHROUT", "AF"], -13, 0, lambda g: WindowSpec(
    {"s": fdiv("SHROUT", "AF")}, {"s1": Agg("last", "s", -13), "s0": Agg("asof", "s", -13, 0, 12)},
    {"SI1Y": lambda a: fln(fdiv(a["s1"], a["s0"]))}))

_win("BidAskSpread", ["BidAsk"], ["r", "VOL", "PRC"], -1, 0, lambda g: WindowSpec(
    {"r": _both("r", pv()), "v": _both(pv(), "r")},
    {"sd": Agg("std", "r", -1), "v": Agg("sum", "v", -1), "n": Agg("n", "r", -1)},
    {"BidAsk": lambda a: _gate(a["n"], g(), F.when(fdiv(a["sd"], a["v"]) == INF, F.lit(0.05)).otherwise(
        fdiv(8 * fpow(a["sd"], 2 / 3), fpow(a["v"], 1 / 3))))}), 10)

_win("Amihud", ["Amihud"], ["r", "VOL", "PRC"], -12, 0, lambda g: WindowSpec(
    {"a": amihud()}, {"a": Agg("avg", "a", -12), "n": Agg("n", "a", -12)},
    {"Amihud": lambda a: _gate(a["n"], g(), finite(a["a"]))}), 50)

_win("Size", ["Size"], ["MC"], -1, 0, lambda g: WindowSpec({}, {"m": Agg("last", "MC", -1)}, {"Size": lambda a: a["m"]}))
_win("Volatility", ["TV"], ["r"], -1, 0, lambda g: WindowSpec(
    {}, {"s": Agg("std", "r", -1), "n": Agg("n", "r", -1)}, {"TV": lambda a: _gate(a["n"], g(), a["s"])}), 15)
_win("ShareTurnover", ["ST"], ["VOL", "SHROUT"], -3, 0, lambda g: WindowSpec(
    {"v": _both("VOL", "SHROUT"), "s": _both("SHROUT", "VOL")},
    {"v": Agg("sum", "v", -3), "s": Agg("last", "s", -3), "n": Agg("n", "v", -3)},
    {"ST": lambda a: _gate(a["n"], g(), fdiv(a["v"], a["s"]) / 1e6)}), 40)
_win("ShareTurnoverVar", ["CVoST"], ["VOL", "SHROUT"], -6, 0, lambda g: WindowSpec(
    {"t": fdiv("VOL", "SHROUT")}, {"s": Agg("std", "t", -6), "m": Agg("avg", "t", -6), "n": Agg("n", "t", -6)},
    {"CVoST": lambda a: _gate(a["n"], g(), fdiv(a["s"], a["m"]))}), 50)
_win("VolumeToMarketCap", ["VolMV"], ["VOL", "PRC", "MC"], -12, 0, lambda g: WindowSpec(
    {"v": _both(pv(), "MC"), "m": _both("MC", pv())},
    {"v": Agg("sum", "v", -12), "m": Agg("last", "m", -12), "n": Agg("n", "v", -12)},
    {"VolMV": lambda a: _gate(a["n"], g(), fdiv(a["v"], a["m"]) / 1e6)}), 100)
_win("VolumeVariance", ["VarVol"], ["VOL", "PRC"], -36, 0, lambda g: WindowSpec(
    {"v": pv()}, {"s": Agg("std", "v", -36), "n": Agg("n", "v", -36)}, {"VarVol": lambda a: _gate(a["n"], g(), a["s"])}), 250)
_win("MaxReturn", ["Max"], ["r"], -1, 0, lambda g: WindowSpec(
    {}, {"m": Agg("max", "r", -1), "n": Agg("n", "r", -1)}, {"Max": lambda a: _gate(a["n"], g(), a["m"])}), 15)
_win("Price", ["PRC"], ["PRC"], -1, 0, lambda g: WindowSpec({}, {"p": Agg("last", "PRC", -1)}, {"PRC": lambda a: a["p"]}))
_win("YearHigh", ["52WH"], ["RI"], -12, 0, lambda g: WindowSpec(
    {}, {"l": Agg("last", "RI", -12), "m": Agg("max", "RI", -12)}, {"52WH": lambda a: fdiv(a["l"], a["m"])}))


def _ret(name, out, start, end, lag):
    _win(name, [out], ["RI"], start, end, lambda g: WindowSpec(
        {}, {"a": Agg("last", "RI", start, end), "b": Agg("asof", "RI", start, end, lag)}, {out: lambda x: fdiv(x["a"], x["b"]) - 1}))


# name, output, window start, window end, months back of the base price (fixed values)
for _row in [("ShortTermReversal", "STR", -2, 0, 1), ("Momentum", "Mom", -8, -1, 7), ("LaggedMomentum", "MomLag", -13, -6, 12),
             ("LongTermReversal", "LTR", -61, -12, 60), ("MomentumReversal", "MomRev", -19, -12, 18)]:
    _ret(*_row)


def _cls(name, outputs, inputs=None, depends=(), key="DTID", **min_obs):
    def deco(fn):
        register(SignalClass(name, list(outputs), inputs or {}, list(depends), key, min_obs, build=fn))
        return fn
    return deco


@_cls("LiquidityShocks", ["LiqShck"], {"dt": (-13, 0, ["r", "VOL", "PRC"])}, n=10)
def _liq_shock(x: SignalContext) -> DataFrame:
    # 30-day buckets are counted back from T, so rows are fanned out to their grid dates; buckets
    # are aggregated inside the key's partition before anything else moves
    s = snapshot(x.dt.select("DTID", "date", amihud().alias("a")).filter("a is not null"), x.grid, -13, 0, ["a"])
    b = (s.groupBy("T", "DTID", F.ceil(F.datediff("T", "date") / 30).alias("b")).agg(F.avg("a").alias("a"), F.count("a").alias("n"))
         .filter(c("n") >= x.gate("LiquidityShocks")).withColumn("a", F.when(c("a") == INF, 1.0).otherwise(c("a"))))
    out = b.groupBy("T", "DTID").agg((F.avg(F.when(c("b") == 1, c("a"))) - F.avg(F.when(c("b") != 1, c("a")))).alias("LiqShck"))
    return out.filter("LiqShck is not null")


@_cls("Age", ["Age", "MomAge"], {"dt": (-240, 0, []), "FT": (-240, 0, ["DTID"])}, ["Momentum"], years=12)
def _age(x: SignalContext) -> DataFrame:
    d0 = F.lit("1900-01-01").cast("date")
    first = lambda df, n: win_agg(df.select("DTID", "date", F.datediff("date", d0).cast("double").alias("d")), x.grid, {n: Agg("min", "d", -240)}).filter(c(n).isNotNull())
    p = first(x.dt, "a").join(first(x.sources["FT"], "b"), ["T", "DTID"], "left")
    age = p.withColumn("Age", (F.datediff("T", d0) - F.least("a", "b")) / 365).select("T", "DTID", "Age")
    m = x.cls("Momentum").join(age, ["T", "DTID"]).filter(c("Age") >= x.gate("Age", "years"))  # ids without a value count too
    m = X.with_quantiles(m, ["T"], {"q": ("Age", 0.2)}).filter("Age < q").select("T", "DTID", c("Mom").alias("MomAge"))
    return age.join(m, ["T", "DTID"], "left").select("T", "DTID", "Age", "MomAge")


@_cls("MomentumLTReversal", ["MomLTRev"], {}, ["Momentum", "LongTermReversal"])
def _mom_lt(x):
    j = x.cls("Momentum").join(x.cls("LongTermReversal"), ["T", "DTID"], "outer")
    return double_quantile(j, "LTR", "Mom", "MomLTRev").select("T", "DTID", "MomLTRev")


@_cls("MomentumVolume", ["MomVol"], {"dt": (-6, 0, ["VOL", "PRC"])}, ["Momentum"])
def _mom_vol(x):
    v = win_agg(x.dt.select("DTID", "date", pv().alias("v"), F.lit(1).alias("one")), x.grid, {"v": Agg("sum", "v", -6), "n": Agg("n", "one", -6)}).filter("n > 0")
    j = x.cls("Momentum").join(v.select("T", "DTID", nz("v").alias("v")), ["T", "DTID"])
    return X.with_quantiles(j, ["T"], {"q": ("v", 0.8)}).filter("v >= q").select("T", "DTID", c("Mom").alias("MomVol"))


@_cls("IndustryMomentum", ["IndMom"], {"dt": (-7, 0, ["RI", "MC"]), "FT": (-18, 0, ["DTID", "INDM3"])})
def _ind_mom(x):
    p = win_agg(x.dt, x.grid, {"a": Agg("last", "RI", -7), "b": Agg("asof", "RI", -7, 0, 6), "MC": Agg("last", "MC", -7)})
    ft = x.statements().filter(c("date") >= F.add_months("T", -18)).groupBy("T", "DTID").agg(last_of("INDM3").alias("INDM3"))
    j = p.withColumn("r", fdiv("a", "b") - 1).join(ft, ["T", "DTID"]).filter("r is not null and MC is not null and INDM3 is not null")
    m = X.mkt_factor(j, ["T", "INDM3"]).withColumnRenamed("rm", "IndMom")
    return j.join(m, ["T", "INDM3"]).select("T", "DTID", "IndMom")


def _month_returns(x: SignalContext, n: int, start: int, cols, src: DataFrame | None = None) -> DataFrame:
    """(T, DTID, j, r, cols): return from month point j+1 to j, both inside the window."""
    g = asof_grid(x.dt if src is None else src, x.grid, n, cols, start)
    w = W.partitionBy("DTID", "T").orderBy(c("j").desc())
    prev = F.when(F.lag("j").over(w) == c("j") + 1, F.lag("RI").over(w))
    return g.withColumn("r", fdiv("RI", prev) - 1)


# period sets of the seasonality averages, period 1 = newest month (fixed values)
SEASON = {"Seas": set(range(12, 241, 12)), "Seas1A": {12}, "Seas1N": set(range(1, 11))}
for _a, _b, _t in ((13, 60, "2t5"), (61, 120, "6t10"), (121, 180, "11t15"), (181, 240, "16t20")):
    _mult = {k for k in range(_a, _b + 1) if k % 12 == 0}
    SEASON[f"Seas{_t}A"], SEASON[f"Seas{_t}N"] = _mult, set(range(_a, _b + 1)) - _mult


@_cls("Seasonality", list(SEASON), {"dt": (-241, 0, ["RI"])})
def _season(x):
    m = _month_returns(x, 241, -241, ["RI"])
    recent = snapshot(x.dt, x.grid, -1, 0, []).filter(c("date") > F.add_months("T", -1)).select("T", "DTID").distinct()
    m = m.join(recent, ["T", "DTID"], "left_semi").withColumn("p", c("j") + 1)
    return m.groupBy("T", "DTID").agg(*[F.avg(F.when(c("p").isin(sorted(s)), c("r"))).alias(k) for k, s in SEASON.items()])


def _with_market(x: SignalContext, m: DataFrame, by, per_t: int) -> DataFrame:
    """Join the value-weighted market return.  The factor has at most per_t rows per grid date, so it
    is broadcast under a checked bound and the fanned-out rows keep their partitioning by id."""
    m = m.filter("r is not null and MC is not null")
    f = X.mkt_factor(m, list(by))
    return m.join(F.broadcast(f) if len(x.grid.dates()) * per_t <= BROADCAST_ROWS else f, list(by))


@_cls("ResidualMomentum", ["ResidMom"], {"dt": (-37, 0, ["RI", "MC"])}, n=36)
def _resid_mom(x):
    m = _with_market(x, _month_returns(x, 37, -37, ["RI", "MC"]), ("T", "j"), 37)
    k = ["T", "DTID"]
    co = group_ols(m, k, "r", ["rm"]).filter(c("n") >= x.gate("ResidualMomentum"))
    e = residuals(m, co, k, "r", ["rm"])
    e = e.withColumn("i", F.row_number().over(W.partitionBy("DTID", "T").orderBy(c("j").desc())) - 1).filter("i >= 24 and i < 35")
    g = e.groupBy(*k).agg(product_agg(1 + c("resid")).alias("p"), F.stddev_pop("resid").alias("s"))
    return g.select(*k, (c("p") / F.when(c("s") != 0, c("s"))).alias("ResidMom")).filter("ResidMom is not null")


@_cls("IdiosyncraticRisk", ["IdioRisk"], {"dt": (-1, 0, ["r", "MC"])}, n=15)
def _idio(x):
    # a trading day belongs to one month, so the market series needs no T on a monthly grid
    s = snapshot(x.dt.filter("r is not null and MC is not null"), x.grid, -1, 0, ["r", "MC"])
    co = group_ols(_with_market(x, s, ("T", "date"), 31), ["T", "DTID"], "r", ["rm"]).filter(c("n") >= x.gate("IdiosyncraticRisk"))
    return co.select("T", "DTID", F.sqrt(c("ssr") / c("n")).alias("IdioRisk"))


@_cls("BetaAndCoskewness", ["Coskew", "Beta"], {"dt": (-61, 0, ["RI", "MC"])}, n=36)
def _beta_coskew(x):
    m = _with_market(x, _month_returns(x, 61, -61, ["RI", "MC"]), ("T", "j"), 61)
    k = ["T", "DTID"]
    co = group_ols(m, k, "r", ["rm"]).filter(c("n") >= x.gate("BetaAndCoskewness"))
    mean = m.groupBy(*k).agg(F.avg("rm").alias("mrm"))
    e = residuals(m, co, k, "r", ["rm"]).join(mean, k).withColumn("d2", F.pow(c("rm") - c("mrm"), F.lit(2)))
    g = e.groupBy(*k).agg(F.avg(c("resid") * c("d2")).alias("num"), (F.sqrt(F.avg(c("resid") * c("resid"))) * F.avg("d2")).alias("den"))
    return co.join(g, k).select(*k, (c("num") / F.when(c("den") != 0, c("den"))).alias("Coskew"), c("b1").alias("Beta"))


@_cls("DownsideBeta", ["DownBeta"], {"dt": (-12, 0, ["r", "MC"])}, n=50)
def _down_beta(x):
    p = x.dt.filter("r is not null and MC is not null").select("DTID", "date", "r", "MC")
    mk = X.mkt_factor(p, "date")  # no T: a date's market return does not depend on the window
    day = snapshot(mk.withColumn("k", F.lit(0)), x.grid, -12, 0, ["rm"], "k").groupBy("T").agg(F.avg("rm").alias("mrm"))
    s = snapshot(p.join(mk, "date"), x.grid, -12, 0, ["r", "rm"]).join(F.broadcast(day), "T").filter("rm < mrm")
    co = group_ols(s, ["T", "DTID"], "r", ["rm"]).filter(c("n") >= x.gate("DownsideBeta"))
    return co.select("T", "DTID", c("b1").alias("DownBeta"))


@_cls("TailRisk", ["TailRisk"], {"dt": (-121, 0, ["r", "RI"])}, n=36)
def _tail(x):
    p = stage(x.dt.filter("r is not null and RI is not null").select("DTID", "date", "r", "RI"))
    if x.grid.monthly:  # calendar months: one tail index per month serves every T
        p0, gk = p.select(month_no("date").alias("mno"), "r"), ["mno"]
    else:  # months counted back from T; many (T, j) share the same days, so there is one index per pair of bounds
        months = x.grid.df(p.sparkSession).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(120))))
        months = months.withColumns({"lo": F.add_months("T", -c("j") - 1), "hi": F.add_months("T", -c("j"))})
        days = months.select("lo", "hi").distinct().withColumn("date", F.explode(F.sequence("lo", F.date_sub("hi", 1))))
        p0, gk = p.join(F.broadcast(days), "date").select("lo", "hi", "r"), ["lo", "hi"]  # at most 31 days for every day of the calendar
    p0 = stage(p0)
    # the quantiles are sent, one per period: the copied rows look small on disk, and an inner join would send those
    q = p0.join(F.broadcast(X.group_quantiles(p0, gk, {"q": ("r", 0.05)})), gk).filter("r < q")
    idx = q.groupBy(*gk).agg(F.avg(fln(fdiv("r", "q"))).alias("idx"))
    win = p.select("DTID", "date", "RI")
    recent = snapshot(win, x.grid, -1, 0, []).filter(c("date") > F.add_months("T", -1)).select("T", "DTID").distinct()
    g = asof_grid(win, x.grid, 121, ["RI"], -121)
    g = g.filter(c("src") > F.add_months("T", -120))
    w = W.partitionBy("DTID", "T").orderBy(c("j").desc())
    m = g.withColumn("r", fdiv("RI", F.when(F.lag("j").over(w) == c("j") + 1, F.lag("RI").over(w))) - 1)
    m = m.join(recent, ["T", "DTID"], "left_semi")
    if x.grid.monthly:
        m = m.withColumn("mno", month_no("T") - c("j") - 1).join(F.broadcast(idx), "mno")
    else:
        m = m.join(F.broadcast(months.join(idx, gk).select("T", "j", "idx")), ["T", "j"])  # grid dates x 121 months
    co = group_ols(m, ["T", "DTID"], "r", ["idx"]).filter(c("n") >= x.gate("TailRisk"))
    return co.select("T", "DTID", c("b1").alias("TailRisk"))


@_cls("MarketBetaBAB", ["BAB"], {"dt": (-60, 0, ["r", "MC"])}, n=250, year=100)
def _bab(x):
    p = x.dt.select("DTID", "date", "r", "MC")
    s = snapshot(p, x.grid, -60, 0, ["r", "MC"])
    recent = snapshot(p, x.grid, -1, 0, []).filter(c("date") > F.add_months("T", -1)).select("T", "DTID").distinct()
    s = _with_market(x, s.join(recent, ["T", "DTID"], "left_semi"), ("T", "date"), 1830)
    w = W.partitionBy("DTID", "T").orderBy("date")
    three = lambda v: c(v) + F.lag(v, 1).over(w) + F.lag(v, 2).over(w)
    y = c("date") > F.add_months("T", -12)
    s = s.withColumn("r3", three("r")).withColumn("rm3", three("rm"))
    g = s.groupBy("T", "DTID").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(y, 1)).alias("ny"), safe_corr("r3", "rm3").alias("co"),
                                   F.stddev_samp(F.when(y, c("r"))).alias("sr"), F.stddev_samp(F.when(y, c("rm"))).alias("sm"))
    g = g.filter((c("n") >= x.gate("MarketBetaBAB")) & (c("ny") >= x.gate("MarketBetaBAB", "year")))
    return g.select("T", "DTID", fdiv(c("co") * c("sr"), "sm").alias("BAB"))


@_cls("VolumeTrend", ["VolTrend"], {"dt": (-60, 0, ["VOL", "PRC"])}, n=36)
def _vol_trend(x):
    s = snapshot(x.dt.select("DTID", "date", pv().alias("v")).filter("v is not null"), x.grid, -60, 0, ["v"])
    b = s.groupBy("T", "DTID", (-F.ceil(F.datediff("T", "date") / 30)).cast("double").alias("b")).agg(F.sum("v").alias("v"))
    co = group_ols(b, ["T", "DTID"], "v", ["b"]).filter(c("n") >= x.gate("VolumeTrend"))
    m = b.groupBy("T", "DTID").agg(F.avg("v").alias("mv"))
    return co.join(m, ["T", "DTID"]).select("T", "DTID", fdiv("b1", "mv").alias("VolTrend"))


@_cls("LiquidityRisk", ["LB1", "LB2", "LB3", "LB4", "LB5"], {"dt": (-121, 0, ["r", "VOL", "PRC", "MC", "RI"])}, n=24, day=10)
def _liq_risk(x):
    p = x.dt.select("DTID", "date", "r", pv().alias("v"), "MC", "RI").filter("r is not null and v is not null and MC is not null and RI is not null")
    k = ["T", "DTID"]
    m = _month_returns(x, 121, -121, ["RI", "MC"], p).filter("r is not null and MC is not null")
    # month bucket j of T holds the dates in (T-j-1, T-j] months; it differs from a calendar month
    # only in which month the first day belongs to, so partials are per shifted month (and T's own
    # first day is not visible yet in the newest bucket)
    sm = F.when(F.dayofmonth("date") == 1, month_no("date") - 1).otherwise(month_no("date"))
    old = F.dayofmonth("date") != 1
    agg = lambda cond, t: [F.stddev_samp(F.when(cond, c("r"))).alias("sd" + t), F.sum(F.when(cond, c("v"))).alias("v" + t), F.count(F.when(cond, c("r"))).alias("n" + t)]
    liq = p.groupBy("DTID", sm.alias("sm")).agg(*agg(F.lit(True), ""), *agg(old, "0"))

    def level(t):
        raw = fdiv(8 * fpow("sd" + t, 2 / 3), fpow("v" + t, 1 / 3))
        return F.when(c("n" + t) >= x.gate("LiquidityRisk", "day"), F.when(raw == INF, 0.05).otherwise(raw))

    if x.grid.monthly:
        liq = liq.select("DTID", "sm", "n0", level("").alias("l"), level("0").alias("lnew"))
        m = m.withColumn("sm", month_no("T") - c("j") - 1).join(liq, ["DTID", "sm"]).filter("j > 0 or n0 > 0")
        m = m.withColumn("liq", F.when(c("j") == 0, c("lnew")).otherwise(c("l"))).drop("l", "lnew", "n0")
    else:
        s = snapshot(p, x.grid, -121, 0, ["r", "v"]).withColumn("j", month_bucket(inclusive=True))
        m = m.join(s.groupBy(*k, "j").agg(*agg(F.lit(True), "")).select(*k, "j", level("").alias("liq")), [*k, "j"])
    # value-weighted market return and liquidity per (T, month); weights of missing liquidity stay in
    mk = m.groupBy("T", "j").agg(fdiv(F.sum(c("r") * c("MC")), F.sum("MC")).alias("rm"), fdiv(nz(F.sum(c("liq") * c("MC"))), F.sum("MC")).alias("ml"))
    wt = W.partitionBy("T").orderBy(c("j").desc())
    mk = mk.withColumn("l1", F.lag("ml", 1).over(wt)).withColumn("l2", F.lag("ml", 2).over(wt)).filter("rm is not null and ml is not null and l1 is not null and l2 is not null")
    mk = residuals(mk, group_ols(mk, "T", "ml", ["l1", "l2"]), "T", "ml", ["l1", "l2"], "mliq").select("T", "j", "rm", "mliq")
    live = m.filter("j = 0").select(*k).distinct()
    m = m.join(live, k, "left_semi").join(mk, ["T", "j"], "left")
    w = W.partitionBy("DTID", "T").orderBy(c("j").desc())
    m = m.withColumn("l1", F.lag("liq", 1).over(w)).withColumn("l2", F.lag("liq", 2).over(w))
    m = m.filter("liq is not null and l1 is not null and l2 is not null and rm is not null and mliq is not null")
    n = x.gate("LiquidityRisk")
    co = group_ols(m, k, "liq", ["l1", "l2"]).filter(c("n") >= n)
    m = residuals(m, co, k, "liq", ["l1", "l2"], "inov").filter("j < 60")
    cov = F.covar_samp
    g = m.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.var_samp(c("rm") - c("mliq")).alias("V"), cov("r", "rm").alias("c1"), cov("inov", "mliq").alias("c2"),
                          cov("r", "mliq").alias("c3"), cov("inov", "rm").alias("c4")).filter(c("n") >= n)
    g = g.select(*k, *[fdiv(f"c{i}", "V").alias(f"LB{i}") for i in (1, 2, 3, 4)])
    return g.withColumn("LB5", c("LB1") + c("LB2") - c("LB3") - c("LB4"))


@_cls("CashFlowVariance", ["CFV"], {"FT": (-78, 0, ["ib", "dp", "DTID", "FinYearEnd"]), "dt": (-61, 0, ["MC"])}, n=36)
def _cfv(x):
    mc = asof_grid(x.dt, x.grid, 60, ["MC"], -61).select("T", "DTID", "j", "MC")
    # statements seen at T, placed at their fiscal year end and carried to each month point
    ft = x.statements().filter(c("date") >= F.add_months("T", -78)).select("T", "DTID", c("FinYearEnd").alias("d"), F.struct("ib", "dp").alias("v"))
    pts = mc.withColumn("d", F.add_months("T", -c("j")))
    u = ft.withColumn("s", F.lit(0)).unionByName(pts.withColumn("s", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("DTID", "T").orderBy("d", "s").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("m", F.last("v", ignorenulls=True).over(w)).filter("s = 1")
    u = u.withColumn("cf", fdiv(c("m.ib") + c("m.dp"), "MC")).filter("cf is not null")
    g = u.groupBy("T", "DTID").agg(F.stddev_pop("cf").alias("CFV"), F.count("cf").alias("n")).filter(c("n") >= x.gate("CashFlowVariance"))
    return g.select("T", "DTID", clean("CFV").alias("CFV"))
