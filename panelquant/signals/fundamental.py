"""Statement signals.  Most are one formula over the fiscal-year snapshot (`project`); classes that
need peers, several sources or regressions have their own builder."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import book_equity, clean, fdiv, finite, flag, fln, fpow, null_if, nz
from panelquant.functions.stage import stage
from panelquant.operators import xsection as X
from panelquant.operators.asof import asof_join, last_of
from panelquant.operators.series import group_ols, residuals
from panelquant.signals.base import Items, SignalClass, SignalContext, double_quantile, fiscal_snapshot, fw, register

c = F.col
KF = ["T", "FTID"]
BE_ITEMS = ["pstkrv", "pstkl", "pstk", "seq", "ceq", "lt", "at"]
UTIL, WASTE, ESTATE = "Utilities", "Waste, Disposal Svs.", "Real Estate"  # fixed industry labels


def excluded():
    return (c("INDM3") == UTIL) | (c("INDM") == WASTE)


def _p(name, outputs, start, items):
    """Register a row formula: fn(f) -> {output: Column}; f.x is an item, f.L(x, n) its n-th lag."""
    def deco(fn):
        register(SignalClass(name, list(outputs), {"FT": (start, 0, list(items))}, key="FTID", project=fn))
        return fn
    return deco


def _b(name, outputs, inputs, depends=(), **min_obs):
    def deco(fn):
        register(SignalClass(name, list(outputs), inputs, list(depends), "FTID", min_obs, build=fn))
        return fn
    return deco


def _avg2(f, x):
    return (c(x) + f.L(x)) / 2


def accruals(f):
    """Non-cash working-capital change less depreciation; missing changes count as zero."""
    d = lambda x: nz(f.D(x))
    return (d("act") - d("che")) - (d("lct") - d("dlc") - d("txp")) - f.dp


def noa(f, strict=False):
    """Net operating assets; debt items may be missing unless `strict`."""
    debt = f.dltt + f.dlc if strict else nz("dltt") + nz("dlc")
    return (f.at - f.che) - (f.lt - debt - nz("mib"))


_p("BookToMarket", ["BM"], -18, BE_ITEMS + ["MC"])(lambda f: {"BM": fln(fdiv(book_equity(), f.MC))})
_p("Accruals", ["Accr"], -30, ["act", "che", "lct", "dlc", "txp", "dp", "at"])(lambda f: {"Accr": fdiv(accruals(f), _avg2(f, "at"))})
_p("AssetGrowth", ["AGr"], -30, ["at"])(lambda f: {"AGr": fdiv("at", f.L("at")) - 1})


@_p("SolimanFundamental", ["ATurn", "dATurn", "dPM", "RNOA", "PM", "dNOA", "dNWC"], -42, ["at", "che", "lt", "dltt", "dlc", "lct", "mib", "sale", "oiadp", "act", "ivaeq"])
def _soliman(f):
    n = noa(f)
    ok = lambda x: null_if(null_if(x, n < 0), f.oiadp < 0)
    pm = fdiv("oiadp", "sale")
    # the lag of a lag needs the first value on the row, so it is built from lagged parts
    def turn(k):
        at = lambda x: f.L(x, k) if k else x
        nk, nk1 = at(n), f.L(n, k + 1)
        v = fdiv(at(f.sale), (nk + nk1) / 2)
        return null_if(null_if(v, nk < 0), at(f.oiadp) < 0)
    wc = (f.act - f.che) - (f.lct - f.dlc)
    return {"ATurn": turn(0), "dATurn": ok(turn(0) - turn(1)), "dPM": ok(pm - f.L(pm)), "RNOA": ok(fdiv("oiadp", f.L(n))), "PM": pm,
            "dNOA": ok(fdiv((f.at - f.act - nz("ivaeq")) - (f.lt - f.lct - f.dltt), f.L("at"))),
            "dNWC": ok(fdiv(wc - f.L(wc), f.L("at", 2)))}


_p("CashFlowMV", ["CFoMV"], -18, ["ib", "dp", "MC"])(lambda f: {"CFoMV": fdiv(f.ib + f.dp, "MC")})
_p("DebtIssuance", ["DI"], -18, ["dltis"])(lambda f: {"DI": flag(f.dltis > 0)})


@_p("EarningsConsistency", ["EConsit"], -102, ["epspx"])
def _econsit(f):
    def growth(k):
        e0 = f.L("epspx", k) if k else f.epspx
        e1, e2 = f.L("epspx", k + 1), f.L("epspx", k + 2)
        g = fdiv(e0 - e1, (F.abs(e1) + F.abs(e2)) / 2)
        return null_if(null_if(g, e0 * e1 < 0), F.abs(g) > 6)
    p = F.lit(1.0)
    for k in range(5):
        p = p * (1 + growth(k))
    return {"EConsit": fpow(p, 1 / 5) - 1}


@_p("ComponentsOfBM", ["ECoBP", "LCoBP"], -18, BE_ITEMS + ["MC", "che", "tstkp", "dvpa", "dlc", "dltt"])
def _components(f):
    be = book_equity()
    nd = f.dltt + f.dlc + nz("pstk") + nz("dvpa") - nz("tstkp") - f.che
    e = fdiv(be + nd, nd + f.MC)
    lc = fdiv(be, "MC") - e + nz(fdiv(nz("tstkp") - nz("dvpa"), fln("MC")))
    return {"ECoBP": e, "LCoBP": lc}


def _count(f, x):
    return F.count(F.when(f.inside, c(x))).over(W.partitionBy("FTID", "T"))


_p("EnterpriseMultiple", ["EM"], -42, ["pstk", "oibdp", "MC", "che", "dlc", "dltt"])(lambda f: {
    "EM": null_if(fdiv(f.MC + f.dltt + f.dlc + nz("pstk") - f.che, "oibdp"), _count(f, "oibdp") < 2)})
_p("GrossProfitability", ["GP"], -30, ["revt", "cogs", "at"])(lambda f: {"GP": fdiv(f.revt - f.cogs, f.L("at"))})
_p("GrowthInInventory", ["dINVoAvgA", "dINVoLagA", "InventGr"], -30, ["invt", "at"])(lambda f: {
    "dINVoAvgA": fdiv(f.D("invt"), f.at + f.L("at")) / 2,
    "dINVoLagA": null_if(fdiv(f.D("invt"), f.L("at")), f.invt + f.L("invt") == 0), "InventGr": fdiv(f.D("invt"), f.L("invt"))})


@_b("GrowthInLTNOA", ["dLTNOA"], {"FT": (-30, 0, ["at", "che", "lt", "dltt", "dlc", "mib"])}, ["Accruals"])
def _ltnoa(x: SignalContext):
    f = Items(-30)
    s = x.statements().select("T", "FTID", "date", F.when(f.inside, fdiv(f.D(noa(f)), f.at + f.L("at")) / 2).alias("g"))
    j = s.join(x.cls("Accruals"), KF).withColumn("d", clean(c("g") - c("Accr")))
    return j.groupBy(*KF).agg(last_of("d").alias("dLTNOA"))


_p("Investment", ["Invest"], -54, ["capx", "sale"])(lambda f: {
    "Invest": null_if(fdiv(fdiv("capx", "sale"), (f.L(fdiv("capx", "sale")) + f.L(fdiv("capx", "sale"), 2) + f.L(fdiv("capx", "sale"), 3)) / 3), f.sale < 10)})


@_b("FScore", ["FSc"], {"FT": (-30, 0, ["ni", "oancf", "at", "dltt", "act", "lct", "sstk", "pstk", "oiadp", "sale"])}, ["BookToMarket", "SolimanFundamental"])
def _fscore(x: SignalContext):
    f = Items(-30)
    up = lambda a, b: fdiv(a, b) - f.L(fdiv(a, b)) > 0
    dn = lambda a, b: fdiv(a, b) - f.L(fdiv(a, b)) < 0
    pts = (flag(f.ni > 0) + flag(f.oancf > 0) + flag(up("ni", "at")) + flag(f.ni - f.oancf < 0) + flag(dn("dltt", "at")) + flag(up("act", "lct"))
           + flag(nz(f.sstk - nz(f.D("pstk"))) <= 0) + flag(up("oiadp", "sale")))
    s = x.statements().select("T", "FTID", "date", F.when(f.inside, pts).alias("p")).groupBy(*KF).agg(last_of("p").alias("p")).filter("p is not null")
    bm = X.with_quantiles(x.cls("BookToMarket").select(*KF, "BM"), ["T"], {"q": ("BM", 0.8)})
    j = s.join(bm, KF, "left").join(x.cls("SolimanFundamental").select(*KF, "dATurn"), KF, "left")
    return j.select(*KF, null_if(c("p") + flag(c("dATurn") > 0), c("BM") < c("q")).alias("FSc")).filter("FSc is not null")


@_b("AccrualsAndBM", ["MBaAC"], {}, ["BookToMarket", "Accruals"])
def _mbaac(x):
    j = x.cls("BookToMarket").join(x.cls("Accruals"), KF, "outer")
    return double_quantile(j, "Accr", "BM", "MBaAC").select(*KF, "MBaAC")


@_b("HerfindahlIndex", ["HI", "HIAT", "HIBE"], {"FT": (-54, 0, BE_ITEMS + ["sale", "INDM3"])})
def _herf(x):
    yr = (F.when(c("date") > F.add_months("T", -12), 1).when(c("date") > F.add_months("T", -24), 2).when(c("date") > F.add_months("T", -36), 3))
    s = x.statements().withColumn("be", book_equity()).withColumn("y", yr).filter("y is not null and INDM3 is not null")
    h = lambda v: fdiv(F.sum(c(v) * c(v)), F.pow(F.sum(v), F.lit(2)))
    g = s.groupBy("T", "INDM3", "y").agg(h("sale").alias("s"), h("at").alias("a"), h("be").alias("b"))
    g = g.groupBy("T", "INDM3").agg(F.avg("s").alias("HI"), F.avg("a").alias("HIAT"), F.avg("b").alias("HIBE"))
    last = s.groupBy(*KF).agg(last_of("INDM3").alias("INDM3"))
    return last.join(g, ["T", "INDM3"]).select(*KF, "HI", "HIAT", "HIBE")


_p("NetOperatingAssets", ["NOA", "ChNOA"], -30, ["at", "che", "lt", "mib", "dlc", "dltt"])(lambda f: {
    "NOA": fdiv(noa(f, True), f.L("at")), "ChNOA": fdiv(f.D(noa(f, True)), f.L("at"))})
_p("OperatingLeverage", ["OperLvrg"], -18, ["xsga", "cogs", "at"])(lambda f: {"OperLvrg": fdiv(f.xsga + f.cogs, "at")})


@_b("OrgCapital", ["OrgCap", "IAOrgCap"], {"FT": (-258, 0, ["xsga", "CPI", "at", "INDM3"])})
def _orgcap(x):
    s = x.statements()
    s = s.withColumn("mx", F.max("date").over(W.partitionBy("FTID", "T"))).filter(c("mx") > F.add_months("T", -18))
    n = F.count(F.lit(1)).over(W.partitionBy("FTID", "T"))
    s = s.withColumn("o", F.row_number().over(fw())).withColumn("n", n)
    v = nz(fdiv("xsga", "CPI")) * F.when(c("o") == 1, 4.0).otherwise(1.0) * F.pow(F.lit(0.85), c("n") - c("o"))
    g = s.withColumn("v", v).groupBy(*KF).agg(fdiv(F.sum("v"), last_of("at")).alias("k"), last_of("INDM3").alias("INDM3"))
    g = g.withColumn("OrgCap", finite(F.when(c("k") != 0, c("k")))).filter("OrgCap is not null and INDM3 is not null")
    g = X.attach(g, ["T", "INDM3"], m=F.avg("OrgCap"), sd=F.stddev_samp("OrgCap"))
    return g.select(*KF, "OrgCap", fdiv(c("OrgCap") - c("m"), "sd").alias("IAOrgCap"))


# coefficients of the two distress scores (fixed values)
@_p("OScore", ["OSc"], -30, ["lt", "ni", "at", "dltt", "dlc", "act", "lct", "pi", "dp", "INDM3", "INDM", "CPI"])
def _oscore(f):
    ni1 = f.L("ni")
    o = (-1.32 - 0.407 * fln(fdiv("at", "CPI")) + 6.03 * fdiv(f.dltt + f.dlc, "at") - 1.43 * fdiv(f.act - f.lct, "at") + 0.076 * fdiv("lct", "act")
         - 1.72 * flag(f.lt > f.at) - 2.37 * fdiv("ni", "at") - 1.83 * fdiv(f.pi + f.dp, "lt") + 0.285 * flag((f.ni < 0) & (ni1 < 0))
         - 0.521 * fdiv(f.ni - ni1, F.abs("ni") + F.abs(ni1)))
    return {"OSc": null_if(o, excluded())}


_p("PercentOperatingAccrual", ["prcOA"], -18, ["ib", "oancf"])(lambda f: {"prcOA": fdiv(f.ib - f.oancf, F.abs("ib"))})
_p("PercentTotalAccrual", ["prcTA"], -18, ["ib", "oancf", "ivncf", "fincf", "sstk", "prstkc", "dv"])(lambda f: {
    "prcTA": fdiv(f.ib - f.oancf - f.ivncf - f.fincf + nz("sstk") - nz("prstkc") - nz("dv"), F.abs("ib"))})
_p("RDtoMV", ["RDoMV"], -18, ["xrd", "MC"])(lambda f: {"RDoMV": null_if(fdiv("xrd", "MC"), f.xrd <= 0)})
_p("ReturnOnEquity", ["RoE"], -18, BE_ITEMS + ["ib"])(lambda f: {"RoE": fdiv("ib", book_equity())})


def year_bucket(n: int):
    """-1 for statements of the last year before T, -2 for the year before, ... down to -n."""
    e = F.lit(None).cast("int")
    for i in range(n):
        e = F.when(c("date") < F.add_months("T", -12 * i), -(i + 1)).otherwise(e)
    return e


@_b("SalesGrowth", ["SalesGr"], {"FT": (-78, 0, ["sale"])})
def _salesgr(x):
    f = Items(-78)
    s = x.statements().filter(f.inside).select("T", "FTID", "date", year_bucket(7).alias("y"), (fdiv("sale", F.lag("sale").over(fw())) - 1).alias("g"))
    s = X.rank_avg(s, "g", ["T", "y"], "R")
    L = lambda k: F.lag("R", k).over(fw()) if k else c("R")
    v = sum(((5 - k) * L(k) for k in range(1, 5)), 5 * L(0)) / 15
    return s.withColumn("v", v).groupBy(*KF).agg(last_of("v").alias("SalesGr"))


_p("SalesToPrice", ["SaleToMV"], -18, ["sale", "MC"])(lambda f: {"SaleToMV": null_if(fdiv("sale", "MC"), f.sale <= 0)})
_p("ShareRepurchases", ["SR"], -18, ["prstkc"])(lambda f: {"SR": flag(f.prstkc > 0)})
_p("SustainableGrowth", ["SuGr"], -54, BE_ITEMS)(lambda f: {"SuGr": null_if(fdiv(book_equity(), f.L(book_equity())) - 1, _count(f, "at") < 3)})
_p("TotalXFIN", ["TXFIN"], -18, ["sstk", "prstkc", "dv", "dltis", "dltr", "dlcch", "at"])(lambda f: {
    "TXFIN": fdiv(nz("sstk") - nz("prstkc") - f.dv + f.dltis - f.dltr + f.dlcch, "at")})
_p("UnexpectedRDIncreases", ["URDI"], -18, ["xrd", "revt", "at"])(lambda f: {
    "URDI": flag((fdiv("xrd", "revt") > 0.05) & (fdiv("xrd", "at") > 0.05) & (fdiv("xrd", f.L("xrd")) > 1.05) & (fdiv(fdiv("xrd", "at"), f.L(fdiv("xrd", "at"))) > 1.05))})
_p("ZScore", ["ZSc"], -18, ["act", "lct", "oiadp", "re", "at", "lt", "sale", "MC", "INDM3", "INDM"])(lambda f: {
    "ZSc": null_if(1.2 * fdiv(f.act - f.lct, "at") + 1.4 * fdiv("re", "at") + 3.3 * fdiv("oiadp", "at") + 0.6 * fdiv("MC", "lt") + fdiv("sale", "at"), excluded())})


@_b("AbarbanellBushee", ["indCAPEX", "SmI", "SmSGA", "dSdAR", "dGMdS"], {"FT": (-42, 0, ["capx", "sale", "xsga", "invt", "rect", "cogs", "INDM3"])})
def _abar(x):
    s = x.statements().filter(Items(-42).inside).withColumn("y", year_bucket(5)).withColumn("gm", c("sale") - c("cogs"))
    # the few industry means are written, not the rows, which then stay where their firm lies
    s = s.join(stage(s.groupBy("T", "INDM3", "y").agg(F.avg("capx").alias("ci")), 5), ["T", "INDM3", "y"], "left")
    L = lambda v, k: F.lag(v, k).over(fw())
    grow = lambda v: fdiv(v, L(v, 1) + L(v, 2)) / 2 - 1
    a2 = lambda v: (L(v, 1) + L(v, 2)) / 2
    g = lambda v: fdiv(c(v) - a2(v), a2(v))
    ok = lambda e, *vs: null_if(e, (a2(vs[0]) <= 0) | (a2(vs[1]) <= 0)) if len(vs) == 2 else e
    vs = {"indCAPEX": grow("capx") - grow("ci"), "SmI": ok(g("sale") - g("invt"), "sale", "invt"), "SmSGA": ok(g("sale") - g("xsga"), "sale", "xsga"),
          "dSdAR": ok(g("sale") - g("rect"), "sale", "rect"), "dGMdS": ok(g("gm") - g("sale"), "sale", "gm")}
    return s.select("T", "FTID", "date", *[clean(e).alias(n) for n, e in vs.items()]).groupBy(*KF).agg(*[last_of(n).alias(n) for n in vs])


@_p("AssetLiquidity", ["AL", "AL2"], -30, ["act", "che", "intan", "gdwl", "at", "MC", "INDM3", "INDM"])
def _al(f):
    al = f.che + 0.75 * (f.act - f.che) - (f.at - nz("gdwl") - nz("intan"))
    return {"AL": null_if(fdiv(al, f.L("at")), excluded()), "AL2": null_if(fdiv(al, f.L("MC")), excluded())}


_p("CashToAssets", ["CtA"], -18, ["che", "at"])(lambda f: {"CtA": fdiv("che", "at")})


@_p("CashBasedOperatingProfitability", ["CBOP"], -30, ["revt", "cogs", "xsga", "xrd", "rect", "invt", "xpp", "drc", "drlt", "ap", "xacc", "at"])
def _cbop(f):
    d = lambda e: nz(f.D(e))
    return {"CBOP": fdiv(f.revt - f.cogs - f.xsga + nz("xrd") - d("rect") - d("invt") - d("xpp") + d(f.drc + f.drlt) + d("ap") + d("xacc"), "at")}


@_b("EarningsSmoothness", ["ES"], {"FT": (-138, 0, ["act", "che", "lct", "dlc", "ib", "dp", "at"])}, n=10)
def _es(x):
    f = Items(-138)
    k = x.gate("EarningsSmoothness")
    s = x.statements().filter(f.inside)
    cf = f.ib - (f.D("act") - f.D("lct") - f.D("che") + f.D("dlc") - f.dp)
    s = s.select("T", "FTID", "date", finite(fdiv("ib", f.L("at"))).alias("e"), cf.alias("cf")).filter("e is not null and cf is not null")
    s = s.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("FTID", "T"))).withColumn("i", F.row_number().over(W.partitionBy("FTID", "T").orderBy(c("date").desc())))
    s = s.filter((c("n") >= k) & (c("i") <= 10))
    return s.groupBy(*KF).agg(fdiv(F.stddev_samp("e"), F.stddev_samp("cf")).alias("ES"))


@_p("HiringRate", ["HR"], -30, ["emp", "INDM3", "INDM"])
def _hr(f):
    h = null_if(fdiv(f.D("emp"), f.emp + f.L("emp")) * 2, excluded())
    return {"HR": F.when(h != 0, h)}


_p("LaborForceEfficiency", ["LFE"], -30, ["sale", "emp"])(lambda f: {"LFE": fdiv(fdiv("sale", "emp"), f.L(fdiv("sale", "emp"))) - 1})
_p("OperatingProfitsToEquity", ["OPoE"], -18, BE_ITEMS + ["xint", "cogs", "xsga", "revt"])(lambda f: {
    "OPoE": F.when(F.coalesce("xint", "cogs", "xsga").isNotNull(), fdiv(f.revt - nz("cogs") - nz("xsga") - nz("xint"), book_equity()))})
_p("OperatingProfitsToAssets", ["OPoA"], -18, ["cogs", "xsga", "revt", "xrd", "at"])(lambda f: {"OPoA": fdiv(f.revt - f.cogs - f.xsga + nz("xrd"), "at")})


@_b("IndustryAdjRealEstateRatio", ["IARER"], {"FT": (-18, 0, ["fatb", "fatl", "ppent", "INDM3"])})
def _iarer(x):
    s = x.statements().filter(Items(-18).inside).withColumn("rer", clean(fdiv(c("fatb") + nz("fatl"), "ppent")))
    g = s.groupBy(*KF).agg(last_of("rer").alias("rer"), last_of("INDM3").alias("INDM3"))
    g = X.attach(g, ["T", "INDM3"], m=F.avg("rer"), n=F.count("INDM3"))
    return g.select(*KF, null_if(c("rer") - c("m"), (c("INDM3") == ESTATE) | (c("n") <= 2)).alias("IARER"))


_p("Tangibility", ["TAN"], -18, ["che", "rect", "invt", "ppegt", "at"])(lambda f: {"TAN": fdiv(f.che + 0.715 * f.rect + 0.547 * f.invt + 0.535 * f.ppegt, "at")})


@_b("WhitedWuIndex", ["WWI"], {"FT": (-30, 0, ["ib", "dp", "at", "dv", "dltt", "INDM3", "INDM", "sale"])})
def _wwi(x):
    f = Items(-30)
    s = x.statements().filter(f.inside)
    y = F.when(c("date") > F.add_months("T", -12), 2).when(c("date") > F.add_months("T", -24), 1)
    ind = s.withColumn("y", y).filter("y is not null and INDM3 is not null").groupBy("T", "INDM3").agg(
        *[F.when(F.count(F.when(c("y") == k, c("sale"))) > 2, F.sum(F.when(c("y") == k, c("sale")))).alias(f"s{k}") for k in (1, 2)])
    s = s.join(ind.select("T", "INDM3", (fdiv("s2", "s1") - 1).alias("isg")), ["T", "INDM3"], "left")
    q = lambda e: fpow(1 + e / 4, 1 / 4) - 1
    v = (-0.091 * q(fdiv(f.ib + f.dp, "at")) - 0.062 * flag(f.dv > 0) + 0.021 * fdiv("dltt", "at") - 0.044 * fln("at") + 0.102 * q(c("isg"))
         - 0.035 * q(fdiv("sale", F.lag("sale").over(fw())) - 1))
    return s.withColumn("v", clean(null_if(v, excluded()))).groupBy(*KF).agg(last_of("v").alias("WWI"))


_p("EarningsToPrice", ["EoP"], -18, ["ib", "MC"])(lambda f: {"EoP": null_if(fdiv("ib", "MC"), f.ib <= 0)})
_p("Leverage", ["Lvrg"], -18, ["dltt", "dlc", "MC"])(lambda f: {"Lvrg": fdiv(f.dltt + f.dlc, "MC")})
_p("PayoutYield", ["PY", "NPY"], -30, ["dvc", "prstkc", "pstkrv", "sstk", "MC"])(lambda f: {
    "PY": fdiv(f.dvc + f.prstkc - f.D("pstkrv"), "MC"), "NPY": fdiv(f.dvc + f.prstkc - f.sstk, "MC")})
_p("ChPPEIA", ["ChPPEIA"], -30, ["ppegt", "invt", "at"])(lambda f: {"ChPPEIA": fdiv(f.D("ppegt") + f.D("invt"), f.L("at"))})
_p("NetFinance", ["NDF", "NEF"], -30, ["dltis", "dltr", "dlcch", "at", "sstk", "prstkc", "dv"])(lambda f: {
    "NDF": fdiv(f.dltis - f.dltr + f.dlcch, _avg2(f, "at")), "NEF": fdiv(nz("sstk") - nz("prstkc") - f.dv, _avg2(f, "at"))})
_p("CapitalTurnover", ["CT"], -30, ["sale", "at"])(lambda f: {"CT": fdiv("sale", f.L("at"))})


@_p("RichardsonVars", ["dNNCWC", "dCOA", "dCOL", "dNNCOA", "dNCOA", "dNCOL", "dNFA", "dSTI", "dLTI", "dCE", "dFL", "TA"], -30,
    ["act", "at", "che", "lct", "dlc", "ivao", "dltt", "lt", "ivst", "pstk", "ceq"])
def _richardson(f):
    coa, col = f.act - f.che, f.lct - nz("dlc")
    nca, ncl = f.at - f.act - nz("ivao"), f.lt - f.lct - nz("dltt")
    any_of = lambda *xs: F.when(F.coalesce(*xs).isNotNull(), sum((nz(x) for x in xs[1:]), nz(xs[0])))
    fin, liab = any_of("ivst", "ivao"), any_of("dltt", "dlc", "pstk")
    parts = {"dNNCWC": coa - col, "dCOA": coa, "dCOL": col, "dNNCOA": nca - ncl, "dNCOA": nca, "dNCOL": ncl, "dNFA": fin - liab,
             "dSTI": f.ivst, "dLTI": f.ivao, "dCE": f.ceq, "dFL": liab, "TA": (nca - ncl) + (coa - col) + (fin - liab)}
    return {k: fdiv(f.D(e), f.L("at")) for k, e in parts.items()}


_p("AssetsTomarket", ["AtM"], -18, ["MC", "at"])(lambda f: {"AtM": fdiv("at", "MC")})
_p("CompositeDebtIssuance", ["CDI"], -78, ["dltt", "dlc"])(lambda f: {"CDI": fln(fdiv(f.dltt + f.dlc, f.L(f.dltt + f.dlc, 5)) - 1)})
_p("RDtoSales", ["RDtS"], -18, ["xrd", "sale"])(lambda f: {"RDtS": null_if(fdiv("xrd", "sale"), f.xrd <= 0)})


@_p("RDtoAssets", ["RDtA"], -66, ["xrd", "at"])
def _rdta(f):
    rc = nz("xrd") + 0.8 * f.L(nz("xrd"), 1) + 0.6 * f.L(nz("xrd"), 2) + 0.4 * f.L(nz("xrd"), 3) + 0.2 * f.L(nz("xrd"), 4)
    return {"RDtA": null_if(fdiv(rc, "at"), (rc <= 0) | f.xrd.isNull())}


@_p("DurationOfEquity", ["DurE"], -30, ["ceq", "ib", "sale", "MC"])
def _dur(f):
    # ten-year fade of growth and profitability, discounted at 12 % (fixed values)
    g, roe, be0 = fdiv("sale", f.L("sale")) - 1, fdiv("ib", f.L("ceq")), f.ceq
    book, bad, pv = be0, be0 <= 0, F.lit(0.0)
    for k in range(1, 11):
        roe = 0.12 + 0.57 * roe
        pv = pv + roe * book * ((k - 58 / 3) / 1.12 ** k)
        g = 0.06 + 0.24 * g
        if k < 10:
            book = be0 * (1 + g)
            bad = bad | (book <= 0)
    return {"DurE": null_if(58 / 3 + fdiv(pv, "MC"), bad)}


@_b("DiscretionaryAccrual", ["DA"], {"FT": (-30, 0, ["act", "che", "lct", "dlc", "txp", "dp", "sale", "at", "rect", "ppegt", "INDM3"])})
def _da(x):
    f = Items(-30)
    lta = f.L("at")
    cols = {"eg": fdiv(accruals(f), lta), "x1": fdiv(F.lit(1.0), lta), "x2": fdiv(f.D("sale") - f.D("rect"), lta), "x3": fdiv("ppegt", lta)}
    s = x.statements().select("T", "FTID", "date", "INDM3", *[F.when(f.inside, clean(e)).alias(n) for n, e in cols.items()])
    ok = F.col("INDM3").isNotNull()
    for n in cols:
        ok = ok & c(n).isNotNull()
    g = s.filter(ok).groupBy(*KF).agg(*[last_of(n).alias(n) for n in [*cols, "INDM3"]])
    g = g.select("T", "FTID", "INDM3", *[finite(n).alias(n) for n in cols]).filter(ok)
    xs = ["x1", "x2", "x3"]
    return residuals(g, group_ols(g, ["T", "INDM3"], "eg", xs), ["T", "INDM3"], "eg", xs, "DA").select(*KF, "DA")


def _prices_at(x: SignalContext, st: DataFrame, start: int, cols, shift: int, lag: int) -> DataFrame:
    """Statement rows with prices as of (fiscal year end + shift) and lag months earlier, from [T+start, T).

    One month table per security serves both points: prices are looked up by an as-of join on
    (security, date), which is independent of T except for the two window bounds checked after.
    """
    p = x.dt.select("DTID", "date", *cols).withColumn("_pd", c("date"))
    st = st.withColumn("_d", F.least(F.add_months("FinYearEnd", shift), F.date_sub("T", 1)))
    st = asof_join(st, p.withColumnRenamed("date", "_d"), "_d", "DTID")
    q = p.select("DTID", F.add_months("date", lag).alias("_d"), c("_pd").alias("_qd"), *[c(v).alias(v + "_lag") for v in cols])
    st = st.withColumn("_d", F.add_months("FinYearEnd", shift))
    st = asof_join(st, q, "_d", "DTID", tie="_qd")
    lo = F.add_months("T", start)
    for v in cols:
        st = st.withColumn(v, F.when(c("_pd") >= lo, c(v))).withColumn(v + "_lag", F.when((c("_qd") >= lo) & (c("_qd") < c("T")), c(v + "_lag")))
    return st.drop("_pd", "_qd", "_d")


def _last_at(points: DataFrame, panel: DataFrame, date, cols) -> DataFrame:
    """(DTID, _g): per security its points in order, each with the last panel row whose `date` is at or before it; points without any are left out.

    A security has a few points, at most one per calendar day; every panel row goes to the first point at or after it, so the aggregate
    keeps one row per point and no panel row is ordered.
    """
    pts = points.filter("DTID is not null and _d is not null").groupBy("DTID").agg(F.sort_array(F.collect_set("_d")).alias("_ds"))
    p = panel.select("DTID", "date", *cols, date.alias("_at")).join(pts, "DTID")
    p = p.withColumn("_d", F.get(F.filter("_ds", lambda d: d >= c("_at")), F.lit(0))).filter("_d is not null")
    g = p.groupBy("DTID", "_d").agg(F.max("date").alias("pd"), *[F.max_by(v, "date").alias(v) for v in cols])
    # a point without rows of its own takes the nearest earlier one's
    g = g.groupBy("DTID").agg(F.sort_array(F.collect_list(F.struct("_d", F.struct("pd", *cols).alias("_v")))).alias("_g"))
    return pts.join(g, "DTID").select("DTID", "_g")


def _found(g, d):
    """The row for point d among a security's found points."""
    return F.try_element_at(F.filter(g, lambda x: x["_d"] <= d), F.lit(-1))["_v"]


@_b("EarningsFeatures", ["EPer", "EPred", "ETime", "ECon"], {"FT": (-138, 0, ["epspx", "ib", "MC", "DTID", "FinYearEnd", "ajex"]), "dt": (-161, 0, ["RI"])}, n=10)
def _features(x):
    """Prices are looked up per statement, before it is copied to the grid dates it is seen at; what is copied holds eight columns."""
    n, dt = x.gate("EarningsFeatures"), x.dt.select("DTID", "date", "RI")
    ft = stage(x.sources["FT"].select("FTID", "DTID", "date", "FinYearEnd", "ib", "MC", finite(fdiv("epspx", "ajex")).alias("eps")))
    ft = ft.withColumn("_d", F.add_months("FinYearEnd", 3))
    days = F.array(*[F.lit(d) for d in x.grid.dates()])
    early = F.filter(days, lambda t: (t > c("date")) & (t <= c("_d")))  # grid dates that see a statement before its price date
    pts = ft.select("DTID", F.explode(F.concat(F.array("_d"), F.transform(early, lambda t: F.date_sub(t, 1)))).alias("_d"))
    now, lag = _last_at(pts, dt, c("date"), ["RI"]), _last_at(ft.select("DTID", "_d"), dt, F.add_months("date", 15), ["RI"])
    ft = ft.join(now.withColumnRenamed("_g", "_gn"), "DTID", "left").join(lag.withColumnRenamed("_g", "_gl"), "DTID", "left")
    ft = ft.select("FTID", "DTID", "date", "FinYearEnd", "ib", "MC", "eps", "_d", _found("_gn", c("_d")).alias("_p"), _found("_gl", c("_d")).alias("_q"),
                   F.when(F.size(early) > 0, F.transform(early, lambda t: F.struct(t.alias("T"), _found("_gn", F.date_sub(t, 1)).alias("p")))).alias("_e"))
    s = fiscal_snapshot(ft, x.dt, x.grid, -138, 0, mc_start=x.mc_start)
    s = s.withColumn("_live", F.max("date").over(W.partitionBy("T", "DTID"))).filter(c("DTID").isNotNull() & (c("_live") > F.add_months("T", -18)))
    p = F.when(c("T") > c("_d"), c("_p")).otherwise(F.get(F.filter("_e", lambda e: e["T"] == c("T")), F.lit(0))["p"])
    lo = F.add_months("T", -161)
    ri, ri_lag = F.when(p["pd"] >= lo, p["RI"]), F.when((c("_q.pd") >= lo) & (c("_q.pd") < c("T")), c("_q.RI"))
    w = W.partitionBy("FTID", "T").orderBy("FinYearEnd")
    s = s.select(*KF, "FinYearEnd", "eps", finite(fdiv("ib", "MC")).alias("earn"), finite(fdiv(ri, ri_lag) - 1).alias("ret")).withColumn("l_eps", F.lag("eps").over(w))
    both, pair = c("earn").isNotNull() & c("ret").isNotNull(), c("eps").isNotNull() & c("l_eps").isNotNull()
    s = s.withColumns({v: F.when(both, c(v)) for v in ("earn", "ret")} | {v: F.when(pair, c(v)) for v in ("eps", "l_eps")})
    g = s.groupBy(*KF).agg(*_side_sums(), F.count("eps").alias("ne"), F.covar_pop("l_eps", "l_eps").alias("exx"), F.covar_pop("l_eps", "eps").alias("exy"), F.covar_pop("eps", "eps").alias("eyy"))
    slope = F.coalesce(c("exy") / F.when(c("exx") > 0, c("exx")), F.lit(0.0))
    g = _lines(g.withColumn("_b", slope)).filter((c("ne") >= n) | (c("n") >= n))
    a, e = c("ne") >= n, c("n") >= n
    return g.select(*KF, F.when(a, c("_b")).alias("EPer"), F.when(a, F.greatest(c("eyy") - c("_b") * c("exy"), F.lit(0.0)) * c("ne")).alias("EPred"), *[F.when(e, c(v)).alias(v) for v in ("ETime", "ECon")])


def _side_sums():
    """Aggregates of earn and ret by the sign of the return; rows carry both or neither."""
    aggs = [F.count("earn").alias("n"), F.var_pop("earn").alias("vy")]
    for k, side in ((0, c("ret") >= 0), (1, c("ret") < 0)):
        x, y = F.when(side, c("ret")), F.when(side, c("earn"))
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"x{k}"), F.avg(y).alias(f"y{k}"), F.var_pop(x).alias(f"vx{k}"), F.var_pop(y).alias(f"vy{k}"), F.covar_pop(x, y).alias(f"xy{k}")]
    return aggs


def _signed_lines(s):
    return _lines(s.groupBy(*KF).agg(*_side_sums()))


def _lines(g):
    """earn on ret with own constant and slope for losses: two separate lines, so two close returns on one side cost no digits.

    A side with a single return takes the other side's slope.
    """
    g = g.withColumns({f"b{k}": F.when(c(f"vx{k}") > 0, c(f"xy{k}") / c(f"vx{k}")) for k in (0, 1)})
    g = g.withColumns({"s0": F.coalesce("b0", "b1"), "s1": F.coalesce("b1", "b0")})
    left = sum(F.coalesce(c(f"n{k}") * F.greatest(c(f"vy{k}") - F.coalesce(c(f"b{k}") * c(f"xy{k}"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for k in (0, 1))
    d = (c("y1") - c("s1") * c("x1")) - (c("y0") - c("s0") * c("x0"))
    g = g.withColumn("d", d).withColumn("ETime", 1 - left / F.when(c("vy") > 0, c("vy") * c("n")))
    return g.withColumn("ECon", (c("d") + c("s0")) / F.when(c("d") != 0, c("d")))


@_b("IntangibleReturn", ["IntanRet"], {"FT": (-78, 0, BE_ITEMS + ["MC", "DTID", "FinYearEnd"]), "dt": (-101, 0, ["RI", "PRC"])}, n=6)
def _intan(x):
    s = x.statements().filter(Items(-78).inside).withColumn("be", book_equity()).withColumn("bm", finite(fdiv("be", "MC")))
    s = s.filter("be is not null and bm is not null and DTID is not null")
    s = s.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("FTID", "T"))).filter(c("n") >= x.gate("IntangibleReturn"))
    s = _prices_at(x, s.select("T", "FTID", "DTID", "FinYearEnd", "be", "bm"), -101, ["RI", "PRC"], 0, 12)
    w = W.partitionBy("FTID", "T").orderBy("FinYearEnd")
    s = s.withColumn("r12", fln(fdiv("RI", "RI_lag"))).withColumn("br", c("r12") - fln(fdiv("PRC", "PRC_lag")))
    L = lambda v, k: F.lag(v, k).over(w)
    r5 = sum((L("r12", k) for k in range(1, 5)), c("r12"))
    rb = sum((L("br", k) for k in range(1, 6)), fdiv("be", L("be", 5)))
    s = s.select("T", "FTID", "FinYearEnd", finite(r5).alias("r5"), finite(fln(L("bm", 5))).alias("bm5"), finite(rb).alias("rb5"))
    g = s.filter("r5 is not null and bm5 is not null and rb5 is not null").groupBy(*KF).agg(*[F.max_by(v, "FinYearEnd").alias(v) for v in ("r5", "bm5", "rb5")])
    return residuals(g, group_ols(g, "T", "r5", ["bm5", "rb5"]), "T", "r5", ["bm5", "rb5"], "IntanRet").select(*KF, "IntanRet")
