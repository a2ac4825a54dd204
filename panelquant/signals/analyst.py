"""Analyst-forecast signals from the monthly summary (FPI 1 = next year, 0 = long term) and from
individual recommendations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import clean, fdiv, flag
from panelquant.operators import xsection as X
from panelquant.operators.asof import expiry, grid_index, last_of, levels, prune, snapshot
from panelquant.signals.base import SignalClass, SignalContext, register

c = F.col
K = ["T", "DTID"]


def resolve_ids(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Use the given id column as DTID, drop rows without id or date."""
    if id_col:
        df = df.withColumn("DTID", c(id_col)).drop(id_col)
    return df.filter("DTID is not null and date is not null")


def _cls(name, outputs, inputs, depends=(), **min_obs):
    def deco(fn):
        register(SignalClass(name, list(outputs), inputs, list(depends), "DTID", min_obs, build=fn))
        return fn
    return deco


def _summary(x: SignalContext, months: int, fpi: int) -> DataFrame:
    # FPI is filtered before the fan-out and reaches the scan
    return snapshot(x.sources["IBESsum"].filter(c("FPI") == fpi), x.grid, -months, 0)


def _lagged(s: DataFrame, col: str, by: str = "DTID"):
    return F.lag(col).over(W.partitionBy(by, "T").orderBy("date"))


def _last(df: DataFrame, **exprs) -> DataFrame:
    d = df.select(*K, "date", *[clean(e).alias(n) for n, e in exprs.items()])
    return d.groupBy(*K).agg(*[last_of(n).alias(n) for n in exprs])


@_cls("IBESForecastChange", ["DF", "UF"], {"IBESsum": (-2, 0, ["MEANEST", "FPI", "TICKER"])})
def _change(x):
    s = _summary(x, 2, 1)
    s = s.withColumn("ch", c("MEANEST") - _lagged(s, "MEANEST"))
    return _last(s, DF=flag(c("ch") < 0), UF=flag(c("ch") > 0))


@_cls("IBESForecastDispersion", ["FD"], {"IBESsum": (-1, 0, ["STDEV", "MEANEST", "NUMEST", "FPI"])}, n=3)
def _dispersion(x):
    v = F.when(c("MEANEST") == 0, F.lit(float("inf"))).otherwise(fdiv("STDEV", "MEANEST"))
    return _last(_summary(x, 1, 1), FD=F.when(F.coalesce(c("NUMEST") < x.gate("IBESForecastDispersion"), F.lit(False)), None).otherwise(v))


@_cls("IBESAnalystsCoverage", ["AC"], {"IBESsum": (-1, 0, ["NUMEST", "FPI"])})
def _coverage(x):
    return _last(_summary(x, 1, 1), AC=c("NUMEST").cast("double"))


@_cls("IBESDispLT", ["DispLT"], {"IBESsum": (-1, 0, ["STDEV", "NUMEST", "FPI"])}, n=3)
def _disp_lt(x):
    return _last(_summary(x, 1, 0), DispLT=F.when(F.coalesce(c("NUMEST") < x.gate("IBESDispLT"), F.lit(False)), None).otherwise(c("STDEV")))


def _statement_last(x: SignalContext, start: int, **exprs) -> DataFrame:
    s = x.statements().filter(c("date") >= F.add_months("T", start))
    return s.select(*K, "date", *[e.alias(n) for n, e in exprs.items()]).groupBy(*K).agg(*[last_of(n).alias(n) for n in exprs])


@_cls("IBESDispLTST", ["DispLTST"], {"FT": (-18, 0, ["epspi", "DTID"]), "IBESsum": (-1, 0, ["MEDEST", "FPI"])})
def _disp_ltst(x):
    s = _last(_summary(x, 1, 1), s=c("MEDEST")).join(_last(_summary(x, 1, 0), l=c("MEDEST")), K).join(_statement_last(x, -18, e=c("epspi")), K)
    return s.select(*K, clean(c("l") - fdiv(100 * (c("s") - c("e")), F.abs("e"))).alias("DispLTST"))


@_cls("ChangesInAnalystFC", ["dAEF"], {"IBESsum": (-2, 0, ["MEANEST", "MEDEST", "FPI", "TICKER"])})
def _daef(x):
    s = _summary(x, 2, 1)
    prev = F.lag("MEDEST").over(W.partitionBy("TICKER", "T").orderBy("DTID", "date"))
    s = s.withColumn("ch", c("MEANEST") - _lagged(s, "MEANEST")).withColumn("pm", prev)
    return _last(s, dAEF=fdiv("ch", F.abs("MEDEST") / 2 + F.abs("pm") / 2))


@_cls("LongtermGrowthForecasts", ["LTGrF"], {"IBESsum": (-1, 0, ["MEDEST", "FPI"])})
def _ltg(x):
    return _last(_summary(x, 1, 0), LTGrF=c("MEDEST"))


@_cls("IBESChForecastAccrual", ["ChiFA"], {"FT": (-18, 0, ["at", "sale", "DTID"]), "IBESsum": (-2, 0, ["MEANEST", "FPI", "TICKER"])}, ["Accruals"], at=50, sale=25)
def _chifa(x):
    s = _summary(x, 2, 1)
    s = _last(s.withColumn("ch", c("MEANEST") - _lagged(s, "MEANEST")), ch=c("ch"))
    ft = x.statements().filter(c("date") >= F.add_months("T", -18))
    ft = ft.groupBy("T", "FTID").agg(last_of("at").alias("at"), last_of("sale").alias("sale"), last_of("DTID").alias("DTID"))
    ft = X.with_quantiles(ft.join(x.cls("Accruals"), ["T", "FTID"]), ["T"], {"med": ("Accr", 0.5)})
    small = F.coalesce((c("at") < x.gate("IBESChForecastAccrual", "at")) | (c("sale") < x.gate("IBESChForecastAccrual", "sale")), F.lit(False))
    # several firms of one security: the last non-null in firm order
    a = ft.withColumn("a", F.when(~small, c("Accr") - c("med"))).groupBy(*K).agg(F.max_by("a", F.when(c("a").isNotNull(), c("FTID"))).alias("a"))
    j = s.join(a, K)
    return j.select(*K, (flag((c("a") < 0) & (c("ch") > 0)) - flag((c("a") > 0) & (c("ch") < 0))).alias("ChiFA"))


def _last_price(x):
    return snapshot(x.dt, x.grid, -1, 0, ["PRC"]).groupBy(*K).agg(last_of("PRC").alias("PRC")).filter("PRC is not null")


@_cls("IBESChAnalystValue", ["AV"], {"FT": (-30, 0, ["bkvlps", "DTID"]), "dt": (-1, 0, ["PRC"]), "IBESsum": (-1, 0, ["MEDEST", "FPI"])})
def _av(x):
    st = x.statements().filter(c("date") >= F.add_months("T", -30))
    prev = F.lag("bkvlps").over(W.partitionBy("FTID", "T").orderBy("date"))
    be = st.withColumn("be", F.coalesce((c("bkvlps") + prev) / 2, c("bkvlps"))).groupBy(*K).agg(last_of("be").alias("be"))
    j = _last(_summary(x, 1, 1), m=c("MEDEST")).join(be, K).join(_last_price(x), K)
    froe = fdiv("m", "be")
    f = F.when(~F.coalesce((froe > 1) | (c("be") < 0), F.lit(False)), froe)
    av = (1 + (f - 0.1) / 1.1 + (f - 0.1) / (1.1 * 0.1)) * fdiv("be", "PRC")
    return j.select(*K, clean(av).alias("AV"))


@_cls("ChangeInRecommendation", ["ChR"], {"IBESdet": (-60, 0, ["TICKER", "ESTIMID", "ITEXT"])})
def _chr(x):
    """Mean change of the analysts' last opinions, as runs of validity summed over their ends: no opinion is copied to the dates it holds for."""
    d = x.sources["IBESdet"]
    order = c("seq") if "seq" in d.columns else c("ITEXT")
    # one opinion per analyst, ticker and day, chosen before the fan-out by a combinable maximum
    d = d.groupBy("TICKER", "ESTIMID", "date").agg(F.max_by(F.struct("DTID", "ITEXT"), order).alias("_v"))
    d = d.select("TICKER", "ESTIMID", "_v.DTID", "date", "_v.ITEXT")
    d = prune(d, x.grid, -60, 0)
    w = W.partitionBy("TICKER", "ESTIMID").orderBy("date")
    known = F.last(F.when(c("DTID").isNotNull(), F.struct("DTID", "date")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = d.select("date", "ITEXT", known.alias("id"), F.lag("ITEXT").over(w).alias("pt"), F.lag("date").over(w).alias("pd"), F.lead("date").over(w).alias("nd"))
    # an opinion is the analyst's last one at the grid positions [a, b); inside, it is new before `new`, has a predecessor before `old`, a security before `idle`
    tomorrow = lambda e: grid_index(x.grid, F.date_add(e, 1))
    gone = lambda e, m: grid_index(x.grid, expiry(e, m))
    d = d.withColumns({"a": tomorrow(c("date")), "b": F.least(gone(c("date"), 60), tomorrow(c("nd")))}).filter("a < b")
    d = d.withColumns({"new": gone(c("date"), 1), "old": gone(c("pd"), 60), "idle": gone(c("id.date"), 60)})
    strong = F.coalesce(c("ITEXT") == "STRONG BUY", F.lit(False))
    after = F.when(strong & ~F.coalesce(c("pt") == "STRONG BUY", F.lit(False)), 1).when(F.coalesce(c("ITEXT") != c("pt"), F.lit(False)), -1).otherwise(0)
    inner = [F.when((c(k) > c("a")) & (c(k) < c("b")), c(k)) for k in ("new", "old", "idle")]
    cuts = F.array_sort(F.array_distinct(F.array_compact(F.array("a", "b", *inner))))
    d = d.select("id", "new", "old", "idle", after.alias("after"), strong.cast("int").alias("first"), cuts.alias("cuts"))
    d = d.select("*", F.explode(F.arrays_zip(F.slice("cuts", 1, F.size("cuts") - 1).alias("a"), F.slice("cuts", 2, F.size("cuts") - 1).alias("b"))).alias("run"))
    rec = F.when(c("run.a") >= c("new"), 0).when(c("run.a") < c("old"), c("after")).otherwise(c("first"))
    d = d.select(F.when(c("run.a") < c("idle"), c("id.DTID")).alias("DTID"), "run", rec.alias("rec"))
    ends = F.explode(F.array(F.struct(c("run.a").alias("i"), F.lit(1).alias("n"), c("rec").alias("s")), F.struct(c("run.b").alias("i"), F.lit(-1).alias("n"), (-c("rec")).alias("s"))))
    e = d.select("DTID", ends.alias("e")).select("DTID", "e.*")
    return levels(e, x.grid, "DTID", "i", ["n", "s"], "n").select(*K, (c("s") / c("n")).alias("ChR"))


@_cls("EarningsForecastToPrice", ["EFoP"], {"dt": (-1, 0, ["PRC"]), "IBESsum": (-1, 0, ["MEDEST", "FPI"])})
def _efop(x):
    return _last(_summary(x, 1, 1), m=c("MEDEST")).join(_last_price(x), K).select(*K, fdiv("m", "PRC").alias("EFoP"))
