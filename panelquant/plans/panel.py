"""Model-table assembly: returns, universe, ranks, market series, enrichment."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import fdiv, month_no, month_start, nz
from panelquant.functions.stage import stage
from panelquant.operators import xsection as X
from panelquant.operators.asof import Agg, Grid, asof_join, last_of, win_agg
from panelquant.operators.series import ewma_path

BY = ("date", "region")


def forward_returns(panel: DataFrame, pairs: DataFrame, stale_days: int = 7, price: str = "RI") -> DataFrame:
    """(DTID, date, r): last price before the end over last price before the start, minus one.

    `pairs` has one row (start, end) per period.  Ids need a row in the stale_days before the
    start.  Each period is expanded to the calendar months it touches, so the panel meets it in
    an equi-join; the id partitioning is set first and kept to the aggregate.
    """
    lo = F.date_sub("start", stale_days)
    w = pairs.select("start", "end", lo.alias("lo"), F.explode(F.sequence(month_no(lo), month_no("end"))).alias("mno"))
    p = panel.select("DTID", "date", price).repartition("DTID").withColumn("mno", month_no("date"))
    j = p.join(F.broadcast(w), "mno").filter((F.col("date") >= F.col("lo")) & (F.col("date") < F.col("end")))
    before = F.col("date") < F.col("start")
    g = j.groupBy("start", "DTID").agg(last_of(price).alias("b"), last_of(price, cond=before).alias("a"), F.count(F.when(before, 1)).alias("n"))
    return g.filter("n > 0").select("DTID", F.col("start").alias("date"), (fdiv("b", "a") - 1).alias("r"))


# thresholds by era: before first year, winsor fraction (fixed values)
ERAS = ((1990, 0.001), (2000, 0.0001))
MAX_RETURN, SPIKE, BACK = 20.0, 3.0, 1.5


def clean_returns(ret: DataFrame, by=("date",), eras=ERAS, cap: float = MAX_RETURN, spike: float = SPIKE, back: float = BACK) -> DataFrame:
    """Era-dependent winsorising, absurd values dropped, spikes that revert within a period dropped.

    The reversal rule looks back first and forward on the result of that, as two passes of
    one window per id (one row per period, so bounded by the grid).
    """
    by = list(by)
    specs = {}
    for i, (_, q) in enumerate(eras):
        specs[f"_l{i}"], specs[f"_h{i}"] = ("r", q), ("r", 1 - q)
    d = X.with_quantiles(ret, by, specs)
    x = F.col("r")
    for i, (y, _) in reversed(list(enumerate(eras))):
        x = F.when(F.year("date") < y, F.least(F.greatest("r", F.col(f"_l{i}")), F.col(f"_h{i}"))).otherwise(x)
    d = d.withColumn("r", F.when(x <= cap, x)).select(*ret.columns)
    w = W.partitionBy("DTID").orderBy("date")

    def revert(df, other):
        o, r = F.col("_o"), F.col("r")
        bad = ((r > spike) | (o > spike)) & ((1 + o) * (1 + r) < back)
        return df.withColumn("_o", other).withColumn("r", F.when(~F.coalesce(bad, F.lit(False)), r)).drop("_o")

    # both neighbours are read before either rule changes a value
    d = d.withColumn("_f", F.lead("r").over(w))
    d = revert(d, F.lag("r").over(w))
    return revert(d, F.col("_f")).drop("_f").select(*ret.columns)


def characteristics(panel: DataFrame, grid: Grid, coid: str = "FTID", min_obs: int = 50, recent_days: int = 7) -> DataFrame:
    """(date, DTID, region, MC, PRC, RI, COID, VOL): last values over 12 months and mean traded value."""
    p = panel.filter("PRC is not null and MC is not null").select("DTID", "date", "MC", "PRC", "RI", "region", coid, (F.col("VOL") * F.col("PRC")).alias("_v"), F.col("date").alias("_day"))
    last = {"MC": "MC", "PRC": "PRC", "RI": "RI", "COID": coid, "region": "region", "_mx": "_day"}
    g = win_agg(p, grid, {**{n: Agg("last", c, -12) for n, c in last.items()}, "_n": Agg("n", "_v", -12), "_avg": Agg("avg", "_v", -12)})
    return g.filter(F.col("_mx") > F.date_sub("T", recent_days)).select(
        F.col("T").alias("date"), "DTID", "region", "MC", "PRC", "RI", "COID", F.when(F.col("_n") >= min_obs, F.col("_avg") / 1e6).alias("VOL"))


# lowest price by region (fixed values)
PRICE_FLOOR = {"USA": 1.0, "North America": 1.0, "Japan": 1.0, "Europe": 1.0, "Asia Pacific": 0.1}


def eligible(chars: DataFrame, mc_lim: float = 0.05, vol_lim: float = 0.05, price: dict | None = None, ri_lim: float = 0.0003) -> DataFrame:
    """Size, volume and price rules on cumulative shares per (date, region)."""
    price = PRICE_FLOOR if price is None else price
    d = stage(chars.filter("PRC is not null and MC is not null").na.fill(0.0, ["RI", "VOL"]))  # ordering by ranges reads it twice
    d = X.cumulative_share(d, "MC", BY, "DTID", "_mc")
    d = X.cumulative_share(d, "VOL", BY, "DTID", "_vol")
    floor = F.create_map(*[F.lit(x) for kv in price.items() for x in kv])
    bad = ((F.col("_mc") <= mc_lim) | ((F.col("_vol") <= vol_lim) & ((F.col("_vol") != 0) | (F.col("_mc") <= mc_lim * 2)))
           | (F.col("PRC") <= F.coalesce(F.try_element_at(floor, F.col("region")), F.lit(1.0))))
    return d.filter(F.col("RI") >= ri_lim).withColumn("Eligible", ~F.coalesce(bad, F.lit(False))).select(
        "date", "DTID", "COID", "region", "MC", "VOL", "PRC", "Eligible")


def universe(panel: DataFrame, grid: Grid, mc_lim=0.05, vol_lim=0.05, price_lim=None, idx_lim=0.0003, coid="FTID", min_obs=50) -> DataFrame:
    return eligible(characteristics(panel, grid, coid, min_obs), mc_lim, vol_lim, price_lim, idx_lim)


def one_per_firm(df: DataFrame, firm: str = "COID", linked: str = "FTID", date: str = "date", tie: str = "DTID") -> DataFrame:
    """One security per firm and date, linked ones first; rows without firm id are all kept.

    Null firm ids never enter the ranking: they may be most of the table and would share one
    window partition.  A firm has a handful of share classes, and a minimum over (rank, tie)
    is map-side combined, so a firm with very many rows is harmless too.
    """
    rank = F.struct(F.when(F.col(linked).isNull(), 1).otherwise(0).alias("k"), F.col(tie).alias("t"))
    df = stage(df)
    has = df.filter(F.col(firm).isNotNull())
    best = has.groupBy(firm, date).agg(F.min(rank).alias("_b")).select(firm, date, F.col("_b.t").alias(tie))
    return has.join(best, [firm, date, tie], "left_semi").unionByName(df.filter(F.col(firm).isNull()))


def model_table(ret: DataFrame, signals: DataFrame, uni: DataFrame, normalize: str = "Quantile", exclude=(), only_eligible: bool = True, by=BY) -> DataFrame:
    """Eligible securities with forward return and cross-sectionally normalised signals."""
    u = uni.filter("Eligible") if only_eligible else uni
    d = u.select("date", "DTID", "region", "MC", "COID").join(ret.select("date", "DTID", "r"), ["date", "DTID"], "left")
    s = signals.withColumnRenamed("T", "date") if "T" in signals.columns else signals
    d = d.join(s, ["date", "DTID"], "left")
    d = one_per_firm(d).drop("COID", "FTID").withColumn("r", nz("r"))
    names = [c for c in d.columns if c not in {"date", "DTID", "region", "MC", "r", *exclude}]
    if normalize == "Quantile":
        return X.rank_pct(d, names, by)
    if normalize == "Standardize":
        return X.standardize(d, names, by)
    if normalize == "Standardize_winsor":
        return X.winsor_standardize(d, names, by)
    raise ValueError(f"unknown normalisation {normalize!r}")


# decay per cent -> column stem (fixed values)
MARKET_DECAYS = (10, 6, 4, 1, 0.1)


def market_mean(panel: DataFrame, decays=MARKET_DECAYS) -> DataFrame:
    """Equal-weight daily mean per region, exponentially averaged, dated on the next trading day."""
    d = panel.filter("r is not null").groupBy("region", "date").agg(F.avg("r").alias("EW"))
    names = {f"MktAvg{x}_EW": x / 100 for x in decays}
    e = ewma_path(d, "region", "date", "EW", names)
    w = W.partitionBy("region").orderBy("date")
    return e.withColumn("date", F.lead("date").over(w)).filter("date is not null")


def daily_returns(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Daily returns with the previous row's market value."""
    w = W.partitionBy("DTID").orderBy("date")
    p = panel.filter(F.col("date") <= F.lit(end).cast("date")).select("DTID", "date", "region", "r", F.lag("MC").over(w).alias("MC"))
    return p.filter(F.col("r").isNotNull() & (F.col("date") >= F.lit(start).cast("date")))


def realised_variance(panel: DataFrame, min_obs: int = 15) -> DataFrame:
    """(date, DTID, var, vol): sum of squared daily returns over the month starting at date."""
    g = panel.filter("r is not null").groupBy(month_start(month_no("date")).alias("date"), "DTID").agg(F.sum(F.col("r") * F.col("r")).alias("var"), F.count("r").alias("n"))
    return g.filter(F.col("n") >= min_obs).select("date", "DTID", "var", F.sqrt("var").alias("vol"))


def monthly_returns(ret: DataFrame, uni: DataFrame, start: str, end: str) -> DataFrame:
    """Period returns with the region and market value of the universe table."""
    d = ret.join(uni.select("date", "DTID", "region", "MC"), ["date", "DTID"])
    return d.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def enrich(model: DataFrame, vol_vars, mkt: DataFrame, mkt_vars, adjust: str = "divide", scale: float = 0.11, rescale_mean: bool = True,
           unit: float = 0.022, anchor: str = "EWMAVol6", by=BY) -> DataFrame:
    """Raw and relative volatility features, return scale, scaled return, market averages."""
    by = list(by)
    d = X.fill_group_mean(model, vol_vars, by)
    d = X.attach(d, by, **{f"{v}__g": F.avg(v) for v in vol_vars})
    raw = {f"{v}_raw": F.col(v) / unit for v in vol_vars}
    mean = {f"{v}_mean": F.col(f"{v}__g") / unit for v in vol_vars}
    rel = {v: fdiv(v, f"{v}__g") for v in vol_vars}
    d = d.withColumns(raw).withColumns(mean).withColumns(rel).drop(*[f"{v}__g" for v in vol_vars])
    d = d.withColumn("r_raw", F.col("r")).withColumn("r_scale", F.col(f"{anchor}_mean") * scale)
    if adjust == "divide":
        d = d.withColumn("r", fdiv("r", "r_scale"))
    elif adjust == "standardize":
        d = X.median_scale(d.drop("r_scale"), "r", by)
    d = asof_join(d, mkt.select("date", "region", *mkt_vars), "date", "region")
    return d.withColumns({v: fdiv(v, "r_scale") for v in mkt_vars}) if rescale_mean else d


def attach_market_value(ft: DataFrame, panel: DataFrame, major: DataFrame | None = None, factor: bool = False) -> DataFrame:
    """Statements with the market value (and adjustment factor) as of the fiscal year end.

    With `major` (DTID, FTID, MAJOR) the market row is chosen per firm and date, major line first,
    and its security id overwrites the statement's; otherwise the statement's own id is used.
    """
    cols = ["MC", "AF"] if factor else ["MC"]
    p = panel.select("DTID", F.col("date").alias("FinYearEnd"), *cols).dropna()
    if factor:
        p = p.withColumnRenamed("AF", "ajex")
    if major is None:
        return asof_join(ft.drop("MC", "ajex"), p, "FinYearEnd", "DTID")
    m = p.join(major.dropna(), "DTID")
    vals = [c for c in p.columns if c not in ("DTID", "FinYearEnd")]
    first = F.struct(F.when(F.col("MAJOR") == "Y", 0).otherwise(1), F.col("DTID"))
    m = m.groupBy("FTID", "FinYearEnd").agg(F.min_by(F.struct(F.col("DTID").alias("_id"), *vals), first).alias("_v"))
    m = m.select("FTID", "FinYearEnd", "_v._id", *[f"_v.{c}" for c in vals])
    out = asof_join(ft.drop("MC", "ajex"), m, "FinYearEnd", "FTID")
    return out.withColumn("DTID", F.coalesce("_id", "DTID")).drop("_id")

