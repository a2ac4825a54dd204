"""Raw vendor files to clean keyed panels, as compositions of the cleaning and as-of operators."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import nz
from panelquant.operators import clean as C
from panelquant.operators.asof import asof_join, asof_series, interval_join, overlap_join, valid_at
from panelquant.operators.series import running_product
from panelquant.sources.io import parse_date

c = F.col
CPI_BASE = 77.8  # 1980 price level, fixed value


def inflation(raw: DataFrame, date="DATE", value="CPIAUCNS") -> DataFrame:
    return raw.select(parse_date(date, "dd/MM/yyyy").alias("date"), (c(value) / CPI_BASE).alias("CPI"))


def _keep_last(df: DataFrame, key, order) -> DataFrame:
    """One row per key, the largest in the given order (aggregate, no sort of the group); columns nobody reads are not carried."""
    rest = [x for x in df.columns if x not in key]
    d = df.withColumn("_o", F.struct(*order))
    return d.groupBy(*key).agg(*[F.max_by(x, "_o").alias(x) for x in rest])


# security and issuer conditions of the daily US panel (fixed values)
EXCHANGES, SHARE = ("Q", "N", "A"), {"sharetype": "NS", "securitytype": "EQTY", "securitysubtype": "COM"}
TRADING, ISSUER = {"conditionaltype": "RW", "tradingstatusflg": "A"}, ("ACOR", "CORP")


def daily_panel(raw: DataFrame, issue: DataFrame, issuer: DataFrame, region: str = "USA") -> DataFrame:
    """Daily US panel: adjustment factor, firm value, validity intervals, cumulative return index."""
    d = raw.select(c("permco").alias("PERMCO"), c("permno").cast("string").alias("DTID"), parse_date("yyyymmdd", "yyyyMMdd").alias("date"), F.abs("dlyprc").alias("PRC"),
                   c("shrout").alias("SHROUT"), c("dlyret").cast("double").alias("r"), c("dlyvol").alias("VOL"), c("disfacshr").alias("DISFACSHR"),
                   c("dlybid").alias("BID"), c("dlyask").alias("ASK"), c("dlylow").alias("L"), c("dlyhigh").alias("H"))
    d = C.firm_market_value(d.withColumn("MCshare", c("PRC") * c("SHROUT") / 1000), "PERMCO").drop("MCshare")
    d = C.share_factor(d).drop("DISFACSHR")
    ok = c("primaryexch").isin(*EXCHANGES)
    for k, v in {**TRADING, **SHARE}.items():
        ok = ok & (c(k) == v)
    sec = issue.filter(ok).select(c("permno").cast("string").alias("DTID"), c("secinfostartdt").alias("s1"), c("secinfoenddt").alias("e1"), F.lit(True).alias("in1"))
    iss = issuer.filter((c("usincflg") == "Y") & c("issuertype").isin(*ISSUER)).select(c("permco").alias("PERMCO"), c("issinfostartdt").alias("s2"), c("issinfoenddt").alias("e2"), F.lit(True).alias("in2"))
    for tbl, by, s, e, flag in ((sec, "DTID", "s1", "e1", "in1"), (iss, "PERMCO", "s2", "e2", "in2")):
        d = valid_at(d, tbl, "date", by, s, e).filter(c(flag)).drop(flag)
    d = _keep_last(d, ["DTID", "date"], ["PERMCO", "PRC"])
    w = W.partitionBy("DTID").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("region", F.lit(region)).withColumn("RI", running_product(1 + nz("r"), w))


def monthly_panel(raw: DataFrame, region: str = "USA") -> DataFrame:
    """Monthly US panel of common shares on the main exchanges."""
    ok = c("primaryexch").isin(*EXCHANGES) & (c("usincflg") == "Y") & c("issuertype").isin(*ISSUER)
    for k, v in {**TRADING, **SHARE}.items():
        ok = ok & (c(k) == v)
    d = raw.filter(ok).select(c("permco").alias("PERMCO"), c("permno").cast("string").alias("DTID"), c("mthcaldt").alias("date"), F.abs("mthprc").alias("PRC"),
                              c("mthret").cast("double").alias("r"), c("shrout").alias("SHROUT"), F.upper("issuernm").alias("NAME"))
    d = C.firm_market_value(d.withColumn("MCshare", c("PRC") * c("SHROUT") / 1000), "PERMCO").drop("MCshare")
    return _keep_last(d, ["DTID", "date"], ["PERMCO", "NAME"]).withColumn("region", F.lit(region))


def international_panel(prices: DataFrame, static: DataFrame, holidays: DataFrame | None = None, cal_cols=None) -> DataFrame:
    """International daily panel: holidays and padding removed, index repaired, firm values, caps."""
    d = prices.join(static, "DTID").filter("RI is not null")
    d = d.withColumn("VOL", F.when(c("VOL") == 0, 0.025).otherwise(c("VOL")))
    d = C.fill_after_first(d, "VOL", 0.0)
    d = d.withColumn("PRC", F.when(c("PRC") == 0, 0.0001).otherwise(c("PRC"))).withColumn("RI", F.when(c("RI") < 0.0001, 0.0001).otherwise(c("RI")))
    if holidays is not None:
        d = C.drop_holidays(d, holidays, cal_cols)
    d = C.drop_trailing_padding(d, "PRCunpadded").drop("PRCunpadded")
    d = C.repair_padded_splits(d, cols=("RI", "RI_OC"))
    d = C.repair_reversals(d, cols=("RI", "RI_OC"))
    d = C.null_outlier_returns(d, cols=("RI", "RI_OC"))
    d = d.withColumn("VOL", c("VOL") * 1000).withColumn("SHROUT", c("SHROUT") / 1000).withColumn("MCshare", F.abs("PRC") * c("SHROUT"))
    d = C.firm_market_value(d, "FTID", floor=0.0001).drop("MCshare")
    d = C.repair_values(d, floors=(), index_floor=-math.inf)
    return _keep_last(d, ["DTID", "date"], ["FTID", "RI"])


def us_statements(raw: DataFrame, link: DataFrame, history: DataFrame, head: DataFrame, industry: DataFrame, cpi: DataFrame, items) -> DataFrame:
    """Yearly statements: link by overlapping intervals, standard format, industry, CPI, use date."""
    d = raw.filter((c("datafmt") == "STD") & (c("indfmt") == "INDL") & (c("consol") == "C")).select("gvkey", "datadate", *items)
    lk = link.filter("lpermno is not null").select("gvkey", "linkdt", "linkenddt", c("lpermno").alias("DTID"), c("lpermco").alias("PERMCO"))
    d = overlap_join(d, lk, "datadate", "gvkey", "linkdt", "linkenddt", ["linkdt", "DTID"]).filter("PERMCO is not null and datadate is not null")
    d = asof_join(d, history.select("gvkey", c("hchgdt").alias("datadate"), c("hsic").alias("sic")), "datadate", "gvkey")
    d = d.join(head.select("gvkey", c("sic").alias("_sic")), "gvkey", "left").withColumn("sic", F.coalesce("sic", "_sic")).drop("_sic")
    d = d.withColumnRenamed("gvkey", "FTID").withColumn("FinYearEnd", c("datadate")).withColumn("date", F.add_months("datadate", 6)).drop("datadate")
    d = _keep_last(d, ["FTID", "date"], ["FinYearEnd", "DTID"]).join(industry.select("sic", "INDM", "INDM3"), "sic", "left")
    first = d.groupBy("FTID").agg(F.min("date").alias("FirstObs"))
    d = asof_series(d.join(first, "FTID"), cpi, "date")
    return d.withColumn("DTID", c("DTID").cast("long").cast("string")).withColumn("FTID", c("FTID").cast("string")).withColumn("region", F.lit("USA"))


def international_statements(raw: DataFrame, codes: dict[str, str], static: DataFrame, derived: dict | None = None, unit: float = 1 / 1000) -> DataFrame:
    """Statements keyed by vendor item codes: header codes renamed, units rescaled, derived items."""
    d = C.rename_columns(raw, codes, r"WC[0-9]+").withColumnRenamed("dscd", "DTID")
    num = [f.name for f in d.schema.fields if f.dataType.simpleString() == "double"]
    d = C.rescale(d, num, unit)
    if derived:
        d = d.withColumns({k: F.expr(e) for k, e in derived.items()})
    d = d.filter("FinYearEnd is not null").withColumn("date", F.add_months("FinYearEnd", 6)).join(static, "DTID")
    return _keep_last(d, ["FTID", "date"], ["FinYearEnd", "DTID"])


def convert_currency(df: DataFrame, rates: DataFrame, cols, by="CURCODE", date="date", rate="exrat") -> DataFrame:
    """Divide by the exchange rate in force on the date."""
    r = _keep_last(rates.select(by, date, rate).withColumn("_o", c(rate)), [by, date], ["_o"]).drop("_o")
    d = asof_join(df, r, date, by)
    return d.withColumns({x: c(x) / F.nullif(c(rate), F.lit(0.0)) for x in cols}).drop(rate)


ESTIMATES = ("MEDEST", "MEANEST", "STDEV", "HIGHEST", "LOWEST")


def _with_ids(d: DataFrame, link: DataFrame, static: DataFrame) -> DataFrame:
    lk = link.filter("permno is not null").select(c("ticker").alias("TICKER"), c("sdate").alias("_s"), c("edate").alias("_e"), c("permno").cast("long").cast("string").alias("PERMNO"))
    d = interval_join(d, lk, "date", "TICKER", "_s", "_e")
    st = static.select(c("DSCD").alias("DTID"), C.normalise_ticker(c("IBTKR")).alias("TICKER"), "region").dropna()
    return d.join(st, "TICKER", "left")


def analyst_summary(parts, rates: DataFrame, link: DataFrame, static: DataFrame) -> DataFrame:
    """Monthly estimate summary in one currency with both security ids."""
    d = None
    for p in parts:
        d = p if d is None else d.unionByName(p, allowMissingColumns=True)
    d = d.select(*[c(x).alias(x.upper()) for x in d.columns]).withColumnRenamed("STATPERS", "date")
    d = d.filter(c("FPI").isin("0", "1") & c("FISCALP").isin("ANN", "LTG")).withColumn("FPI", c("FPI").cast("int"))
    d = convert_currency(d, rates.select(c("curr").alias("CURCODE"), c("anndats").alias("date"), "exrat"), [x for x in ESTIMATES if x in d.columns]).drop("CURCODE")
    return _with_ids(d, link, static)


def analyst_detail(raw: DataFrame, link: DataFrame, static: DataFrame) -> DataFrame:
    d = raw.select(*[c(x).alias(x.upper()) for x in raw.columns]).withColumnRenamed("ACTDATS", "date").dropna()
    return _with_ids(d, link, static)
