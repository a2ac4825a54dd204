"""Momentum strategy from daily lines to performance, one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelquant.operators import xsection as X
from panelquant.operators.asof import Grid
from panelquant.operators.portfolio import metrics, portfolios, signal_ls
from panelquant.plans.panel import forward_returns
from panelquant.signals import SignalContext
from panelquant.signals.base import window_signals
from panelquant.sources.adapters import panel_nation

GRID = Grid("1997-01-01", "2001-09-01")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot signals, cross-sectional ranks, long/short on momentum, next-month returns, metrics."""
    p = panel_nation(spark, d)
    sig = window_signals(SignalContext({"dt": p}, GRID), ["Momentum", "Volatility3M"]).withColumnRenamed("T", "date")
    reg = p.groupBy("DTID").agg(F.first("region").alias("region"))  # one region per id
    sig = X.rank_pct(sig.join(reg, "DTID"), ["Mom", "TV3M"], ["date"], ["date", "DTID"])
    ends = GRID.df(spark).select(F.col("T").alias("start"), F.add_months("T", 1).alias("end"))
    ret = forward_returns(p, ends).join(reg, "DTID").withColumn("MC", F.lit(1.0))
    ls = signal_ls(sig, "Mom", 0.3, ["date"])
    return metrics(portfolios(ls, ret, "EW", "LS"), "M")
