"""Volatility signals: exponentially weighted filters and trailing standard deviations."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelquant.functions.num import fdiv
from panelquant.operators.asof import Agg
from panelquant.operators.series import ewma_month_windows
from panelquant.signals.base import SignalClass, WindowSpec, register

c = F.col
DECAYS = (20, 10, 6, 4, 2, 1)  # per cent
CAP = 0.09


def _square():
    return c("r") * c("r")


def _range():
    v = 0.361 * F.pow(fdiv(c("H") - c("L"), c("H") + c("L")) * 2, F.lit(2))
    v = F.when(v == 0, _square()).otherwise(v)
    return F.when(c("H").isNotNull() & c("L").isNotNull(), F.when(v > CAP, F.lit(CAP)).otherwise(v))


# class: output stem, filtered quantity, decays, items
FILTERS = {
    "EWMAVolatility": ("EWMAVol", lambda: F.least(_square(), F.lit(CAP)), DECAYS, ["r"]),
    "EWMARange": ("EWMARange", _range, DECAYS, ["r", "H", "L"]),
    "EWMAVolatilityD": ("EWMAVolD", lambda: F.when(c("r") > 0, F.lit(0.0)).otherwise(_square()), (20, 10, 6), ["r"]),
}


def _filter(name):
    stem, x, decays, _ = FILTERS[name]

    def build(ctx):
        p = ctx.dt.select("DTID", "date", F.when(c("r").isNotNull(), x()).alias("x"))
        e = ewma_month_windows(p, ctx.grid, {"v": "x"}, {"v": [d / 100 for d in decays]}, 30)
        return e.select("T", "DTID", *[F.sqrt(f"v_{i}").alias(f"{stem}{d}") for i, d in enumerate(decays)]).filter(c(f"{stem}{decays[0]}").isNotNull())

    return build


for _n, (_stem, _x, _dec, _items) in FILTERS.items():
    register(SignalClass(_n, [f"{_stem}{d}" for d in _dec], {"dt": (-30, 0, _items)}, build=_filter(_n)))


def _sd(months):
    out = f"TV{months}M"
    register(SignalClass(f"Volatility{months}M", [out], {"dt": (-months, 0, ["r"])},
                         window=lambda g: WindowSpec({}, {"s": Agg("std", "r", -months)}, {out: lambda a: a["s"]})))


for _m in (3, 6, 12):
    _sd(_m)
