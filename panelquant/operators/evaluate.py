"""Forecast evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelquant.functions.stage import stage
from panelquant.operators import xsection as X
from panelquant.operators.series import safe_corr


def rank_correlations(df: DataFrame, cols, by=("date",), key=("date", "DTID")) -> DataFrame:
    """Spearman matrix per group, averaged over groups: (a, b, rho)."""
    by, cols = list(by), list(cols)
    r = X.rank_pct(df.select(*dict.fromkeys([*key, *by, *cols])), cols, by, key, fill=None)
    pairs = [(a, b) for a in cols for b in cols]
    g = r.groupBy(*by).agg(*[safe_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    m = g.agg(*[F.avg(f"{i}").alias(f"{i}") for i in range(len(pairs))])
    st = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return m.select(F.explode(st).alias("s")).select("s.a", "s.b", "s.rho")


def _with_global(df: DataFrame, region: str = "region") -> DataFrame:
    """Every row once for its region and once for "Global": two map-side combined groups, no union scan."""
    return df.withColumn(region, F.explode(F.array(F.col(region), F.lit("Global"))))


def pinball(df: DataFrame, taus, y: str = "y", q: str = "q", by=()) -> DataFrame:
    """Mean pinball loss per level (tau) and group."""
    lv = F.array(*[F.lit(float(t)) for t in taus])
    d = df.select(*by, F.col(y).alias("_y"), F.posexplode(q).alias("_i", "_q"))
    tau = F.element_at(lv, F.col("_i") + 1)
    e = F.col("_y") - F.col("_q")
    return d.groupBy(*by, tau.alias("tau")).agg(F.avg(F.when(e >= 0, tau * e).otherwise((tau - 1) * e)).alias("loss"))


def mean_pinball(df: DataFrame, taus, y: str = "y", q: str = "q", by=()) -> DataFrame:
    """Mean pinball loss over rows and levels per group."""
    from panelquant.operators.distribution import pinball_sum

    return df.groupBy(*by).agg((F.avg(pinball_sum(F.col(q), F.col(y), taus)) / len(taus)).alias("loss"))


def compare_losses(a: DataFrame, b: DataFrame, keys=(), date: str = "date") -> DataFrame:
    """Paired loss difference b - a over dates: mean difference and Newey-West t."""
    from panelquant.functions.num import fdiv
    from panelquant.operators.series import nw_std

    keys = list(keys)
    j = a.select(*keys, date, F.col("loss").alias("_a")).join(b.select(*keys, date, F.col("loss").alias("_b")), [*keys, date])
    j = j.withColumn("d", F.col("_b") - F.col("_a"))
    if not keys:
        j, keys = j.withColumn("series", F.lit("all")), ["series"]
    s = nw_std(j, keys, date, "d")
    return s.select(*keys, "n", F.col("mean").alias("diff"), (fdiv("mean", "nw") * F.sqrt("n")).alias("t"))


def fit_statistics(df: DataFrame, pred: str, actual: str, region: str = "region", benchmark: str | None = None) -> DataFrame:
    """R2 (benchmark zero unless a column is named), RMSE and MAD per region and globally."""
    e = F.col(actual) - F.col(pred)
    z = F.col(actual) - F.col(benchmark) if benchmark else F.col(actual)
    d = _with_global(df.select(region, pred, actual, *([benchmark] if benchmark else [])), region)
    return d.groupBy(region).agg((1 - F.sum(e * e) / F.nullif(F.sum(z * z), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mad"))


def diebold_mariano(df: DataFrame, pred1: str, pred2: str, actual: str, region: str = "region", date: str = "date") -> DataFrame:
    """t-statistic of the difference of daily mean squared errors (model 2 minus model 1)."""
    from panelquant.functions.num import fdiv
    from panelquant.operators.series import nw_std

    a = F.col(actual)
    d = _with_global(df, region).groupBy(region, date).agg(F.avg(F.pow(a - F.col(pred1), F.lit(2))).alias("_1"), F.avg(F.pow(a - F.col(pred2), F.lit(2))).alias("_2"))
    s = nw_std(d.withColumn("d", F.col("_2") - F.col("_1")), [region], date, "d")
    return s.select(region, "n", (fdiv("mean", "nw") * F.sqrt("n")).alias("t"))


def excess_returns(df: DataFrame, rf: DataFrame, ret: str = "r", date: str = "date") -> DataFrame:
    """Return less the risk-free rate (per cent) of the same date."""
    return df.join(rf.select(date, "RF"), date, "left").withColumn(ret + "_excess", F.col(ret) - F.col("RF") / 100)


def observation_counts(df: DataFrame, region: str = "region", date: str = "date") -> DataFrame:
    """Min, mean and max number of rows per date in every region."""
    g = df.groupBy(region, date).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(region).agg(F.min("_n").alias("min"), F.avg("_n").alias("mean"), F.max("_n").alias("max"))


def moment_summary(df: DataFrame, cols) -> DataFrame:
    """Mean, median and deviation per column: (var, mean, median, std)."""
    lg = stage(df.select(*[F.col(c).cast("double").alias(c) for c in cols])).unpivot([], list(cols), "var", "x").filter("x is not null")
    g = lg.groupBy("var").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return g.join(X.group_quantiles(lg, ["var"], {"median": ("x", 0.5)}), "var")


def trimmed_histogram(df: DataFrame, cols, bins: int = 50, trim: float = 0.01) -> DataFrame:
    """Counts per equal-width bin between the trim and 1-trim quantiles: (var, bin, lo, hi, n)."""
    lg = stage(df.select(*[F.col(c).cast("double").alias(c) for c in cols])).unpivot([], list(cols), "var", "x").filter("x is not null")
    q = X.group_quantiles(lg, ["var"], {"a": ("x", trim), "b": ("x", 1 - trim)})  # one row per column
    d = lg.join(F.broadcast(q), "var").filter("x >= a and x <= b")
    w = (F.col("b") - F.col("a")) / bins
    k = F.least(F.floor((F.col("x") - F.col("a")) / F.nullif(w, F.lit(0.0))), F.lit(bins - 1))
    g = d.withColumn("_w", w).groupBy("var", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("_a"), F.first("_w").alias("_w"))
    edge = lambda i: F.col("_a") + F.coalesce(F.col("bin"), F.lit(0)) * F.col("_w") + i * F.col("_w")
    return g.select("var", "bin", edge(0).alias("lo"), edge(1).alias("hi"), "n")


def common_sample(dfs: dict[str, DataFrame], key=("date", "DTID")) -> DataFrame:
    """Keys present in every model, with how many rows each contributes (long union, one count)."""
    key, u = list(key), None
    for name, d in dfs.items():
        x = d.select(*key).distinct().withColumn("model", F.lit(name))
        u = x if u is None else u.unionByName(x)
    return u.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == len(dfs)).drop("_k")


def implied_scaler(df: DataFrame, raw: str, norm: str, scale: str, by=("date",)) -> DataFrame:
    """Median over rows of raw / (norm * scale) per group."""
    from panelquant.functions.num import fdiv, finite

    d = df.withColumn("_s", finite(fdiv(raw, F.col(norm) * F.col(scale))))
    return X.group_quantiles(d, list(by), {"scaler": ("_s", 0.5)})
