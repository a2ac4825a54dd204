"""Sorted and long/short portfolios: labels, drifted weights, returns, metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import fdiv, nz
from panelquant.functions.stage import materialise, stage
from panelquant.operators import xsection as X
from panelquant.operators.asof import asof_join
from panelquant.operators.series import max_drawdown, nw_std, running_product

GROUP = ("region", "date")


def signal_ls(df: DataFrame, var: str, frac: float = 0.1, by=GROUP) -> DataFrame:
    """Long the top fraction, short the bottom fraction of every group (inclusive cuts)."""
    q = X.with_quantiles(df, by, {"_lo": (var, frac), "_hi": (var, 1 - frac)})
    q = q.select("date", "DTID", "region", (F.col(var) >= F.col("_hi")).alias("long"), (F.col(var) <= F.col("_lo")).alias("short"))
    return q.filter("long or short")


def _cuts(name: str, var: str, n: int) -> dict:
    """The inner cut points: the first bucket has no lower and the last no upper bound, so minimum and maximum are not looked for."""
    return {f"_{name}{i}": (var, i / n) for i in range(1, n)}


def _bucket(name: str, var: str, n: int):
    """Greatest i with x >= q(i/n); equal cut points resolve to the later bucket."""
    return sum((F.when(F.col(var) >= F.col(f"_{name}{i}"), 1).otherwise(0) for i in range(1, n)), F.lit(0))


def sorts(df: DataFrame, var1: str, var2: str | None = None, n: int = 5, kind: str = "dependent", by=GROUP) -> DataFrame:
    """(date, DTID, region, Var): bucket label per row for single, independent or dependent sorts."""
    by = list(by)
    keep = ["date", "DTID", "region"]
    if var2 is None:
        d = X.with_quantiles(df.filter(F.col(var1).isNotNull()), by, _cuts("a", var1, n))
        return d.select(*keep, F.concat(F.lit("Var1_"), _bucket("a", var1, n).cast("string")).alias("Var"))
    label = lambda i, j: F.concat(F.lit("Var1_"), i.cast("string"), F.lit("_Var2_"), j.cast("string"))
    df = stage(df)  # cut points and rows are read from the same figures: sums evaluated twice may differ in the last digit
    d = df.filter(F.col(var1).isNotNull() & F.col(var2).isNotNull()) if kind == "independent" else df.filter(F.col(var1).isNotNull())
    if kind == "independent":
        # each cut uses all non-null values of its own variable
        q = X.group_quantiles(df, by, {**_cuts("a", var1, n), **_cuts("b", var2, n)})
        d = d.join(q, by, "left")
        return d.select(*keep, label(_bucket("a", var1, n), _bucket("b", var2, n)).alias("Var"))
    if kind != "dependent":
        raise ValueError(f"unknown sort kind {kind!r}")
    d = X.with_quantiles(d, by, _cuts("a", var1, n))
    # a row on a cut point belongs to the samples of both neighbours; the later label wins
    above = lambda i: F.col(var1) >= F.col(f"_a{i}") if i else F.lit(True)
    below = lambda i: F.col(var1) <= F.col(f"_a{i}") if i < n else F.lit(True)
    mem = F.array_compact(F.array(*[F.when(above(i) & below(i + 1), F.lit(i)) for i in range(n)]))
    d = d.select(*keep, var2, F.explode(mem).alias("_i")).filter(F.col(var2).isNotNull())
    d = X.with_quantiles(d, [*by, "_i"], _cuts("b", var2, n)).withColumn("_j", _bucket("b", var2, n))
    g = d.groupBy(*keep).agg(F.max(F.struct("_i", "_j")).alias("s"))
    return g.select(*keep, label(F.col("s._i"), F.col("s._j")).alias("Var"))


def rebalancing_map(sig: DataFrame, ret: DataFrame) -> DataFrame:
    """Every return date with the last signal date at or before it."""
    k = F.lit(0).alias("_g")
    d = asof_join(ret.select("date", k).distinct(), sig.select("date", k, F.col("date").alias("pred_date")).distinct(), "date", "_g")
    return d.filter("pred_date is not null").drop("_g")


def _holdings(sig: DataFrame, ret: DataFrame, weight: str, ports) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calendar, holdings with their start weight `_w`, and return rows with the growth `_g` since the period started.

    Returns are ordered once by (id, period) and meet one holding per (id, period): no holding is copied to the dates it is held for.
    Market value and region come from the id's first return row of the period; an id without one is not held.
    """
    sig, ret = stage(sig), stage(ret.select("DTID", "date", "region", "MC", "r"))
    period = W.partitionBy("pred_date")
    cal = rebalancing_map(sig, ret).withColumn("_i", F.row_number().over(W.orderBy("date")))  # one row per calendar date
    cal = materialise(cal.withColumns({"_begin": F.min("_i").over(period), "_end": F.max("_i").over(period)}))
    r = ret.join(F.broadcast(cal), "date")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    h = r.groupBy("DTID", "pred_date").agg(first("region"), first("MC"))
    h = materialise(sig.select(F.col("date").alias("pred_date"), "DTID", *ports).join(h, ["pred_date", "DTID"]))
    w0 = F.lit(1.0) if weight == "EW" else F.col("MC")
    tot = h.groupBy("pred_date", "region", *ports).agg(F.sum(w0).alias("_t"))
    h = h.join(tot, ["pred_date", "region", *ports]).withColumn("_w", fdiv(w0, "_t")).drop("_t")
    wk = W.partitionBy("DTID", "pred_date").orderBy("date")  # the return dates of one period
    grown = nz(running_product(1 + F.col("r"), wk.rowsBetween(W.unboundedPreceding, -1)), 1.0)
    d = r.withColumn("r", nz("r")).select("DTID", "pred_date", "date", "_i", "r", grown.alias("_g"),
                                          F.when(F.row_number().over(wk) == 1, F.col("_begin")).otherwise(F.col("_i")).alias("_from"),
                                          F.greatest(F.coalesce(F.lead("_i").over(wk) - 1, "_end"), "_i").alias("_to"))
    return cal, h, d.join(h, ["DTID", "pred_date"])


def weights(sig: DataFrame, ret: DataFrame, weight: str = "EW", ports=("Var",)) -> DataFrame:
    """Holdings per return date: start weight at the first date of a period, drifted by (1 + r).

    w_t = w_0 * product of (1 + r) since the period started, a running product per (id, period);
    nothing loops over dates.  Missing returns are zero: a return row also gives the dates up to
    the id's next one, and these rows are made last, after every shuffle.
    """
    ports = list(ports)
    cal, _, d = _holdings(sig, ret, weight, ports)
    d = d.drop("date").withColumn("_p", F.explode(F.sequence("_from", "_to")))
    at = F.col("_p") - F.col("_i")  # before the first return, on a return date, or after it
    d = d.withColumn("wgt", F.col("_w") * F.when(at < 0, 1.0).when(at == 0, F.col("_g")).otherwise(F.col("_g") * (1 + F.col("r"))))
    d = d.withColumn("r", F.when(at == 0, F.col("r")).otherwise(0.0))
    return d.join(F.broadcast(cal.select("date", F.col("_i").alias("_p"))), "_p").select("pred_date", "region", *ports, "date", "DTID", "MC", "r", "wgt")


def _contributions(sig: DataFrame, ret: DataFrame, weight: str, ports) -> DataFrame:
    """(region, date, ports, x) whose sums of x are portfolio returns: return rows, and a zero per portfolio and held date, as missing returns are zero."""
    cal, h, d = _holdings(sig, ret, weight, ports)
    zero = h.groupBy("pred_date", "region", *ports).agg(F.sum(F.col("_w") * 0.0).alias("x")).join(F.broadcast(cal), "pred_date")
    return d.select("region", "date", *ports, (F.col("r") * F.col("_w") * F.col("_g")).alias("x")).unionByName(zero.select("region", "date", *ports, "x"))


def portfolios(sig: DataFrame, ret: DataFrame, weight: str = "EW", kind: str = "sorts") -> DataFrame:
    """Portfolio returns (region, date, bucket, ret); "Global" is the mean over regions.

    kind = sorts uses the label column Var; kind = LS uses the long / short flags and gives the
    buckets long, short and ls.
    """
    if kind == "sorts":
        w = _contributions(sig, ret, weight, ["Var"])
        p = stage(w.groupBy("region", "date", F.col("Var").alias("bucket")).agg(F.sum("x").alias("ret")))
        g = p.groupBy("date", "bucket").agg(F.avg("ret").alias("ret")).withColumn("region", F.lit("Global"))
        return p.unionByName(g)
    w = _contributions(sig, ret, weight, ["long", "short"])
    p = w.groupBy("region", "date").agg(F.sum(F.when(F.col("long"), F.col("x"))).alias("long"), F.sum(F.when(F.col("short"), F.col("x"))).alias("short"))
    p = stage(p)
    p = p.unionByName(p.groupBy("date").agg(F.avg("long").alias("long"), F.avg("short").alias("short")).withColumn("region", F.lit("Global")))
    p = p.withColumn("ls", F.col("long") - F.col("short"))
    return p.unpivot(["region", "date"], ["long", "short", "ls"], "bucket", "ret").filter("ret is not null")


def high_minus_low(p: DataFrame, n: int, double: bool = False) -> DataFrame:
    """Append top-minus-bottom series: one for a single sort; per row and per column for a double sort."""
    num = lambda hi, lo: (F.max(F.when(F.col("bucket") == hi, F.col("ret"))) - F.max(F.when(F.col("bucket") == lo, F.col("ret"))))
    pairs = []
    if not double:
        pairs.append((f"Var1_{n}", f"Var1_{n - 1}", "Var1_0"))
    else:
        for i in range(n):
            pairs.append((f"Var1_{i}_Var2_{n}", f"Var1_{i}_Var2_{n - 1}", f"Var1_{i}_Var2_0"))
            pairs.append((f"Var1_{n}_Var2_{i}", f"Var1_{n - 1}_Var2_{i}", f"Var1_0_Var2_{i}"))
    g = p.groupBy("region", "date").agg(*[num(h, l).alias(k) for k, h, l in pairs])
    add = g.unpivot(["region", "date"], [k for k, _, _ in pairs], "bucket", "ret").filter("ret is not null")
    return p.unionByName(add)


PER_YEAR = {"M": 12, "D": 260}  # fixed values


def metrics(p: DataFrame, freq: str = "M", keys=("region", "bucket"), ret: str = "ret") -> DataFrame:
    """Mean %, Newey-West t, Sharpe ratio and maximum drawdown % per series."""
    if freq not in PER_YEAR:
        raise ValueError(f"unknown frequency {freq!r}")
    keys = list(keys)
    p = stage(p, 2)
    nw = nw_std(p, keys, "date", ret)
    dd = p.groupBy(*keys).agg((max_drawdown("date", ret) * 100).alias("max_dd"))
    return nw.join(dd, keys).select(*keys, "n", (F.col("mean") * 100).alias("mean"), (F.col("nw") * 100).alias("std_nw"),
                                    (fdiv("mean", "nw") * F.sqrt("n")).alias("t"), (fdiv("mean", "std") * (PER_YEAR[freq] ** 0.5)).alias("sr"), "max_dd")


def cross_quantile_ls(df: DataFrame, ret: DataFrame, long_q: str, short_q: str, frac: float = 0.1, weight: str = "EW") -> DataFrame:
    """Long leg sorted on one quantile forecast, short leg on another: (region, date, ret)."""
    df, ret = stage(df), stage(ret.select("DTID", "date", "region", "MC", "r"))
    leg = lambda v, b: portfolios(signal_ls(df, v, frac), ret, weight, "LS").filter(F.col("bucket") == b).select("region", "date", F.col("ret").alias(b))
    return leg(long_q, "long").join(leg(short_q, "short"), ["region", "date"]).select("region", "date", (F.col("long") - F.col("short")).alias("ret"))


def strategy_difference(a: DataFrame, b: DataFrame, keys=("region",)) -> DataFrame:
    """t-statistic of the mean difference of two return series."""
    keys = list(keys)
    j = a.select(*keys, "date", F.col("ret").alias("_a")).join(b.select(*keys, "date", F.col("ret").alias("_b")), [*keys, "date"])
    s = nw_std(j.withColumn("d", F.col("_a") - F.col("_b")), keys, "date", "d")
    return s.select(*keys, "n", F.col("mean").alias("diff"), (fdiv("mean", "nw") * F.sqrt("n")).alias("t"))
