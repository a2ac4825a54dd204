"""Cross-sectional operators (per date x region), safe for groups of any size.

A cross-section may hold a large share of all rows, so nothing here sorts a whole group in
one task.  Means and deviations are map-side combined aggregates joined back.  Ranks and
quantiles work on distinct values split into order-preserving buckets (`bucket_of`): bucket
counts give every bucket its offset, the rest is local to a bucket.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import bucket_of, fdiv
from panelquant.functions.stage import materialise, stage


def attach(df: DataFrame, by, **aggs) -> DataFrame:
    """Group aggregates joined back to the members (instead of a whole-group window)."""
    by = [by] if isinstance(by, str) else list(by)
    df = stage(df, 5)
    g = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(g, by, "left")


def value_positions(df: DataFrame, by, col: str) -> DataFrame:
    """One row per (group, distinct value): count `_c`, rows below `_s`, group size `_n`.

    Three levels: rows -> distinct values (map-side combine) -> bucket totals (a few thousand
    per group at most) -> offsets.  The only ordered windows run over bucket totals and over
    the distinct values of a single bucket.
    """
    by = list(by)
    vc = (df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
          .withColumn("_b", bucket_of("_v")))
    bt = vc.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    wb = W.partitionBy(*by).orderBy("_b")
    bt = (bt.withColumn("_off", F.sum("_bc").over(wb) - F.col("_bc"))
          .withColumn("_n", F.sum("_bc").over(W.partitionBy(*by))).drop("_bc"))
    wv = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return (vc.join(bt, [*by, "_b"]).withColumn("_s", F.col("_off") + F.sum("_c").over(wv) - F.col("_c"))
            .select(*by, "_v", "_c", "_s", "_n"))


def rank_avg(df: DataFrame, col: str, by, out: str, pct: bool = False) -> DataFrame:
    """Average-tie rank of the non-null values within the group; nulls stay null."""
    by = list(by)
    df = stage(df, 1)
    vp = value_positions(df, by, col)
    rk = F.col("_s") + (F.col("_c") + 1) / 2
    vp = vp.select(*by, F.col("_v").alias(col), (rk / F.col("_n") if pct else rk).alias(out))
    return df.join(vp, [*by, col], "left")


def _long(df: DataFrame, ids, cols) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), "_var", "_x")


def rank_pct(df: DataFrame, cols, by=("date", "region"), key=("date", "DTID"), fill: float | None = 0.5) -> DataFrame:
    """Percentile rank (average ties / non-null count) of many columns at once, null -> fill.

    All columns are ranked together in long form, so the number of exchanges does not grow
    with the number of columns.  `key` identifies a row.
    """
    by, key, cols = list(by), list(key), list(cols)
    ids = list(dict.fromkeys([*key, *by]))
    df = stage(df)
    lg = _long(df, ids, cols).filter("_x is not null")
    # a long copy is cheap to derive from the staged rows, so it is not staged again
    r = rank_avg(lg, "_x", [*by, "_var"], "_r", pct=True)
    wide = r.groupBy(*ids).agg(*[F.max(F.when(F.col("_var") == c, F.col("_r"))).alias(c) for c in cols])
    out = df.drop(*cols).join(wide, ids, "left")
    sel = [F.coalesce(F.col(c), F.lit(fill)).alias(c) if fill is not None and c in cols else F.col(c) for c in df.columns]
    return out.select(*sel)


def group_quantiles(df: DataFrame, by, specs: dict, parts: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per group: {name: (column, q)} -> (by, name...).

    `parts` returns the two order statistics and the weight as a struct (lo, hi, fr) instead.

    Pass 1 counts rows per (group, column, bucket), which is map-side combined to almost
    nothing.  It locates the one or two buckets that hold each wanted position; pass 2 reads
    only rows in those buckets.  No task ever holds a group.
    """
    by = list(by)
    if not specs:
        return df.select(*by).distinct()
    cols = list(dict.fromkeys(c for c, _ in specs.values()))
    lg = _long(stage(df.select(*by, *[c for c in cols if c not in by])), by, cols).filter("_x is not null").withColumn("_b", bucket_of("_x"))
    g = [*by, "_var"]
    bt = lg.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    wb = W.partitionBy(*g).orderBy("_b")
    bt = (bt.withColumn("_off", F.sum("_bc").over(wb) - F.col("_bc")).withColumn("_n", F.sum("_bc").over(W.partitionBy(*g))))
    pos = []
    for name, (c, q) in specs.items():
        p = (F.col("_n") - 1) * F.lit(float(q))
        pos.append(F.when(F.col("_var") == c, F.array(*[
            F.struct(F.lit(name).alias("q"), f(p).cast("long").alias("k"), F.lit(hi).alias("hi"),
                     (p - F.floor(p)).alias("fr")) for hi, f in ((0, F.floor), (1, F.ceil))])))
    need = (bt.withColumn("_p", F.explode(F.flatten(F.array_compact(F.array(*pos)))))
            .filter((F.col("_p.k") >= F.col("_off")) & (F.col("_p.k") < F.col("_off") + F.col("_bc")))
            .select(*g, "_b", "_off", "_p"))
    targets = need.select(*g, "_b").distinct()
    vc = (lg.join(targets, [*g, "_b"], "left_semi").groupBy(*g, "_b", "_x").agg(F.count(F.lit(1)).alias("_c")))
    wv = W.partitionBy(*g, "_b").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    vc = vc.withColumn("_e", F.sum("_c").over(wv)).withColumn("_s0", F.col("_e") - F.col("_c"))
    hit = (vc.join(need, [*g, "_b"])
           .filter((F.col("_p.k") - F.col("_off") >= F.col("_s0")) & (F.col("_p.k") - F.col("_off") < F.col("_e"))))
    per = []
    for name in specs:
        lo = F.max(F.when((F.col("_p.q") == name) & (F.col("_p.hi") == 0), F.col("_x")))
        hi = F.max(F.when((F.col("_p.q") == name) & (F.col("_p.hi") == 1), F.col("_x")))
        fr = F.max(F.when(F.col("_p.q") == name, F.col("_p.fr")))
        if parts:
            per.append(F.struct(lo.alias("lo"), hi.alias("hi"), fr.alias("fr")).alias(name))
        else:
            per.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * fr).alias(name))
    return hit.groupBy(*by).agg(*per)


def with_quantiles(df: DataFrame, by, specs: dict) -> DataFrame:
    df = stage(df)
    return df.join(group_quantiles(df, by, specs), list(by), "left")


def standardize(df: DataFrame, cols, by=("date", "region"), fill: float | None = 0.0) -> DataFrame:
    """(x - mean) / sample std within the group, null -> fill."""
    by = list(by)
    df = stage(df, 5)
    g = df.groupBy(*by).agg(*[F.avg(c).alias("_m_" + c) for c in cols], *[F.stddev_samp(c).alias("_s_" + c) for c in cols])
    out = df.join(g, by, "left")
    sel = []
    for c in df.columns:
        if c in cols:
            z = fdiv(F.col(c) - F.col("_m_" + c), F.col("_s_" + c))
            sel.append((F.coalesce(z, F.lit(fill)) if fill is not None else z).alias(c))
        else:
            sel.append(F.col(c))
    return out.select(*sel)


def winsorize(df: DataFrame, cols, by, q: float = 0.025) -> DataFrame:
    """Clip at the q and 1-q quantiles of the group."""
    specs = {}
    for c in cols:
        specs["_lo_" + c], specs["_hi_" + c] = (c, q), (c, 1 - q)
    out = with_quantiles(df, by, specs)
    clip = lambda c: F.when(F.col(c) < F.col("_lo_" + c), F.col("_lo_" + c)).when(F.col(c) > F.col("_hi_" + c), F.col("_hi_" + c)).otherwise(F.col(c))
    return out.select(*[clip(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def winsor_standardize(df: DataFrame, cols, by=("date", "region"), q: float = 0.025, fill: float | None = 0.0) -> DataFrame:
    """Upper clip first, lower quantile taken on the clipped values, then standardise.

    The lower quantile of the clipped column interpolates the same two order statistics, each
    capped at the upper bound, so both bounds come from one pass over the data.
    """
    by = list(by)
    specs = {}
    for c in cols:
        specs["_lo_" + c], specs["_hi_" + c] = (c, q), (c, 1 - q)
    df = stage(df)
    p = df.join(group_quantiles(df, by, specs, parts=True), by, "left")
    clipped = []
    for c in df.columns:
        if c not in cols:
            clipped.append(F.col(c))
            continue
        lo, hi = F.col("_lo_" + c), F.col("_hi_" + c)
        up = hi["lo"] + (hi["hi"] - hi["lo"]) * hi["fr"]
        a, b = F.least(lo["lo"], up), F.least(lo["hi"], up)
        low = a + (b - a) * lo["fr"]
        x = F.when(F.col(c) > up, up).otherwise(F.col(c))
        clipped.append(F.when(x < low, low).otherwise(x).alias(c))
    return standardize(p.select(*clipped), cols, by, fill)


def median_scale(df: DataFrame, col: str, by=("date", "region"), div: float = 1.4) -> DataFrame:
    """Centre by the group median; `r_scale` = mean absolute centred value / div."""
    c = with_quantiles(df, by, {"_med": (col, 0.5)}).withColumn(col, F.col(col) - F.col("_med")).drop("_med")
    c = attach(c, by, r_scale=F.avg(F.abs(col)) / div)
    return c.withColumn(col, fdiv(F.col(col), F.col("r_scale")))


def fill_group_mean(df: DataFrame, cols, by=("date", "region")) -> DataFrame:
    by = list(by)
    df = stage(df, 5)
    g = df.groupBy(*by).agg(*[F.avg(c).alias("_m_" + c) for c in cols])
    return df.join(g, by, "left").select(*[F.coalesce(F.col(c), F.col("_m_" + c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def running_total(df: DataFrame, value, by, order, out: str, total: str | None = None) -> DataFrame:
    """Running sum of `value` in the given order inside each group, and the group's total.

    Rows are range-partitioned by (group, order), written, and summed per (group, partition); the few sums give every partition its
    offset.  A task orders one range only, whatever the size of a group, and ties on leading columns are split like any other rows.
    """
    by, order = list(by), list(order)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    d = df.withColumn("_x", value if not isinstance(value, str) else F.col(value)).repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id())
    d = materialise(d)
    part = d.groupBy(*by, "_p").agg(F.sum("_x").alias("_s"))
    w = W.partitionBy(*by).orderBy("_p") if by else W.orderBy("_p")  # at most one row per group and partition
    part = part.select(*by, "_p", F.coalesce(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_tot"))
    wv = W.partitionBy(*by, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cond = F.lit(True)
    right = part.select(*[F.col(b).alias("_k_" + b) for b in by], F.col("_p").alias("_q"), "_off", "_tot")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col("_k_" + b))
    r = d.withColumn("_c", F.sum("_x").over(wv)).join(right, cond & (F.col("_p") == F.col("_q")))
    r = r.withColumn(out, F.col("_off") + F.col("_c"))
    if total:
        r = r.withColumn(total, F.col("_tot"))
    return r.drop("_x", "_p", "_q", "_c", "_off", "_tot", *["_k_" + b for b in by])


def cumulative_share(df: DataFrame, col: str, by, tie: str, out: str) -> DataFrame:
    """Running share of the group total in (value, tie) order."""
    d = running_total(df, col, by, [col, tie], "_run", "_all")
    return d.withColumn(out, fdiv(F.col("_run"), F.col("_all"))).drop("_run", "_all")


def mkt_factor(df: DataFrame, by, ret: str = "r", weight: str = "MC") -> DataFrame:
    """Value-weighted mean return per group: (by, rm).  Rows with either side missing are skipped."""
    ok = F.col(ret).isNotNull() & F.col(weight).isNotNull()
    return (df.filter(ok).groupBy(*([by] if isinstance(by, str) else by))
            .agg(fdiv(F.sum(F.col(ret) * F.col(weight)), F.sum(weight)).alias("rm")))
