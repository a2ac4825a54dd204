"""Series operators: windows keyed by a series id, regressions and Newey-West sums.

A series has one row per date, so its windows are bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelquant.functions.stage import materialise
from panelquant.operators.xsection import running_total


def running_product(x: Column, w) -> Column:
    """Product over a window frame for any sign: logs of magnitudes, parity of negatives, zeros."""
    mag = F.exp(F.coalesce(F.sum(F.ln(F.nullif(F.abs(x), F.lit(0.0)))).over(w), F.lit(0.0)))
    neg = F.sum((x < 0).cast("long")).over(w) % 2
    zero = F.max((x == 0).cast("int")).over(w)
    return F.when(F.count(x).over(w) == 0, F.lit(None)).when(zero == 1, F.lit(0.0)).when(neg == 1, -mag).otherwise(mag)


def product_agg(x: Column) -> Column:
    """The same as a groupBy aggregate."""
    mag = F.exp(F.coalesce(F.sum(F.ln(F.nullif(F.abs(x), F.lit(0.0)))), F.lit(0.0)))
    return (F.when(F.count(x) == 0, F.lit(None)).when(F.max((x == 0).cast("int")) == 1, F.lit(0.0))
            .when(F.sum((x < 0).cast("long")) % 2 == 1, -mag).otherwise(mag))


def safe_corr(x, y) -> Column:
    """Pearson correlation aggregate over complete pairs; null (not an error) at zero variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    d = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(d > 0, d)


def ols_slope(y, x) -> Column:
    """Slope of y on x over complete pairs, null when x does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    ok = x.isNotNull() & y.isNotNull()
    v = F.var_pop(F.when(ok, x))
    return F.covar_pop(F.when(ok, x), F.when(ok, y)) / F.when(v > 0, v)


def group_ols(df: DataFrame, key, y: str, xs, prefix: str = "b") -> DataFrame:
    """Least squares of y on a constant and xs per key: b0..bk, n, ssr, r2.

    One map-side combined pass builds the centred cross-moment matrix (stable covariance
    merges, no rows collected); the k x k system is then eliminated with plain columns.  A
    regressor that is a combination of the earlier ones gets coefficient 0, which leaves fitted
    values and residuals unchanged.
    """
    key = [key] if isinstance(key, str) else list(key)
    xs = list(xs)
    k = len(xs)
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    d = df.filter(ok)
    v = [*xs, y]
    g = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)],
        *[F.covar_pop(F.col(v[i]), F.col(v[j])).alias(f"_a{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)])
    A = lambda i, j: F.col(f"_a{min(i, j)}_{max(i, j)}")
    for i in range(k):
        g = g.withColumn(f"_d{i}", A(i, i))
    g = g.withColumn("_vy", A(k, k))
    # forward elimination of the symmetric matrix, pivot by pivot
    for p in range(k):
        piv = F.when(A(p, p) > 1e-12 * F.col(f"_d{p}"), A(p, p))
        g = g.withColumns({f"_f{p}_{j}": F.coalesce(A(p, j) / piv, F.lit(0.0)) for j in range(p + 1, k + 1)})
        g = g.withColumns({f"_a{i}_{j}": A(i, j) - F.col(f"_f{p}_{i}") * A(p, j)
                           for i in range(p + 1, k + 1) for j in range(i, k + 1)})
    for p in reversed(range(k)):
        e = F.col(f"_f{p}_{k}")
        for j in range(p + 1, k):
            e = e - F.col(f"_f{p}_{j}") * F.col(f"{prefix}{j + 1}")
        g = g.withColumn(f"{prefix}{p + 1}", e)
    b0 = F.col(f"_m{k}")
    for i in range(k):
        b0 = b0 - F.col(f"{prefix}{i + 1}") * F.col(f"_m{i}")
    # what is left of the y pivot after elimination is the residual variance
    ssr = F.greatest(A(k, k), F.lit(0.0)) * F.col("n")
    g = g.withColumn(f"{prefix}0", b0).withColumn("ssr", ssr)
    g = g.withColumn("r2", 1 - F.col("ssr") / F.when(F.col("_vy") > 0, F.col("_vy") * F.col("n")))
    return g.select(*key, *[f"{prefix}{i}" for i in range(k + 1)], "n", "ssr", "r2")


def residuals(df: DataFrame, coef: DataFrame, key, y: str, xs, out: str = "resid", prefix: str = "b") -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    cols = [f"{prefix}{i}" for i in range(len(xs) + 1)]
    j = df.join(coef.select(*key, *cols), key)
    fit = F.col(f"{prefix}0")
    for i, x in enumerate(xs):
        fit = fit + F.col(f"{prefix}{i + 1}") * F.col(x)
    return j.withColumn(out, F.col(y) - fit).drop(*cols)


def nw_std(df: DataFrame, key, date: str, x: str, out: str = "nw", lags: int = 12, textbook: bool = False) -> DataFrame:
    """Newey-West deviation per series -> (key, out, n, mean, std).

    Default form: Bartlett-weighted autocovariances that leave the first deviation out, scaled
    to the standard deviation of the series.  `textbook` keeps every term and returns the
    standard error of the mean.  Null below max(12, lags + 2) observations.
    """
    key = [key] if isinstance(key, str) else list(key)
    d = df.filter(F.col(x).isNotNull()).select(*key, date, x)
    w = W.partitionBy(*key).orderBy(date)
    wa = W.partitionBy(*key)
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_h", F.col(x) - F.avg(x).over(wa))
    first = 1 if textbook else 2  # rank of the first deviation that may enter a lag product
    acc = F.lit(0.0)
    for z in range(1, lags + 1):
        prod = F.when(F.col("_rn") - z >= first, F.col("_h") * F.lag("_h", z).over(w))
        acc = acc + F.lit(2 * (1 - z / (lags + 1))) * F.coalesce(prod, F.lit(0.0))
    g = d.withColumn("_s", F.col("_h") * F.col("_h") + acc).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.sum("_s").alias("_ss"))
    v = F.when((F.col("n") >= max(12, lags + 2)) & (F.col("_ss") >= 0), F.sqrt(F.col("_ss") / F.col("n")))
    if textbook:
        v = v / F.sqrt("n")
    return g.withColumn(out, v).drop("_ss")


def max_drawdown(date: str, x: str) -> Column:
    """Aggregate: worst drop of the compounded series from its running peak (date-bounded list)."""
    path = F.array_sort(F.collect_list(F.struct(F.col(date), F.col(x))))
    one = F.struct(F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("dd"))
    name = x

    def step(a, r):
        y = a["y"] * (1 + r[name])
        p = F.greatest(y, a["p"])
        return F.struct(y.alias("y"), p.alias("p"), F.least(a["dd"], y / F.when(p != 0, p) - 1).alias("dd"))

    return F.aggregate(path, one, step, lambda a: a["dd"])


SCAN_ROWS = 256  # rows of a series that one window holds


def affine_path(df: DataFrame, key, position: str, maps: dict[str, tuple[str, str]]) -> DataFrame:
    """Solutions of y = m y_before + c along each series, for several recurrences at once (y is 0 before the first row).

    maps: output -> (multiplier column, offset column).  Composing two such maps gives such a map again, so a recurrence is a prefix
    composition: rows go into runs of SCAN_ROWS by their position (1, 2, ... per key), a run is composed by doubling, and the runs'
    totals, 256 times fewer, are a shorter recurrence of the same kind.  A run is the largest group any task holds, so one long
    series spreads over all tasks.  Multipliers may differ by row and may be 0; values must be finite and not null.
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_run", F.floor((F.col(position) - 1) / SCAN_ROWS))
    w, step = W.partitionBy(*keys, "_run").orderBy(position), 1
    while step < SCAN_ROWS:
        both = {}
        for m, c in maps.values():
            both[c] = F.col(c) + F.coalesce(F.col(m) * F.lag(c, step).over(w), F.lit(0.0))
            both[m] = F.col(m) * F.coalesce(F.lag(m, step).over(w), F.lit(1.0))
        d, step = d.withColumns(both), step * 2
    d = materialise(d)
    parts = [x for mc in maps.values() for x in mc]
    if not d.agg(F.max("_run")).first()[0]:
        return d.withColumns({o: F.col(c) for o, (_, c) in maps.items()}).drop("_run", *parts)
    ends = d.groupBy(*keys, "_run").agg(F.max_by(F.struct(*parts), position).alias("_e")).select(*keys, (F.col("_run") + 1).alias(position), "_e.*")
    ends = affine_path(ends, keys, position, {"_y_" + o: mc for o, mc in maps.items()})
    ends = ends.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col(position).alias("_next"), *["_y_" + o for o in maps])
    same = F.col("_run") == F.col("_next")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    d = d.join(ends, same, "left")
    d = d.withColumns({o: F.col(m) * F.coalesce(F.col("_y_" + o), F.lit(0.0)) + F.col(c) for o, (m, c) in maps.items()})
    return d.drop("_run", "_next", *parts, *["_k_" + k for k in keys], *["_y_" + o for o in maps])


def ewma_path(df: DataFrame, key: str, date: str, col: str, alphas: dict[str, float]) -> DataFrame:
    """Whole exponentially weighted path per series (first value seeds it): (key, date, one column per weight).

    Rows without a value are left out; a null key is a series of its own; dates should be unique per series.  Positions come from a sort
    by ranges and the recurrence from `affine_path`, so neither step needs a whole series in one task.
    """
    d = df.select(key, date, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    d = running_total(d, F.lit(1), [key], [date], "_at")
    first = F.col("_at") == 1
    d = d.select(key, date, "_at", *[x for n, a in alphas.items() for x in (
        F.when(first, F.lit(0.0)).otherwise(F.lit(1.0 - a)).alias("_m_" + n), (F.when(first, 1.0).otherwise(float(a)) * F.col("_v")).alias("_c_" + n))])
    return affine_path(d, key, "_at", {n: ("_m_" + n, "_c_" + n) for n in alphas}).select(key, date, *alphas)


def ewma_last(df: DataFrame, key, date: str, col: str, alpha: float, out: str) -> DataFrame:
    """Last value of the exponentially weighted path as a weighted sum: no sequential pass."""
    key = [key] if isinstance(key, str) else list(key)
    d = df.filter(F.col(col).isNotNull())
    w = W.partitionBy(*key).orderBy(F.col(date).desc())
    d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key)))
    wt = F.when(F.col("_i") == F.col("_n") - 1, F.pow(F.lit(1 - alpha), F.col("_i"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_i")))
    return d.groupBy(*key).agg(F.sum(wt * F.col(col)).alias(out))


def ewma_month_windows(panel: DataFrame, grid, cols: dict[str, str], alphas, months: int, key="DTID", date="date") -> DataFrame:
    """(T, key, {name}_{i}): EWMA over the last `months` months at every T.

    Per month a decayed sum, a count and the first value are enough: they merge exactly, so one
    frame of `months` small structs replaces months x days fanned-out rows.  Other grids weight the
    fanned-out rows directly.  cols: name -> column.
    """
    from panelquant.functions.num import month_no, month_start
    from panelquant.operators.asof import prune

    if not grid.monthly:
        from panelquant.operators.asof import snapshot

        s = snapshot(panel, grid, -months, 0, list(cols.values()), key, date)
        out = None
        for n, c in cols.items():
            d = s.filter(F.col(c).isNotNull())
            w = W.partitionBy(key, "T").orderBy(F.col(date).desc())
            d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(key, "T")))
            wt = lambda a: F.when(F.col("_i") == F.col("_k") - 1, F.pow(F.lit(1 - a), F.col("_i"))).otherwise(a * F.pow(F.lit(1 - a), F.col("_i")))
            e = d.groupBy("T", key).agg(*[F.sum(wt(a) * F.col(c)).alias(f"{n}_{i}") for i, a in enumerate(alphas[n])])
            out = e if out is None else out.join(e, ["T", key], "outer")
        return out
    ds = grid.dates()
    t0, t1 = (d.year * 12 + d.month - 1 for d in (ds[0], ds[-1]))
    p = prune(panel, grid, -months, 0, date).withColumn("mno", month_no(date))
    wd = W.partitionBy(key, "mno").orderBy(F.col(date).desc())
    for n, c in cols.items():  # rows of the same month that come after this one
        p = p.withColumn("_i_" + n, F.count(c).over(wd) - 1)
    aggs = []
    for n, c in cols.items():
        x = F.col(c)
        aggs += [F.count(x).alias("_n_" + n), F.min_by(x, F.when(x.isNotNull(), F.col(date))).alias("_f_" + n)]
        aggs += [F.sum(a * F.pow(F.lit(1 - a), F.col("_i_" + n)) * x).alias(f"_d_{n}_{i}") for i, a in enumerate(alphas[n])]
    m = p.groupBy(key, "mno").agg(*aggs)
    wk = W.partitionBy(key).orderBy("mno")
    m = (m.withColumn("_nx", F.coalesce(F.lead("mno").over(wk) - 1, F.least(F.col("mno") + months, F.lit(t1))))
         .withColumn("_t", F.explode(F.sequence(F.col("mno") + 1, F.greatest(F.col("_nx") + 1, F.col("mno") + 1)))))
    fr = wk.rangeBetween(-(months - 1), 0)
    names = [c for c in m.columns if c.startswith(("_n_", "_f_", "_d_"))]
    base = m.filter(F.col("_t") == F.col("mno") + 1).select(key, "mno", F.struct("mno", *names).alias("_r"))
    lst = base.withColumn("_l", F.collect_list("_r").over(fr)).select(key, "mno", "_l")
    out = m.select(key, "mno", "_t").join(lst, [key, "mno"]).filter(F.col("_t").between(t0, t1))
    # a grid date after a gap sees only the months still inside its window
    out = out.withColumn("_l", F.filter("_l", lambda r: r["mno"] >= F.col("_t") - months))

    def fold(n, i, a):
        """Chain the months of the frame: decay by the month's row count, add its decayed sum."""
        def step(acc, r):
            dec = F.pow(F.lit(1 - a), r["_n_" + n])
            seed = r[f"_d_{n}_{i}"] + dec * r["_f_" + n]
            y = (F.when(r["_n_" + n] == 0, acc["y"]).when(acc["y"].isNull(), seed).otherwise(acc["y"] * dec + r[f"_d_{n}_{i}"]))
            return F.struct(y.alias("y"))

        return F.aggregate("_l", F.struct(F.lit(None).cast("double").alias("y")), step, lambda acc: acc["y"]).alias(f"{n}_{i}")

    res = [fold(n, i, a) for n in cols for i, a in enumerate(alphas[n])]
    return out.select(month_start("_t").alias("T"), key, *res)
