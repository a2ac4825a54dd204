import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelquant.functions.num import bucket_of, fdiv, fln, fpow
from panelquant.functions.stage import stage, weight
from panelquant.operators import asof as A, clean as C, distribution as D, series as S, xsection as X
from panelquant.operators.asof import Agg, Grid


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    out = []
    for k in range(6):
        d = pd.date_range("1999-01-01", "2001-12-31", freq="D")
        d = d[rng.random(len(d)) < (0.6 if k else 0.05)]
        out.append(pd.DataFrame({"DTID": str(k), "date": d.date, "x": np.where(rng.random(len(d)) < 0.1, np.nan, rng.normal(size=len(d)))}))
    pdf = pd.concat(out)
    pdf["x"] = pdf["x"].astype(object).where(pdf["x"].notna(), None)
    return spark.createDataFrame(pdf, "DTID string, date date, x double"), pd.concat(out)


AGGS = {"n": Agg("n", "x", -3), "s": Agg("sum", "x", -6), "sd": Agg("std", "x", -12), "l": Agg("last", "x", -2), "f": Agg("first", "x", -7, -1), "a": Agg("asof", "x", -8, 0, 7), "mx": Agg("max", "x", -1)}


def table(df, cols):
    p = df.toPandas()
    p["T"] = p["T"].astype(str)
    return p.set_index(["T", "DTID"]).sort_index()[cols].astype(float)


def test_month_frames_equal_fanout(panel):
    df, _ = panel
    g = Grid("2000-01-01", "2001-12-01")
    a = table(A.win_agg(df, g, AGGS, path="month"), list(AGGS))
    b = table(A.win_agg(df, g, AGGS, path="fanout"), list(AGGS))
    a = a.loc[a.index.intersection(b.index)]
    assert len(a) == len(b) > 100
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


def test_nothing_after_t_matters(panel):
    df, _ = panel
    g = Grid("2001-01-01", "2001-01-01")
    cut = df.withColumn("x", F.when(F.col("date") < "2001-01-01", F.col("x")).otherwise(F.lit(99.0)))
    pd.testing.assert_frame_equal(table(A.win_agg(df, g, AGGS), list(AGGS)), table(A.win_agg(cut, g, AGGS), list(AGGS)))


@pytest.mark.parametrize("grid", [Grid("2000-06-01", "2001-03-01"), Grid("2000-06-07", "2000-09-30", "7D")])
def test_asof_grid_brute_force(panel, grid):
    df, pdf = panel
    got = A.asof_grid(df, grid, 5, ["x"], -6).toPandas()
    got = {(str(a), b, c): d for a, b, c, d in zip(got["T"], got["DTID"], got["j"], got["src"])}
    want = {}
    for t in grid.dates():
        for k, g in pdf.groupby("DTID"):
            for j in range(5):
                p = A.add_months(t, -j)
                ok = [d for d in g["date"] if (d < t if j == 0 else d <= p) and A.add_months(t, -6) <= d < t]
                if ok:
                    want[(str(t), k, j)] = max(ok)
    assert got == want


def test_asof_join_keeps_nulls_of_matched_row(spark):
    l = spark.createDataFrame([("a", day("2020-01-05")), ("a", day("2020-01-01")), ("b", day("2020-01-05")), (None, day("2020-01-05"))], "k string, d date")
    r = spark.createDataFrame([("a", day("2020-01-01"), 1.0), ("a", day("2020-01-03"), None)], "k string, d date, v double")
    got = {(x.k, x.d): (x.v, x.src) for x in A.asof_join(l, r, "d", "k", keep_date="src").collect()}
    assert got == {("a", day("2020-01-05")): (None, day("2020-01-03")), ("a", day("2020-01-01")): (1.0, day("2020-01-01")), ("b", day("2020-01-05")): (None, None), (None, day("2020-01-05")): (None, None)}
    strict = {(x.k, x.d): x.v for x in A.asof_join(l, r, "d", "k", allow_exact=False).collect()}
    assert strict[("a", day("2020-01-01"))] is None


def test_asof_series_keeps_early_rows(spark):
    l = spark.createDataFrame([(day("2020-01-02"),), (day("2020-01-20"),), (day("2020-03-01"),), (None,)], "date date")
    r = spark.createDataFrame([(day("2020-01-10"), 1.0), (day("2020-02-01"), 2.0)], "date date, v double")
    got = {x.date: x.v for x in A.asof_series(l, r, "date").collect()}
    assert got == {day("2020-01-02"): None, day("2020-01-20"): 1.0, day("2020-03-01"): 2.0, None: None}


@pytest.mark.parametrize("n", [3, 19_999, 20_001])
def test_asof_series_same_result_at_any_size(spark, n):
    """Former sizes of a switch; equal dates go to the largest value whatever the order of rows."""
    r = spark.range(n).select(F.expr("date_add(date'1990-01-01', cast(id % 9000 as int))").alias("date"), (F.col("id") * 7919 % 10007).cast("double").alias("v"))
    l = spark.createDataFrame([(day("1990-01-03"),), (day("1989-12-31"),), (day("2030-05-05"),), (day("1990-01-01"),)], "date date")
    rows = {}
    for x in r.collect():
        rows[x.date] = max(x.v, rows.get(x.date, -1.0))
    want = {}
    for x in l.collect():
        past = [k for k in rows if k <= x.date]
        want[x.date] = rows[max(past)] if past else None
    assert {x.date: x.v for x in A.asof_series(l, r, "date").collect()} == want


def test_monthly_deviation_at_large_level(spark):
    rows = [("a", day("2020-01-01") + dt.timedelta(days=k), 1e9 + k % 5) for k in range(120)] + [("b", day("2020-01-01") + dt.timedelta(days=k), float(k)) for k in range(0, 120, 40)]
    p = spark.createDataFrame(rows, "DTID string, date date, x double")
    g = A.Grid("2020-02-01", "2020-06-01")
    aggs = {"s": A.Agg("std", "x", -3), "sp": A.Agg("stdp", "x", -1)}
    month, fan = ({(r.T, r.DTID): (r.s, r.sp) for r in A.win_agg(p, g, aggs, path=k).collect()} for k in ("month", "fanout"))
    for k, v in fan.items():
        for x, y in zip(v, month[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-6 * max(1.0, x), (k, v, month[k])


def test_overlap_join_brute_force(spark):
    rng = np.random.default_rng(1)
    iv = [("k", day("2000-01-01") + dt.timedelta(int(a)), None if b > 380 else day("2000-01-01") + dt.timedelta(int(a + b)), i) for i, (a, b) in enumerate(zip(rng.integers(0, 900, 60), rng.integers(0, 400, 60)))]
    dates = [day("1999-12-01") + dt.timedelta(i) for i in range(0, 1500, 7)]
    got = {r.d: r.n for r in A.overlap_join(spark.createDataFrame([("k", d) for d in dates], "k string, d date"), spark.createDataFrame(iv, "k string, a date, b date, n int"), "d", "k", "a", "b", ["n"]).collect()}
    want = {d: min([n for _, a, b, n in iv if a <= d and (b is None or d <= b)], default=None) for d in dates}
    assert got == want


def test_ranks_and_quantiles_with_hot_groups_and_ties(spark):
    rng = np.random.default_rng(2)
    g = np.where(rng.random(4000) < 0.5, "hot", np.char.add("g", rng.integers(0, 20, 4000).astype(str)))
    x = np.where(rng.random(4000) < 0.3, 0.0, np.round(rng.normal(size=4000), 2) * 10.0 ** rng.integers(-3, 6, 4000))
    pdf = pd.DataFrame({"g": g, "id": np.arange(4000), "x": x})
    df = spark.createDataFrame(pdf)
    got = X.rank_pct(df, ["x"], ["g"], ["id"]).toPandas().set_index("id")["x"].sort_index()
    want = pdf.groupby("g")["x"].rank(pct=True)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12)
    q = X.group_quantiles(df, ["g"], {"a": ("x", 0.05), "b": ("x", 0.5), "c": ("x", 0.99), "lo": ("x", 0.0), "hi": ("x", 1.0)}).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.99), ("lo", 0.0), ("hi", 1.0)):
        np.testing.assert_allclose(q[name], pdf.groupby("g")["x"].quantile(p).sort_index(), rtol=1e-12)


def test_bucket_keeps_order(spark):
    v = sorted([-1e300, -5.0, -1e-9, 0.0, 1e-300, 1e-5, 0.9999, 1.0, 1.0001, 7.5, 1e12, float("inf"), float("-inf")])
    b = [r.b for r in spark.createDataFrame([(x,) for x in v], "x double").select("x", bucket_of("x").alias("b")).orderBy("x").collect()]
    assert b == sorted(b)


def test_cumulative_share_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": "one", "id": [f"{i:05d}" for i in range(500)], "x": np.round(rng.exponential(size=500), 1)})
    got = X.cumulative_share(spark.createDataFrame(pdf), "x", ["g"], "id", "s").toPandas().set_index("id")["s"].sort_index()
    p = pdf.sort_values(["x", "id"])
    want = (p["x"].cumsum() / p["x"].sum()).set_axis(p["id"]).sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 50), "x1": rng.normal(size=100), "x2": rng.normal(size=100) + 5, "x3": rng.normal(size=100) * 100})
    pdf["y"] = 1 + 2 * pdf.x1 - 3 * pdf.x2 + 0.01 * pdf.x3 + rng.normal(size=100)
    co = S.group_ols(spark.createDataFrame(pdf), "k", "y", ["x1", "x2", "x3"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        M = np.column_stack([np.ones(len(g)), g.x1, g.x2, g.x3])
        b, ssr, *_ = np.linalg.lstsq(M, g.y, rcond=None)
        np.testing.assert_allclose(co.loc[k, ["b0", "b1", "b2", "b3"]].to_numpy(dtype=float), b, rtol=1e-8)
        assert co.loc[k, "ssr"] == pytest.approx(ssr[0], rel=1e-8)
        assert co.loc[k, "r2"] == pytest.approx(1 - ssr[0] / ((g.y - g.y.mean()) ** 2).sum(), rel=1e-8)


def test_collinear_regressor_is_ignored(spark):
    pdf = pd.DataFrame({"k": "a", "x1": np.arange(10.0), "x2": 2 * np.arange(10.0), "y": 3 * np.arange(10.0) + 1})
    r = S.group_ols(spark.createDataFrame(pdf), "k", "y", ["x1", "x2"]).collect()[0]
    assert (r.b1, r.b2) == pytest.approx((3.0, 0.0)) and r.ssr == pytest.approx(0, abs=1e-9)


def test_newey_west_definition(spark):
    x = np.random.default_rng(5).normal(size=60)
    pdf = pd.DataFrame({"k": "a", "date": pd.date_range("2000-01-31", periods=60, freq="ME").date, "x": x})
    df = spark.createDataFrame(pdf)
    h, t = x - x.mean(), len(x)
    v = (h ** 2).sum() + sum(2 * (1 - z / 13) * sum(h[i] * h[i + z] for i in range(1, t - z)) for z in range(1, 13))
    assert S.nw_std(df, "k", "date", "x").collect()[0].nw == pytest.approx(np.sqrt(v / t))
    full = (h ** 2).sum() + sum(2 * (1 - z / 13) * (h[: t - z] * h[z:]).sum() for z in range(1, 13))
    assert S.nw_std(df, "k", "date", "x", textbook=True).collect()[0].nw == pytest.approx(np.sqrt(full / t / t))
    assert S.nw_std(df.limit(13), "k", "date", "x").collect()[0].nw is None


def test_numeric_helpers(spark):
    r = spark.range(1).select(fdiv(F.lit(1.0), F.lit(0.0)).alias("a"), fdiv(F.lit(-1.0), F.lit(0.0)).alias("b"), fdiv(F.lit(0.0), F.lit(0.0)).alias("c"), fln(F.lit(0.0)).alias("d"),
                              fln(F.lit(-1.0)).alias("e"), fpow(F.lit(-8.0), 1 / 3).alias("f")).collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (float("inf"), float("-inf"), None, float("-inf"), None, None)


def test_stage_leaves_scans_alone(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t")).filter("id > 2")
    assert stage(d) is d
    g = d.groupBy("id").count()
    s = stage(g)
    assert weight(g) == 1 and weight(s) == 0 and sorted(s.collect()) == sorted(g.collect())


# ------------------------------------------------------------------ distributions
TAUS = [0.00005, 0.0001, 0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075] + [i / 20 for i in range(2, 19)] + [0.925, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9999, 0.99995]


def test_implied_moments_of_a_normal(spark):
    from statistics import NormalDist

    q = [NormalDist(0.02, 0.1).inv_cdf(t) for t in TAUS]
    df = spark.createDataFrame([(q,)], "q array<double>")
    lin = D.moments(df, TAUS).collect()[0]
    cub = D.moments(df, TAUS, method="cubic").collect()[0]
    assert cub.m0 == pytest.approx(1, abs=2e-3) and not cub.LinearFlag and not cub.Error
    assert lin.m1 == pytest.approx(0.02, abs=2e-3) and cub.m1 == pytest.approx(0.02, abs=1e-3)
    assert lin.std == pytest.approx(0.1, rel=0.03) and cub.std == pytest.approx(0.1, rel=0.01)
    assert abs(cub.skew) < 0.05 and cub.kurtosis == pytest.approx(3, abs=0.2)


def test_quantile_repair_and_truncation(spark):
    q = [-1.0, -1.0, -1.0, -0.5, -0.5, 0.0, 0.5, 0.4, 1.0]
    taus = [0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    df = spark.createDataFrame([(q,)], "q array<double>")
    p = df.select(D.repair(F.col("q"), taus).alias("p")).collect()[0].p
    assert [x.y for x in p] == taus[2:]
    assert [x.x for x in p] == pytest.approx([-1.0, -0.5, -0.4999, 0.0, 0.5, 0.5001, 1.0])
    m = D.moments(df, taus).collect()[0]
    assert m.m0 > 0 and -1 <= m.m1 <= 1
    low = D.moments(spark.createDataFrame([([-1.4, -1.2, -0.8, 0.0, 0.3, 0.5, 0.9],)], "q array<double>"), [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]).collect()[0]
    assert -1 < low.m1 < 0.5


def test_crps_against_numeric_integral(spark):
    taus, q = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], [-3.0, -1.1, -0.4, 0.1, 0.6, 1.2, 3.0]
    for y in (-2.0, -0.7, 0.1, 0.9, 2.5):
        got = D.crps(spark.createDataFrame([(q, y)], "q array<double>, y double"), taus).collect()[0].crps
        x = np.linspace(min(y, q[1]), max(y, q[-2]), 400001)
        f = np.interp(x, q[1:-1], taus[1:-1])
        assert got == pytest.approx(np.trapezoid((f - (x >= y)) ** 2, x), abs=1e-4)


# ------------------------------------------------------------------ cleaning
def series(spark, **cols):
    n = len(next(iter(cols.values())))
    pdf = [("a", day("2020-01-01") + dt.timedelta(i), *[v[i] for v in cols.values()]) for i in range(n)]
    return spark.createDataFrame(pdf, "DTID string, date date, " + ", ".join(f"{c} double" for c in cols))


def col(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_reversal_and_outlier_rules(spark):
    assert col(C.repair_reversals(series(spark, RI=[1.0, 2.5, 1.05, 0.4, 1.0, 1.0])), "RI") == pytest.approx([1.0, 1.025, 1.05, 1.025, 1.0, 1.0])
    out = C.null_outlier_returns(series(spark, RI=[1.0, 7.0, 2.0]))
    assert col(out, "RI") == [1.0, None, 2.0]


def test_fill_and_trailing_padding(spark):
    assert col(C.fill_after_first(series(spark, VOL=[None, 3.0, None, 2.0])), "VOL") == [None, 3.0, 0.0, 2.0]
    d = series(spark, PRC=[1.0, None, 2.0] + [None] * 5)
    assert C.drop_trailing_padding(d, longest=4).count() == 3
    assert C.drop_trailing_padding(d, longest=5).count() == 8


def test_market_value_and_ticker(spark):
    d = spark.createDataFrame([("f", "1", day("2020-01-01"), 2.0), ("f", "2", day("2020-01-01"), 3.0), (None, "3", day("2020-01-01"), 4.0), ("z", "4", day("2020-01-01"), None)], "FTID string, DTID string, date date, MCshare double")
    got = {r.DTID: r.MC for r in C.firm_market_value(d).collect()}
    assert got == {"1": 5.0, "2": 5.0, "3": 4.0, "4": None}
    t = spark.createDataFrame([("@:AB",), ("@X@",), ("Q",), (None,)], "t string").select(C.normalise_ticker(F.col("t")).alias("t"))
    assert [r.t for r in t.collect()] == ["AB", "X@", "Q", None]
