"""Work that must not grow faster than the input: shared expressions once, no copies of rows per grid date."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelquant.operators import distribution as D
from panelquant.operators.asof import Grid
from panelquant.plans import panel as P

TAUS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_density_repairs_a_vector_once(spark):
    q = spark.createDataFrame([("a", "1", [float(i) for i in range(7)])], "date string, DTID string, q array<double>").select("date", "DTID", F.transform("q", lambda v: v * 2).alias("q"))
    d = D.density(q, TAUS)
    assert plan(d).count("try_element_at") + plan(d).count("aggregate(") <= 4
    assert [r["x"] for r in d.orderBy("pos").collect()] == [2.0, 4.0, 6.0, 8.0]


def test_quantiles_of_joined_months(spark):
    from panelquant.operators.asof import month_quantiles

    rng = np.random.default_rng(3)
    rows = [("1", dt.date(2000, 1, 1) + dt.timedelta(days=int(k)), float(rng.normal())) for k in range(0, 400, 3)]
    p = spark.createDataFrame(rows, "DTID string, date date, r double")
    got = {r["T"]: r for r in month_quantiles(p, Grid("2000-03-01", "2001-01-01"), "r", TAUS, 2, now={"y": F.sum("r")}).collect()}
    assert len(got) == 11
    for T, r in got.items():
        y, m = divmod(T.year * 12 + T.month - 3, 12)
        v = [x for _, d, x in rows if dt.date(y, m + 1, 1) <= d < T]
        assert r["n"] == len(v) and np.allclose(r["q"], np.quantile(v, TAUS), atol=1e-12)
        assert np.isclose(r["y"], sum(x for _, d, x in rows if (d.year, d.month) == (T.year, T.month)))


def test_characteristics_copy_no_rows(spark):
    rows = [("1", dt.date(2000, 1, 3) + dt.timedelta(days=k), 10.0 + k, 5.0, 2.0, 100.0 + k, "f", "EU") for k in range(80)]
    p = spark.createDataFrame(rows, "DTID string, date date, PRC double, MC double, VOL double, RI double, FTID string, region string")
    c = P.characteristics(p, Grid("2000-02-01", "2000-06-01"))
    assert "Join" not in plan(c)
    got = {str(r["date"]): r for r in c.collect()}
    assert sorted(got) == ["2000-02-01", "2000-03-01"]
    assert got["2000-03-01"]["PRC"] == 67.0 and got["2000-02-01"]["VOL"] is None
    assert np.isclose(got["2000-03-01"]["VOL"], np.mean([2 * (10.0 + k) for k in range(58)]) / 1e6)


def test_training_rows_travel_in_blocks(spark):
    from panelquant.models import quantile as Q

    rows = [("d", str(i), float(i % 7), float(i % 5), 0.1 * i) for i in range(50)] + [("d", "x", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date string, DTID string, a double, b double, y double").coalesce(1)
    spec = Q.Spec(["a", "b"], "y", (0.5,))
    blocks = Q._columns(df, spec, ["date", "DTID"]).mapInPandas(Q._blocks(spec), Q._BLOCK).collect()
    assert len(blocks) == 1 and blocks[0]["n"] == 50  # the row with a missing input is not trained on
    X, y, h, _ = Q._unpack(spec, blocks[0]["n"], blocks[0]["h"], blocks[0]["v"])
    assert X.shape == (50, 2) and np.allclose(X[8], [1.0, 3.0]) and np.isclose(y[8], 0.8) and len(set(h)) == 50
    assert np.isfinite(Q.fit_quantile(df, ["a", "b"], "y", (0.5,), steps=3).history).all()


def test_two_close_losses_cost_no_digits(spark):
    from panelquant.signals.fundamental import _signed_lines

    e = 2e-6
    pts = [(0.1, 1.0), (0.2, 1.3), (0.5, 1.9), (0.9, 2.2), (-0.3, 0.5), (-0.3 - e, 0.7)]
    s = spark.createDataFrame([("2000-01-01", "f", r, y) for r, y in pts], "T string, FTID string, ret double, earn double")
    r = _signed_lines(s).collect()[0]
    b1, (b0, a0) = (0.7 - 0.5) / -e, np.polyfit([p[0] for p in pts[:4]], [p[1] for p in pts[:4]], 1)
    d = 0.6 - b1 * (-0.3 - e / 2) - a0
    assert np.isclose(r["ECon"], (d + b0) / d, rtol=1e-9)
    fit = sum((y - a0 - b0 * x) ** 2 for x, y in pts[:4])
    assert np.isclose(r["ETime"], 1 - fit / (6 * np.var([p[1] for p in pts])), rtol=1e-9)


def test_weekly_tail_index_copies_rows_per_period_not_per_date(spark, monkeypatch):
    import panelquant.functions.stage as stage_module
    from panelquant.signals import SignalContext

    rng = np.random.default_rng(5)
    days = [dt.date(1996, 1, 1) + dt.timedelta(days=k) for k in range(1400)]
    rows = [(i, d, float(rng.normal(0, 0.02)), float(100 + rng.normal())) for i in ("1", "2", "3") for d in days]
    p = spark.createDataFrame(rows, "DTID string, date date, r double, RI double").filter("r is not null")
    written, write = [], stage_module.materialise
    monkeypatch.setattr(stage_module, "materialise", lambda df: written.append(df.count()) or write(df))
    grid = Grid("1999-01-04", "1999-10-25", "7D")
    out = SignalContext({"dt": p}, grid).cls("TailRisk").filter("DTID = '1'").orderBy("T").limit(1).collect()[0]
    assert max(written) <= 31 * len(rows)  # it was rows x grid dates
    T, back = grid.dates()[0], lambda k: dt.date(*[(1999 * 12 - k) // 12, (1999 * 12 - k) % 12 + 1], 4)
    r = np.array([[x[2] for x in rows if x[0] == i] for i in ("1", "2", "3")])
    pos, pts = {d: k for k, d in enumerate(days)}, []
    for j in range(36):
        a, b = pos[back(j + 1)], pos[back(j)]
        v = r[:, a:b].ravel()
        q = np.quantile(v, 0.05)
        pts.append((rows[b - (j == 0)][3] / rows[a][3] - 1, np.mean(np.log(v[v < q] / q))))
    y, x = np.array(pts).T
    assert out["T"] == T and np.isclose(out["TailRisk"], np.polyfit(x, y, 1)[0])


def test_prices_are_found_per_statement_point(spark, monkeypatch):
    import __spark_entry__ as entry
    import panelquant.functions.stage as stage_module
    from panelquant.signals.fundamental import _found, _last_at

    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    panel = spark.createDataFrame([("1", day(k), float(k)) for k in (3, 4, 9, 30)] + [("2", day(5), None)], "DTID string, date date, RI double")
    pts = spark.createDataFrame([("1", day(k)) for k in (1, 4, 8, 8, 20, 40)] + [("2", day(6)), ("3", day(6)), (None, day(6))], "DTID string, _d date")
    got = _last_at(pts, panel, F.col("date"), ["RI"])
    r = {(x["DTID"], (x["_d"] - day(0)).days): x["v"] for x in pts.filter("DTID is not null").join(got, "DTID", "left").select("DTID", "_d", _found("_g", F.col("_d")).alias("v")).collect()}
    assert {k: v and (v["pd"] - day(0)).days for k, v in r.items()} == {("1", 1): None, ("1", 4): 4, ("1", 8): 4, ("1", 20): 9, ("1", 40): 30, ("2", 6): 5, ("3", 6): None}
    assert r["1", 20]["RI"] == 9.0 and r["2", 6]["RI"] is None  # a row is taken whole
    written, write = [], stage_module.materialise
    monkeypatch.setattr(stage_module, "materialise", lambda df: written.append(df.columns) or write(df))
    entry.queries()["fu57_earnings_features"](spark, "/root/testdata/sf0.001")
    assert not [c for c in written if "T" in c]  # statements copied to grid dates were written three times, all items wide


def test_a_step_passes_rows_once_per_member(monkeypatch):
    import pandas as pd

    from panelquant.models import quantile as Q

    rng = np.random.default_rng(1)
    spec = Q.Spec(["a", "b"], "y", (0.1, 0.5, 0.9), stage2=["c"], y2="z", scale="s", hidden=(3,), heads=3)
    pdf = pd.DataFrame({c: np.abs(rng.normal(size=400)) for c in Q._block_names(spec)} | {"h": rng.integers(-2**62, 2**62, 400)})
    block = list(Q._blocks(spec)(iter([pdf])))[0]
    like, vec = Q.init_params(spec, 1), [Q._flat(Q.init_params(spec, i)) + 0.1 * rng.normal(size=Q._flat(Q.init_params(spec, i)).size) for i in (1, 2)]
    sizes, one = [], Q.evaluate_batch
    monkeypatch.setattr(Q, "evaluate_batch", lambda p, sp, X, *a, **k: sizes.append(len(X)) or one(p, sp, X, *a, **k))
    out = list(Q._gradients(spec, vec, like, [2, 3], 0.2)(iter([block])))[0]
    assert sizes == [400, 400]  # it was two passes per member, over copies of its training and of its hold-out rows
    X, y, h, two = Q._unpack(spec, 400, block["h"][0], block["v"][0])
    for i, v in enumerate(vec):
        tr = Q._mix(h, 2 + i) >= 0.2
        loss = lambda u, m: one(Q._unflat(u, like), spec, X[m], y[m], *[a[m] for a in two], grad=False)[0].sum()
        g = [(loss(v + 1e-6 * e, tr) - loss(v - 1e-6 * e, tr)) / 2e-6 for e in np.eye(len(v))]
        assert np.allclose(out["g"][i], g, atol=1e-3)
        assert np.allclose(out["st"][i], [loss(v, tr), tr.sum(), loss(v, ~tr), (~tr).sum()])


def test_every_distinct_lag_is_evaluated_once(spark):
    from panelquant.signals import SignalContext
    from panelquant.signals.base import statement_signals

    eps = [1.0, 1.2, 1.5, 1.4, 1.8, 2.0, 2.1, 2.6]
    rows = [(dt.date(2010, 1, 1), "f", dt.date(2001 + k, 12, 31), v) for k, v in enumerate(eps)]
    snap = spark.createDataFrame(rows, "T date, FTID string, date date, epspx double")
    ctx = SignalContext({}, Grid("2010-01-01", "2010-01-01"), _cache={"_ft": snap})
    df = statement_signals(ctx, ["EarningsConsistency"])
    width = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        assert plan(df).count("lag(") <= 12  # six lags of the item and of the window's mark; it was several hundred
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", width)
    g = [1 + (eps[k] - eps[k - 1]) / ((eps[k - 1] + eps[k - 2]) / 2) for k in range(3, 8)]
    assert np.isclose(df.collect()[0]["EConsit"], np.prod(g) ** 0.2 - 1)


def test_holdings_are_not_copied_to_dates_before_a_join(spark):
    from panelquant.operators import portfolio as R

    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    sig = spark.createDataFrame([(day(0), "a", "x"), (day(0), "b", "x"), (day(0), "c", "x"), (day(5), "a", "x")], "date date, DTID string, Var string")
    ret = spark.createDataFrame([("a", day(2), "EU", 10.0, 0.5), ("a", day(3), "EU", 10.0, None), ("a", day(4), "EU", 11.0, -1.0), ("b", day(1), "EU", 30.0, 0.1),
                                 ("a", day(6), "EU", 12.0, 0.2), ("z", day(7), "EU", 1.0, 0.0)], "DTID string, date date, region string, MC double, r double")
    w = R.weights(sig, ret, "VW")
    text = plan(w)
    assert text.index("Generate explode") < text.index("Window")  # the copies are made above the last ordered step
    got = {(r["DTID"], (r["date"] - day(0)).days): (round(r["r"], 9), round(r["wgt"], 9)) for r in w.collect()}
    assert got == {("a", 1): (0, 0.25), ("a", 2): (0.5, 0.25), ("a", 3): (0, 0.375), ("a", 4): (-1, 0.375), ("b", 1): (0.1, 0.75), ("b", 2): (0, 0.825), ("b", 3): (0, 0.825),
                   ("b", 4): (0, 0.825), ("a", 6): (0.2, 1), ("a", 7): (0, 1.2)}
    p = R.portfolios(sig, ret, "VW").filter("region = 'EU'")
    assert {((r["date"] - day(0)).days, round(r["ret"], 9)) for r in p.collect()} == {(1, 0.075), (2, 0.125), (3, 0), (4, -0.375), (6, 0.2), (7, 0)}
    assert "Generate" not in plan(R._contributions(sig, ret, "VW", ["Var"]))


def test_sample_moments_come_with_the_quantiles(spark):
    from panelquant.operators.asof import month_quantiles
    from panelquant.queries.analysis import _implied

    rng = np.random.default_rng(4)
    rows = [("1", dt.date(2000, 1, 1) + dt.timedelta(days=int(k)), float(rng.normal())) for k in range(0, 200, 3)]
    p = spark.createDataFrame(rows, "DTID string, date date, r double")
    got = month_quantiles(p, Grid("2000-03-01", "2000-07-01"), "r", TAUS, 2, now={"y": F.sum("r")}, spread=True).collect()
    assert len(got) == 5
    for r in got:
        v = [x for _, d, x in rows if (r["T"].month - 2) <= d.month < r["T"].month]
        assert r["n"] == len(v) and np.isclose(r["mean_t"], np.mean(v), atol=1e-12) and np.isclose(r["var_t"], np.var(v), atol=1e-12)
    assert plan(_implied(spark, "/root/testdata/sf0.001")).count("Relation [") == 4  # the panel's four tables once; it was built twice, its rows copied to 12 dates
