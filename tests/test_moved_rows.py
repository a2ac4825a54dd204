"""Rows are moved once and stay with their id: what is written to disk must not grow with the number of steps."""
import datetime as dt

from pyspark.sql import functions as F

from panelquant.operators import clean as C
from panelquant.operators.asof import interval_join, valid_at
from panelquant.sources import pipelines as PL

D = dt.date


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_intervals_looked_up_like_joined(spark):
    left = spark.createDataFrame([(k, D(2000, m, 1)) for k in "abcd" for m in range(1, 13)] + [(None, D(2000, 1, 1)), ("a", None)], "k string, date date")
    right = spark.createDataFrame([("a", D(2000, 3, 1), D(2000, 5, 31), 1), ("a", D(2000, 4, 1), None, 2), ("b", D(2000, 2, 1), D(2000, 2, 20), 3), ("b", D(2000, 2, 1), None, 4), ("b", D(2000, 9, 1), D(2000, 9, 1), 5),
                                   ("c", None, None, 6), (None, D(1990, 1, 1), None, 7)], "k string, a date, b date, x int")
    rows = lambda df: sorted(map(repr, df.select("k", "date", "x").collect()))
    assert rows(valid_at(left, right, "date", "k", "a", "b")) == rows(interval_join(left, right, "date", "k", "a", "b"))


def _prices(spark, n=30):
    # id 2 ends in a run of missing prices, id 1 trades to the end; both belong to one firm
    rows = [(str(i), D(2000, 1, 1) + dt.timedelta(days=k), None if i == 2 and k >= 5 else 10.0 + i, 100.0 + k, 5.0, 1000.0) for i in (1, 2) for k in range(n)]
    return spark.createDataFrame(rows, "DTID string, date date, PRCunpadded double, RI double, VOL double, SHROUT double").select(
        "*", F.coalesce("PRCunpadded", F.lit(12.0)).alias("PRC"), F.col("RI").alias("RI_OC"), F.lit(13.0).alias("H"), F.lit(9.0).alias("L"), F.lit(9.0).alias("BID"), F.lit(13.0).alias("ASK"), F.lit(1.0).alias("AF"))


def test_international_panel_moves_rows_once(spark):
    static = spark.createDataFrame([("1", "f", "EU"), ("2", "f", "EU")], "DTID string, FTID string, region string")
    p = PL.international_panel(_prices(spark), static)
    assert moves(p) == 2  # prices and the static table, each once
    got = {(r["DTID"], r["date"].day): r for r in p.collect()}
    assert sorted(got) == [("1", k) for k in range(1, 31)] + [("2", k) for k in range(1, 6)]
    assert got["1", 1]["MC"] == 11.0 * 1 + 12.0 * 1 and got["1", 20]["MC"] == 11.0


def test_daily_panel_moves_rows_once(spark):
    days = [D(2000, 1, 3) + dt.timedelta(days=k) for k in range(6)]
    raw = spark.createDataFrame([(1, p, int(d.strftime("%Y%m%d")), 10.0 * p, 100.0, 0.5, 7.0, 1.0 if k == 2 else None, 1.0, 2.0, 1.0, 2.0) for p in (11, 12) for k, d in enumerate(days)],
                                "permco long, permno long, yyyymmdd int, dlyprc double, shrout double, dlyret double, dlyvol double, disfacshr double, dlybid double, dlyask double, dlylow double, dlyhigh double")
    fixed = [F.lit(v).alias(k) for k, v in {**PL.TRADING, **PL.SHARE}.items()]
    issue = spark.createDataFrame([(11, days[1], days[4]), (12, days[0], None)], "permno long, secinfostartdt date, secinfoenddt date").select("*", F.lit("N").alias("primaryexch"), *fixed)
    issuer = spark.createDataFrame([(1, D(1990, 1, 1), None, "Y", "CORP")], "permco long, issinfostartdt date, issinfoenddt date, usincflg string, issuertype string")
    p = PL.daily_panel(raw, issue, issuer)
    assert moves(p) == 1
    got = {(r["DTID"], r["date"]): r for r in p.collect()}
    assert len(got) == 4 + 6 and ("11", days[0]) not in got
    assert got["11", days[1]]["MC"] == 23.0 and got["11", days[4]]["RI"] == 1.5 ** 4
    assert got["12", days[0]]["AF"] == 2.0 and got["12", days[5]]["AF"] == 1.0


def test_trailing_padding_is_dropped_beside_other_windows(spark):
    p = C.drop_trailing_padding(_prices(spark), "PRCunpadded", longest=20)
    assert moves(p) == 1
    assert p.filter("DTID = '2'").count() == 5 and p.filter("DTID = '1'").count() == 30
    assert C.drop_trailing_padding(_prices(spark), "PRCunpadded", longest=25).count() == 60


def _firms(spark):
    from panelquant.operators.asof import Grid
    from panelquant.signals import SignalContext

    years = range(1996, 2000)
    ft = [(str(i), str(i), D(y, 12, 31), D(y + 1, 6, 30), "A" if i % 2 else "B", 100.0 * i + y - 1990, 10.0 * i + y - 1996, 50.0 * i) for i in range(1, 5) for y in years]
    dt_ = [(str(i), D(y, m, 15), 1000.0 * i + 12 * y + m) for i in range(1, 5) for y in years for m in range(1, 13) if i != 4]
    ft = spark.createDataFrame(ft, "FTID string, DTID string, FinYearEnd date, date date, INDM3 string, at double, capx double, MC double")
    ft = ft.select("*", *[F.col("at").alias(x) for x in ("sale", "xsga", "invt", "rect", "cogs")], F.lit(None).cast("double").alias("seq"), F.lit(None).cast("double").alias("ceq"),
                   *[F.lit(None).cast("double").alias(x) for x in ("pstk", "pstkl", "pstkrv")], (F.col("at") / 2).alias("lt"))
    p = spark.createDataFrame(dt_, "DTID string, date date, MC double")
    return SignalContext({"FT": ft, "dt": p}, Grid("1997-07-01", "2001-06-01"))


def test_statements_do_not_meet_prices_that_nobody_reads(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    x = _firms(spark)
    assert "map_from_entries" not in plan(x.cls("AssetGrowth")) and "Join LeftOuter" not in plan(x.cls("AssetGrowth"))
    assert moves(x.cls("AssetGrowth")) == 1
    got = {(str(r["T"]), r["FTID"]): r["BM"] for r in x.cls("BookToMarket").collect()}
    be = lambda i, y: (100.0 * i + y - 1990) / 2
    import math

    assert got["1998-07-01", "2"] == math.log(be(2, 1997) / (2000.0 + 12 * 1998 + 6))  # recent: the last value before T
    assert got["1998-06-01", "2"] == math.log(be(2, 1996) / (2000.0 + 12 * 1998 + 5))
    assert got["1998-07-01", "4"] == math.log(be(4, 1997) / 200.0)  # no prices: the statement's own value
    assert got["2001-06-01", "1"] == math.log(be(1, 1999) / (1000.0 + 12 * 1999 + 12)) and got["2000-12-01", "3"] == math.log(be(3, 1999) / (3000.0 + 12 * 1999 + 12))


def test_industry_means_move_no_rows(spark):
    a = _firms(spark).cls("AbarbanellBushee")
    assert moves(a) <= 2  # statements once, and the means
    assert a.filter("indCAPEX is not null").count() > 0


def test_copies_to_dates_keep_their_partitions(spark):
    from panelquant.operators.asof import Grid, snapshot

    x = _firms(spark)
    assert snapshot(x.sources["FT"], Grid("1997-07-01", "2001-06-01"), -258, 0, ["at"], "FTID").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
