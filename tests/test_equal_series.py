"""Equal series get equal figures, whatever order their rows arrive in."""
import datetime as dt

from panelquant.operators import portfolio as R
from panelquant.queries.core import monthly


def test_mean_price_does_not_depend_on_row_order(spark):
    px = [0.1, 0.2, 0.3]  # added up this way 0.6000000000000001, backwards 0.6
    rows = [(k, dt.date(2000, 1, 3 + i), "EU", x, 1.0, 1.0, 0.0) for i, x in enumerate(px) for k in ("a", "b")]
    rows += [("c", dt.date(2000, 1, 3 + i), "EU", x / 2, 1.0, 1.0, 0.0) for i, x in enumerate(px)]
    rows = [r for r in rows if r[0] != "b"] + [r for r in reversed(rows) if r[0] == "b"]
    p = spark.createDataFrame(rows, "DTID string, date date, region string, PRC double, VOL double, MC double, r double").coalesce(1)
    m = monthly(spark, None, p)
    got = {r["DTID"]: r["p"] for r in m.collect()}
    assert got["a"] == got["b"] == (px[0] + px[1] + px[2]) / 3
    var = {r["DTID"]: r["Var"] for r in R.sorts(m, "v", "p", 3, "independent").collect()}
    assert var["a"] == var["b"] != var["c"]


def test_mean_price_skips_missing_values(spark):
    rows = [("a", dt.date(2000, 1, 3), "EU", 2.0, 1.0, 1.0, 0.0), ("a", dt.date(2000, 1, 4), "EU", None, 1.0, 1.0, 0.0), ("b", dt.date(2000, 1, 4), "EU", None, 1.0, 1.0, 0.0)]
    p = spark.createDataFrame(rows, "DTID string, date date, region string, PRC double, VOL double, MC double, r double")
    assert {r["DTID"]: r["p"] for r in monthly(spark, None, p).collect()} == {"a": 2.0, "b": None}
