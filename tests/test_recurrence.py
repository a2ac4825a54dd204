"""Recurrences composed in parallel, held against a plain loop."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.operators import series as S


def loop(x, a):
    y, out = None, []
    for v in x:
        y = v if y is None else (1 - a) * y + a * v
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 70_000])
def test_path_of_one_series_equals_the_loop(spark, n):
    x = F.sin(F.col("id") * 0.37) * F.when(F.col("id") % 1000 == 5, 1e6).otherwise(1.0)
    df = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id")).alias("date"), x.alias("x"))
    got = S.ewma_path(df, "k", "date", "x", {"p": 0.1, "q": 0.001, "one": 1.0}).orderBy("date").toPandas()
    assert list(got.columns) == ["k", "date", "p", "q", "one"] and len(got) == n
    x = np.sin(np.arange(n) * 0.37) * np.where(np.arange(n) % 1000 == 5, 1e6, 1.0)
    for c, a in (("p", 0.1), ("q", 0.001), ("one", 1.0)):
        np.testing.assert_allclose(got[c], loop(x, a), rtol=1e-9, atol=1e-9)


def test_no_window_holds_a_whole_series(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("date"), F.rand(1).alias("x"))
    out = S.ewma_path(df, "k", "date", "x", {"y": 0.1})
    assert "MapInPandas" not in out._jdf.queryExecution().toString() and "FlatMapGroups" not in out._jdf.queryExecution().toString()
    n = df.select(F.lit(1).alias("k"), (F.col("date") + 1).alias("i"), F.lit(0.5).alias("m"), F.col("x").alias("c"))
    runs = S.affine_path(n, "k", "i", {"y": ("m", "c")})
    assert runs.count() == 5000
    assert n.groupBy(F.floor((F.col("i") - 1) / S.SCAN_ROWS)).count().agg(F.max("count")).first()[0] == S.SCAN_ROWS


def test_nulls_empty_and_null_key(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), (None, 1, 5.0), (None, 2, 7.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, date int, x double")
    got = {(r["k"], r["date"]): r["y"] for r in S.ewma_path(df, "k", "date", "x", {"y": 0.5}).collect()}
    assert got == {("a", 1): 1.0, ("a", 3): 1.5, (None, 1): 5.0, (None, 2): 6.0}
    assert S.ewma_path(df.limit(0), "k", "date", "x", {"y": 0.5}).count() == 0


def test_multipliers_that_differ_by_row(spark):
    rng = np.random.default_rng(3)
    m, c = rng.choice([0.0, 0.5, -1.2, 1.0], 3000), rng.normal(size=3000)
    df = spark.createDataFrame([(7, i + 1, float(m[i]), float(c[i])) for i in range(3000)], "k int, i int, m double, c double")
    got = np.array([r["y"] for r in S.affine_path(df, "k", "i", {"y": ("m", "c")}).orderBy("i").collect()])
    y, want = 0.0, []
    for a, b in zip(m, c):
        y = a * y + b
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
