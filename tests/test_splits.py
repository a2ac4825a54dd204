"""Walk-forward windows as unions of date blocks, held against every row and window."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelquant.models.splits import split_aggregates, split_rows, walk_forward


def made(spark):
    rng = random.Random(4)
    first = dt.date(1994, 1, 1)
    edge = [dt.date(1997, 11, 29), dt.date(1997, 11, 30), dt.date(1998, 1, 1), dt.date(1998, 12, 31), dt.date(1999, 1, 1), None]
    rows = [(rng.choice(["a", "b", None]), d, rng.choice([None, rng.random()])) for d in [*edge, *[first + dt.timedelta(days=rng.randrange(3000)) for _ in range(600)]] for _ in range(2)]
    return rows, spark.createDataFrame(rows, "k string, date date, x double")


def inside(rows, splits):
    for s in splits:
        for part, a, b in (("train", s["train_start"], s["train_end"]), ("valid", s["valid_start"], s["valid_end"])):
            for r in rows:
                if r[1] is not None and a <= r[1] <= b:
                    yield (r[0], s["valid_start"], part), r


@pytest.mark.parametrize("step,horizon,start", [(1, "M", "1973-01-01"), (2, "Q", "1995-06-15"), (3, "Y", "1998-02-01")])
def test_aggregates_and_rows_equal_every_row_and_window(spark, step, horizon, start):
    rows, df = made(spark)
    sp = walk_forward(spark, 1997, 2001, step, horizon, start)
    want = {}
    for key, r in inside(rows, sp.collect()):
        want.setdefault(key, []).append(r)
    out = split_aggregates(df, sp, "k", {"n": ("count", F.lit(1)), "m": ("count", "x"), "s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x")})
    got = {(r["k"], r["valid_start"], r["part"]): r for r in out.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        x = [v[2] for v in want[key] if v[2] is not None]
        assert (r["n"], r["m"], r["lo"], r["hi"]) == (len(want[key]), len(x), min(x, default=None), max(x, default=None))
        assert r["s"] == pytest.approx(sum(x)) if x else r["s"] is None
    tagged = sorted(((r["k"], r["valid_start"], r["part"]), r["date"]) for r in split_rows(df, sp).filter("k is not null").collect())
    assert tagged == sorted((k, r[1]) for k, rs in want.items() if k[0] is not None for r in rs)
    assert "NestedLoop" not in split_rows(df, sp)._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_no_rows_and_no_windows(spark):
    _, df = made(spark)
    sp = walk_forward(spark, 1998, 1999)
    assert split_aggregates(df.limit(0), sp, "k", {"n": ("count", F.lit(1))}).count() == 0
    assert split_aggregates(df, sp.limit(0), [], {"n": ("count", F.lit(1))}).count() == 0
    assert split_rows(df, sp.limit(0)).count() == 0
