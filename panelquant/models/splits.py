"""Walk-forward train / validation windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def walk_forward(spark: SparkSession, first: int = 1995, last: int = 2023, step: int = 1, horizon: str = "M", train_start: str = "1973-01-01") -> DataFrame:
    """One row per validation block; training ends early enough that no label overlaps it."""
    y = F.col("y")
    end = {"M": F.make_date(y - 1, F.lit(11), F.lit(29)), "Q": F.make_date(y - 1, F.lit(9), F.lit(30)), "Y": F.make_date(y - 2, F.lit(12), F.lit(31))}
    if horizon not in end:
        raise ValueError(f"unknown horizon {horizon!r}")
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("y")).select(
        F.lit(train_start).cast("date").alias("train_start"), end[horizon].alias("train_end"),
        F.make_date(y, F.lit(1), F.lit(1)).alias("valid_start"), F.make_date(y + step - 1, F.lit(12), F.lit(31)).alias("valid_end"))


def _windows(splits: DataFrame) -> DataFrame:
    """(valid_start, part, a, b): the training and the validation window of every split, both ends included."""
    w = F.explode(F.array(
        F.struct(F.lit("train").alias("part"), F.col("train_start").alias("a"), F.col("train_end").alias("b")),
        F.struct(F.lit("valid").alias("part"), F.col("valid_start").alias("a"), F.col("valid_end").alias("b"))))
    return splits.select("valid_start", w.alias("w")).select("valid_start", "w.part", "w.a", "w.b").filter("a <= b")


def _blocks(splits: DataFrame):
    """Blocks of dates that no window edge cuts: (block number of a date, (valid_start, part, _block) table, first and last date).

    Four edges per split and one split per step of the study: the list of edges is bounded by the calendar.
    """
    w = _windows(splits)
    ends = w.select(F.col("a").alias("e")).union(w.select(F.date_add("b", 1))).distinct().orderBy("e").collect()

    def number(date):
        k = F
        for i, r in enumerate(ends):
            k = k.when(date < F.lit(r["e"]), F.lit(i))
        return k.otherwise(F.lit(len(ends))) if ends else F.lit(0)

    table = w.select("valid_start", "part", F.explode(F.sequence(number(F.col("a")), number(F.col("b")))).alias("_block"))
    return number, table, (ends[0]["e"], ends[-1]["e"]) if ends else None


def _numbered(df: DataFrame, splits: DataFrame, date: str):
    number, table, span = _blocks(splits)
    if span is None:
        return df.filter("false").withColumn("_block", F.lit(0)), table
    d = F.col(date).cast("date")
    return df.filter((d >= F.lit(span[0])) & (d < F.lit(span[1]))).withColumn("_block", number(d)), table


def split_rows(df: DataFrame, splits: DataFrame, date: str = "date") -> DataFrame:
    """Rows tagged with every window that contains them (`part` = train / valid).

    An equi-join on date blocks.  Training rows repeat in every later window by definition; use `split_aggregates` where sums will do.
    """
    d, table = _numbered(df, splits, date)
    return d.join(table, "_block").drop("_block")


#: What merges from block to block: how a partial result is made, and how partial results become one.
MERGE = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def split_aggregates(df: DataFrame, splits: DataFrame, by, aggs: dict, date: str = "date") -> DataFrame:
    """Aggregates of every window per group: (by, valid_start, part, one column per aggregate); groups without rows in a window are left out.

    Each row enters one aggregate per (group, date block), and a window is a union of blocks: only the blocks' results, at most four per
    split and group, are copied to the windows.  aggs: name -> (count / sum / min / max, column).  Rows without a date are in no window.
    """
    by = [by] if isinstance(by, str) else list(by)
    d, table = _numbered(df, splits, date)
    part = d.groupBy(*by, "_block").agg(*[MERGE[k][0](x).alias(n) for n, (k, x) in aggs.items()])
    return part.join(table, "_block").groupBy(*by, "valid_start", "part").agg(*[MERGE[k][1](n).alias(n) for n, (k, _) in aggs.items()])
