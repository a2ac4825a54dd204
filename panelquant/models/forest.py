"""Quantile forest and boosted quantile trees on MLlib trees.

MLlib grows the trees; the distribution in a leaf comes from exact quantiles per (tree, leaf),
computed with the bucketed two-pass aggregate, so a leaf of any size is fine.
"""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from panelquant.functions.stage import stage
from panelquant.operators import xsection as X


def _assemble(df: DataFrame, xs) -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip").transform(df)


def quantile_forest(train: DataFrame, score: DataFrame, xs, y: str, taus, trees: int = 20, depth: int = 5, min_leaf: int = 20, seed: int = 1, key=("date", "DTID")) -> DataFrame:
    """score + q: per-leaf quantiles of the training target, averaged over trees."""
    train, score = stage(train.dropna(subset=[*xs, y])), stage(score.dropna(subset=list(xs)))
    m = RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, leafCol="_leaf").fit(_assemble(train, xs))
    leaves = lambda d, *cols: m.transform(_assemble(d, xs)).select(*cols, F.posexplode(vector_to_array("_leaf")).alias("_t", "_l"))
    q = X.group_quantiles(leaves(train, F.col(y).alias("_y")), ["_t", "_l"], {f"_q{i}": ("_y", t) for i, t in enumerate(taus)})
    # at most trees * 2^depth rows
    s = leaves(score, *key).join(F.broadcast(q) if trees * 2 ** depth <= 1_000_000 else q, ["_t", "_l"])
    p = s.groupBy(*key).agg(F.array(*[F.avg(f"_q{i}") for i in range(len(taus))]).alias("q"))
    return score.join(p, list(key))


def quantile_boost(train: DataFrame, score: DataFrame, xs, y: str, tau: float, rounds: int = 5, step: float = 0.25, late_step: float = 0.01, late_from: int = 50,
                   depth: int = 3, min_leaf: int = 20, out: str = "pred", key=("date", "DTID")) -> DataFrame:
    """score + prediction of one quantile: each tree fits the sign of the pinball gradient, its
    leaves take the tau-quantile of the current residual.  Rounds are sequential; each one is a
    distributed fit, and the current prediction is materialised between rounds."""
    train = stage(train.dropna(subset=[*xs, y]).select(*key, *xs, y))
    score = stage(score.dropna(subset=list(xs)))
    base = X.group_quantiles(train.withColumn("_g", F.lit(1)), ["_g"], {"b": (y, tau)}).select(F.col("b"))
    tr, sc = train.crossJoin(F.broadcast(base)).withColumnRenamed("b", "_f"), score.crossJoin(F.broadcast(base)).withColumnRenamed("b", "_f")  # one row
    for r in range(rounds):
        tr, sc = stage(tr), stage(sc)
        e = F.col(y) - F.col("_f")
        t = _assemble(tr.withColumn("_e", e).withColumn("_s", F.when(e > 0, F.lit(tau)).otherwise(F.lit(tau - 1))), xs)
        m = DecisionTreeRegressor(featuresCol="_x", labelCol="_s", maxDepth=depth, minInstancesPerNode=min_leaf, seed=r, leafCol="_leaf").fit(t)
        leaf = F.col("_leaf")
        tl = m.transform(t).withColumn("_l", leaf)
        q = X.group_quantiles(tl.select("_l", "_e"), ["_l"], {"_q": ("_e", tau)})
        rate = step if r < late_from else late_step
        q = F.broadcast(q)  # one row per leaf, at most 2^depth
        upd = lambda d, cols: d.join(q, "_l", "left").select(*cols, (F.col("_f") + rate * F.coalesce("_q", F.lit(0.0))).alias("_f"))
        tr = upd(tl, [*key, *xs, y])
        sc = upd(m.transform(_assemble(sc, xs)).withColumn("_l", leaf), score.columns)
    return sc.withColumnRenamed("_f", out)
