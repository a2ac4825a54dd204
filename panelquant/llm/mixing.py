"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents are summed to cells (one per combination of the margins) with map-side combine; fitting and calibration work on the cells
only, as grouped sums and joins; documents get their cell's probability by a join and decide by a hash of their id, so a rerun or a lost
executor changes nothing.  Built-in functions only.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelquant.llm.common import SPACE, parallelism, written

MARGINS = ("source", "lang", "topic")
SMALL_CELLS = 200_000  # cells that may be sent to all tasks


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """Form of the whole text: table, numeric, lines or prose."""
    of = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.when(of("|") * 5 >= F.greatest(words, F.lit(1)), "table").when(F.regexp_count(text, F.lit("[0-9]")) * 20 >= F.greatest(F.length(text), F.lit(1)), "numeric").when(
        of("\n") * 12 >= F.greatest(words, F.lit(1)), "lines").otherwise("prose")


def flattened(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets of a margin: its token shares raised to a power below 1."""
    return cells.groupBy(margin).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], most: int = 200, tolerance: float = 1e-12) -> DataFrame:
    """cells (margins, n) -> the same with w, token weights that meet every margin's target shares as well as the filled cells allow, and gap.

    targets: margin -> (margin, target); values without a target get weight 0, targets without tokens are left out and the rest scaled to
    sum to 1.  A weight is n times one factor per margin; a sweep sets the factors of each margin in turn so that its shares are met, by one
    aggregate over the cells, and writes them.  Sweeps end when no margin is off by more than `tolerance` of a share, when ten of them have
    not brought the largest gap down (targets that contradict each other), or after `most`.  gap is what it was in the last sweep.
    """
    few = cells.count() <= SMALL_CELLS
    small = F.broadcast if few else (lambda x: x)
    filled, factors = cells.where("n > 0"), {}
    for m, t in targets.items():
        t = t.join(filled.select(m).distinct(), m)
        whole = t.agg(F.sum("target")).first()[0] or 1.0
        factors[m] = written(t.select(m, (F.col("target") / F.lit(whole)).alias("share"), F.lit(1.0).alias("f"), F.lit(0.0).alias("gap")), "factors")

    def weighted(df: DataFrame, kind: str, but: str | None = None) -> DataFrame:
        w = F.col("n").cast("double")
        for o in factors:
            if o != but:
                df = df.join(small(factors[o].select(o, F.col("f").alias(f"f_{o}"))), o, kind)
                w = w * F.coalesce(F.col(f"f_{o}"), F.lit(0.0))
        return df.withColumn("w", w).drop(*[f"f_{o}" for o in factors])

    best, stale, gap = float("inf"), 0, 0.0
    for _ in range(most):
        for m in factors:
            s = weighted(filled, "inner", m).groupBy(m).agg(F.sum("w").alias("s"))
            met = F.coalesce(F.col("s"), F.lit(0.0))
            f = F.when((met > 0) & (F.col("share") > 0), F.col("share") / met).otherwise(0.0)
            off = F.when(F.col("share") > 0, F.abs(F.col("f") * met / F.col("share") - 1)).otherwise(0.0)
            factors[m] = written(factors[m].drop("gap").join(small(s), m, "left").select(m, "share", f.alias("f"), off.alias("gap")), "factors")
        gap = functools.reduce(DataFrame.unionByName, [t.select("gap") for t in factors.values()]).agg(F.max("gap")).first()[0] or 0.0
        best, stale = (gap, 0) if gap < 0.9 * best else (best, stale + 1)
        if gap <= tolerance or stale == 10:
            break
    return written(weighted(cells, "left").withColumn("gap", F.lit(gap)), "raked")


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells (n, w) -> p = min(1, s * w / n), with s such that expected tokens meet the budget; capped cells pass their rest on to others.

    Cells are capped in order of n / w.  If those below some ratio are, the rest of the budget over the weight of the others is an s; the right
    one is the largest of them.  The sums run over ratios sorted by ranges, from the largest ratio down, so small weights are not lost.
    """
    want = budget * (cells.agg(F.sum("n")).first()[0] or 0)
    d = cells.where("n > 0 and w > 0").groupBy((F.col("n") / F.col("w")).alias("r")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    d = written(d.repartitionByRange(parallelism(cells.sparkSession), "r").withColumn("part", F.spark_partition_id()), "ratios")
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = d.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("w").alias("pw")).select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("pn", "pw")])
    inside = Window.partitionBy("part").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(parts, "part").select((F.col("pn0") + F.sum("n").over(inside)).alias("n"), (F.col("pw0") + F.sum("w").over(inside)).alias("w"))
    total = F.lit(d.agg(F.max("n")).first()[0] or 0)
    s = max(d.agg(F.max((F.lit(want) - (total - F.col("n"))) / F.col("w"))).first()[0] or 0.0, 0.0)
    return cells.withColumn("p", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(s) * F.col("w") / F.col("n"))).otherwise(F.when(F.lit(budget) >= 1, 1.0).otherwise(0.0)))


def draw(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_cell(docs: DataFrame, text: str, lang: str, source: str, **keep: Column) -> DataFrame:
    """The kept columns, the margins' values of each row and its number of tokens n; words are counted once."""
    blank = lambda c: F.coalesce(docs[f"`{c}`"], F.lit(""))
    n = token_count(docs[f"`{text}`"])
    d = docs.select(*[c.alias(k) for k, c in keep.items()], blank(source).alias("source"), blank(lang).alias("lang"), docs[f"`{text}`"].alias("text"), n.alias("n"))
    return d.select(*keep, "source", "lang", F.coalesce(topic_of(F.col("text"), F.col("n")), F.lit("prose")).alias("topic"), "n")


def fit_cells(cells: DataFrame, language_targets: dict[str, float] | None, source_power: float = 0.5, topic_power: float = 0.75, budget: float = 0.5, sweeps: int = 200) -> DataFrame:
    """Cells (margins, n) with their probability p.  language_targets: shares of languages; without it they are flattened like sources.

    Languages without a share of their own ('' for null too) keep their flattened share, and the named ones divide what is left in the
    given proportions: every filled cell has p > 0, and with no other language the named shares hold as they are.  gap is the largest relative
    distance of a margin's share from its target, near 0 unless targets contradict each other.
    """
    by_lang = flattened(cells, "lang", source_power)
    if language_targets:
        named = cells.sparkSession.createDataFrame(list(language_targets.items()), "lang string, given double")
        by_lang = by_lang.where("target > 0").join(F.broadcast(named), "lang", "left")
        whole, rest, given = by_lang.agg(F.sum("target"), F.sum(F.when(F.col("given").isNull(), F.col("target"))), F.sum("given")).first()
        left = 1 - (rest or 0.0) / (whole or 1.0)
        by_lang = by_lang.select("lang", F.when(F.col("given").isNull(), F.col("target") / F.lit(whole or 1.0)).otherwise(F.col("given") * F.lit(left / (given or 1.0))).alias("target"))
    targets = {"source": flattened(cells, "source", source_power), "lang": by_lang, "topic": flattened(cells, "topic", topic_power)}
    return written(calibrate(rake(cells, targets, sweeps), budget).select(*MARGINS, "n", "w", "p", "gap"), "fitted")


def with_probability(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows joined to their cell's p; the cells are sent to all tasks if few, else both sides are dealt by cell."""
    p = fitted.select(*MARGINS, "p")
    return rows.join(F.broadcast(p) if fitted.count() <= SMALL_CELLS else p, list(MARGINS))


def mix(docs: DataFrame, language_targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p, u, sampled for every document, repeated rows included.

    Nulls in source or lang form a value of their own (empty string), which is drawn like any other: languages that language_targets does
    not name share a flattened remainder (`fit_cells`).  A document without words has no tokens; a cell without tokens is
    sampled only if the budget is the whole corpus.  Rows with the same doc_id (null too) share their draw.  An empty table gives an empty
    result.
    """
    d = written(with_cell(docs, text, lang, source, doc_id=docs[f"`{doc_id}`"]).withColumnRenamed("n", "n_tokens"), "mix")
    cells = written(d.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "cells")
    u = draw(F.col("doc_id"))
    return with_probability(d, fit_cells(cells, language_targets, **options)).select("doc_id", *MARGINS, "n_tokens", "p", u.alias("u"), (u < F.col("p")).alias("sampled"))


def sample(docs: DataFrame, language_targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of docs that `mix` samples, all columns as they are.  A row's cell is computed from the row, so nothing is joined by id."""
    cells = written(with_cell(docs, text, lang, source).groupBy(*MARGINS).agg(F.sum("n").alias("n")), "cells")
    rows = with_cell(docs, text, lang, source, row=F.struct(*[docs[f"`{c}`"] for c in docs.columns]), u=draw(docs[f"`{doc_id}`"]))
    return with_probability(rows, fit_cells(cells, language_targets, **options)).where(F.col("u") < F.col("p")).select("row.*")
