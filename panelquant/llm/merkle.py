"""Merkle manifest of a table: a tree of rows per group, a tree of groups above, a proof of membership for every row.

Slot pivot: a level's nodes are numbered in order; conditional aggregates spread the children of each parent into as many columns as the
fanout.  Concatenating the columns and hashing gives the parent, leaving the own slot's column out gives a node's siblings.  Going up, a
level has a sixteenth of the rows of the one below and is written once; going down, each node gets the siblings of all its ancestors from
its parent, so rows meet only the pivoted row of their own run.

Numbers come from one sort by ranges: rows are numbered inside a range, and ranges, of which there are as many as partitions, are summed
up.  A group of any size is spread over ranges, and no window runs over the rows of a group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelquant.llm.common import only, parallelism, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SMALL_RANGES = 100_000  # rows of the table of ranges and groups that may be sent to all tasks
HEX = 64  # characters of a digest


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts in a row; nulls are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def numbered(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """df (g and others) with pos, the row's number from 0 in its group by `order`, and n, the size of the group; written before it is numbered.

    Rows that agree in all of `order` are interchangeable; they may be spread over ranges.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    d = df.withColumn("_tie", F.monotonically_increasing_id())
    d = d.repartitionByRange(parallelism(spark), *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    d = written(d.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33).alias("_part")
    w = Window.partitionBy("g")  # ranges of a group: no more than partitions
    parts = d.groupBy("g", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    parts = written(parts.select("g", "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n")), tag + "-ranges")
    d = d.withColumn("_part", part)
    return d.join(F.broadcast(parts) if parts.count() <= SMALL_RANGES else parts, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes (g, pos, n, h) -> the pivoted runs of each level, (g, p, n, c0, c1, ...) written, and (g, h) with the top of each group."""
    runs, tops = [], nodes.where("n = 1").select("g", "h")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        r = nodes.where("n > 1").groupBy("g", F.expr(f"pos div {fanout}").alias("p")).agg(F.max("n").alias("n"), *[F.expr(f"max(if(pos % {fanout} = {i}, h, null)) as c{i}") for i in range(fanout)])
        runs.append(written(r, "runs"))
        nodes = runs[-1].select("g", F.col("p").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(F.expr("concat_ws('', " + ", ".join(f"c{i}" for i in range(fanout)) + ")")).alias("h"))
        tops = tops.unionByName(nodes.where("n = 1").select("g", "h"))
        most = -(-most // fanout)
    return runs, tops


def attach(leaves: DataFrame, runs: list[DataFrame], crown: DataFrame, fanout: int) -> DataFrame:
    """leaves (g, pos, n, ...) with crown's columns (g, steps, ...); their own steps, lowest level first, stand before crown's.

    A step is (sib, slot): the digests of the siblings in order, and the number of those to the left.
    """
    extra = [c for c in crown.columns if c not in ("g", "steps")]
    cols = [f"c{i}" for i in range(fanout)]
    others = lambda i: ", ".join(cols[:i] + cols[i + 1:]) or "''"
    ended = lambda k: runs[k - 1].where(F.col("n") <= fanout).select("g", F.lit(0).cast("long").alias("pos")).join(crown, "g")
    above = ended(len(runs)) if runs else None
    for k in range(len(runs) - 1, 0, -1):
        up = runs[k].join(above.withColumnRenamed("pos", "p"), ["g", "p"])
        kids = F.expr("array(" + ", ".join(f"if({c} is null, null, struct(p * {fanout} + {i} as pos, array(struct(concat_ws('', {others(i)}) as sib, {i} as slot)) as own))" for i, c in enumerate(cols)) + ")")
        each = up.select("g", "steps", *extra, F.explode(kids).alias("x")).where("x is not null")
        above = each.select("g", "x.pos", F.concat("x.own", "steps").alias("steps"), *extra).unionByName(ended(k))
    alone = leaves.where("n = 1").join(crown, "g")
    if not runs:
        return alone
    up = runs[0].drop("n").join(above.withColumnRenamed("pos", "p"), ["g", "p"])
    own = "array(struct(concat_ws('', " + ", ".join(f"if(slot = {i}, null, {c})" for i, c in enumerate(cols)) + ") as sib, slot))"
    many = leaves.where("n > 1").withColumn("p", F.expr(f"pos div {fanout}")).withColumn("slot", F.expr(f"cast(pos % {fanout} as int)")).join(up, ["g", "p"]).withColumn("steps", F.concat(F.expr(own), "steps"))
    return many.select(*alone.columns).unionByName(alone)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda a, s: digest(F.substr(s["sib"], F.lit(1), s["slot"] * HEX), a, F.substr(s["sib"], s["slot"] * HEX + 1, F.length(s["sib"]))))


def manifest(rows: DataFrame, changed: dict[str, Column] | None = None, fields=FIELDS, key: str = "doc_id", group: str = "source", fanout: int = 16) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, proof_sha256, folded_root, verified for every row.

    fields: the columns that a leaf covers, in order; a group's leaves ascend by key, then by leaf.  changed: column -> what it holds now,
    over the names of `fields`; folded_root is recomputed from the leaf of the changed row and the siblings of the manifest.
    Null is a group of its own, before all others; a null key comes first in its group.  Rows that repeat in full have equal leaves and
    stand side by side.  One row alone has its leaf as root and no steps.  An empty table gives no rows.  Texts are hashed whole where they
    are read; only digests travel.  Columns not in `fields` don't count.
    """
    d = only(rows, **{f: f for f in dict.fromkeys([*fields, key, group])})
    now = {f: F.col(f) for f in fields} | (changed or {})
    leaf, other = digest(*[field(F.col(f)) for f in fields]), digest(*[field(now[f]) for f in fields])
    touched = F.lit(False)
    for f, c in (changed or {}).items():
        touched = touched | ~F.col(f).eqNullSafe(c)
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = numbered(d.select(g.alias("g"), F.col(key).alias("doc_id"), leaf.alias("h"), F.when(touched, other).alias("h2")), ["doc_id", "h"], "leaves")
    runs, tops = climb(leaves.select("g", "pos", "n", "h"), fanout)
    groups = written(tops.withColumnRenamed("h", "subroot"), "tops")
    # the tree of groups: one group of them all
    subs = numbered(groups.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("h")), ["name"], "groups")
    crowns, root = climb(subs.select("g", "pos", "n", "h"), fanout)
    crown = root.select("g", F.col("h").alias("root"), F.expr("cast(array() as array<struct<sib:string,slot:int>>)").alias("steps"))
    crown = written(attach(subs, crowns, crown, fanout).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "root", "steps"), "crown")
    r = attach(leaves, runs, crown, fanout)
    r = r.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "steps", digest(F.array_join(F.transform("steps", lambda s: s["sib"]), "")).alias("proof_sha256"), fold(F.coalesce("h2", "h"), F.col("steps")).alias("folded_root"))
    return r.withColumn("verified", F.col("folded_root") == F.col("root"))
