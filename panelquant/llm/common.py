"""Shared helpers: table access, written hand-over points, column hygiene, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelquant.functions.stage import work_dir

#: ASCII white space as the word contracts define it.
SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder of the session."""
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read again: the plan is cut, and no executor holds the only copy."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """The named input columns under the operator's own names; every other column is left out, so no name can clash."""
    return df.select(*[df[f"`{c}`"].alias(n) for n, c in cols.items()])


def typed(df: DataFrame, column: str):
    """SQL name and Arrow type of a column; batches name the type, as a batch may hold nulls only."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


BATCH_BYTES = 3 << 20  # below a block of texts


def small_batches(df: DataFrame) -> DataFrame:
    """df; the session's Arrow batches are held to a few MB from here on, as rows are whole texts and a batch stands in several buffers at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def deal(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows dealt by a key into as many partitions as the session asks for."""
    return df.repartition(parallelism(df.sparkSession), key)


def slices(batches: Iterator, columns: list[str], limit: int = 4 << 20, sized: str = "text") -> Iterator[list[list]]:
    """Lists of values per column, cut so that one piece has about `limit` bytes of the sized column (a longer single text stays whole)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(sized)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i in range(len(n)):
            if size and size + n[i] > limit:
                yield [b.column(c).slice(start, i - start).to_pylist() for c in columns]
                start, size = i, 0
            size += int(n[i])
        if start < len(n):
            yield [b.column(c).slice(start).to_pylist() for c in columns]
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds: all work is joins and aggregates on node keys, each round is written, so lineage
    stays short.  Nulls and self loops are ignored; no edges give an empty table.  Hot nodes are joined by a plain equi-join, which
    adaptive execution splits.
    """
    u, v = F.col("u"), F.col("v")
    e = only(edges, u=a, v=b).where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e, seen = written(e, "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(u.alias("node"), v.alias("component")).union(e.select(v, v)).distinct()
        seen = state
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, F.col("m")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(u > v)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u > v).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
