"""Materialised hand-over points.

An operator that reads its input several times would otherwise multiply the plan of everything
upstream.  `stage` writes such an input once, as Parquet, to the shared folder named by
`spark.checkpoint.dir` and continues from the files: lineage is cut, column pruning still
works, sizes are known to the optimiser, and losing an executor costs nothing that was written.
Plain scans are left alone: reading them twice is cheaper than writing them.
"""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HEAVY = re.compile(r"^[\s:+\-|]*(?:'?)(Aggregate|Join|Window|Generate|MapInPandas|FlatMapGroupsInPandas|Deduplicate|Distinct)\b", re.M)
_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def weight(df: DataFrame) -> int:
    """Number of joins, aggregates, windows and generators in the plan."""
    return len(_HEAVY.findall(df._jdf.queryExecution().analyzed().toString()))


def materialise(df: DataFrame) -> DataFrame:
    """A written copy of df."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/panelquant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, above: int = 0) -> DataFrame:
    """df itself when its plan has at most `above` heavy nodes, else a written copy of it."""
    return df if weight(df) <= above else materialise(df)
