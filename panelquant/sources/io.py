"""Readers and writers: explicit schemas, column pruning, fixed date formats."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema, columns=None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and an explicit schema; only the selected columns are parsed."""
    schema = schema if isinstance(schema, (T.StructType, str)) else T.StructType(schema)
    d = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("enforceSchema", False).csv(path)
    return d.select(*columns) if columns else d


def read_table(spark: SparkSession, path: str, columns=None, jdbc: dict | None = None) -> DataFrame:
    """Parquet, or a database table split by a numeric column when `jdbc` options are given."""
    d = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return d.select(*columns) if columns else d


def filtered_scan(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in the key table (left-semi; broadcast is left to the measured size)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def write_parquet(df: DataFrame, path: str, partition_by=(), compression: str = "gzip", mode: str = "overwrite") -> None:
    """Partitioned Parquet.  Rows are spread over files by the writer's own partitions: no repartition
    by region, whose few values would put a third of the table into one task."""
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def parse_date(col, fmt: str) -> Column:
    """Date from a fixed format; yyyyMM means the first of the month.  Bad text is null."""
    x = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    if fmt == "yyyyMM":
        x, fmt = F.concat(x, F.lit("01")), "yyyyMMdd"
    return F.try_to_timestamp(x, F.lit(fmt)).cast("date")


def to_number(col) -> Column:
    """Numeric coercion: bad text is null."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("double")
