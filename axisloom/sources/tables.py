"""Entry points that bring any table with numeric content into matrix form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _key(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("bigint").alias("row_id")


def rows_from_columns(df: DataFrame, columns: Sequence[str | Column], key: str | Column) -> DataFrame:
    """Dense rows from numeric columns; only those columns are read from the source."""
    cells = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    return df.select(_key(key), F.array(*cells).alias("y"))


def rows_from_arrays(df: DataFrame, array: str, key: str | Column) -> DataFrame:
    return df.select(_key(key), F.col(array).cast("array<double>").alias("y"))


def rows_from_vectors(df: DataFrame, vector: str, key: str | Column) -> DataFrame:
    return df.select(_key(key), vector_to_array(F.col(vector)).alias("y"))


def scan_rows(spark: SparkSession, path: str, d: int | None = None) -> DataFrame:
    """Stored rows, dense (``y``) or sparse (``idx, val``).

    Columns from ``d`` on are dropped, in sparse rows also zeros.
    """
    df = spark.read.parquet(path)
    if "idx" in df.columns:
        kept = lambda e: (e["val"] != 0) if d is None else (e["val"] != 0) & (e["idx"] < d)
        df = df.select("row_id", F.filter(F.arrays_zip("idx", "val"), kept).alias("e"))
        return df.select("row_id", F.col("e.idx").alias("idx"), F.col("e.val").alias("val"))
    df = df.select("row_id", "y")
    return df if d is None else df.withColumn("y", F.slice("y", 1, d))
