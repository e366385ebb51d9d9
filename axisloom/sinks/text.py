"""Matrix writers: dense lines, list-of-lists lines, coordinate triples."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..functions import format_coo, format_dense, format_lil, format_vector

FORMATS = ("DENSE", "LIL", "COO")


def as_lines(df: DataFrame, fmt: str = "DENSE") -> DataFrame:
    """Dense rows -> ``row_id, value`` text in the given format, unsorted.

    COO yields one line per non-zero cell with its ``col_id``.
    """
    fmt = fmt.upper()
    if fmt == "DENSE":
        return df.select("row_id", format_dense(F.col("y")).alias("value"))
    if fmt == "LIL":
        return df.select("row_id", format_lil(F.col("y")).alias("value"))
    if fmt == "COO":
        cells = df.select("row_id", F.posexplode("y").alias("col_id", "v")).filter("v <> 0")
        return cells.select(
            "row_id", "col_id", format_coo(F.col("row_id"), F.col("col_id"), F.col("v")).alias("value")
        )
    raise ValueError(f"unknown output format {fmt!r}; use one of {FORMATS}")


def write_matrix(df: DataFrame, path: str, fmt: str = "DENSE", mode: str = "errorifexists") -> None:
    """Dense rows as text files in row order (range-partitioned sort, no single task)."""
    lines = as_lines(df, fmt)
    order = [c for c in lines.columns if c != "value"]
    lines.orderBy(*order).select("value").write.mode(mode).text(path)


def projected_text(df: DataFrame) -> DataFrame:
    """Projected rows ``row_id, x`` -> ``row_id, value`` vector text."""
    return df.select("row_id", format_vector(F.col("x")).alias("value"))


def write_projected(
    df: DataFrame, out: str, fmt: str = "PARQUET", mode: str = "errorifexists"
) -> str:
    """Projected rows below ``<out>/ProjectedMatrix``; parquet keeps ``row_id``."""
    path = os.path.join(out, "ProjectedMatrix")
    if fmt.upper() == "PARQUET":
        df.write.mode(mode).parquet(path)
    elif fmt.upper() == "VECTOR":
        projected_text(df).orderBy("row_id").select("value").write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown projection format {fmt!r}; use PARQUET or VECTOR")
    return path
