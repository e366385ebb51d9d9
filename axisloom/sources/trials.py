"""Trial-structured recordings: one CSV row per cell, one column per sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse_bracketed

INDEX_COLUMN = "Unnamed: 0"
UNUSED_COLUMNS = ("dx",)


def read_trials(
    spark: SparkSession, path: str, first_n: int | None = None, multi_line: bool = True
) -> DataFrame:
    """``cell, trial, t, value`` from a CSV whose cells hold ``[v v ...]``.

    The index column names the cell; sweep columns are those with integer names.
    ``multi_line=False`` says that no cell holds a line break; large files are
    then read in splits rather than one task per file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    wide = reader.csv(path).drop(*UNUSED_COLUMNS)
    sweeps = sorted((c for c in wide.columns if c.isdigit()), key=int)
    wide = wide.select(
        F.col(f"`{INDEX_COLUMN}`").cast("int").alias("cell"), *[F.col(f"`{c}`") for c in sweeps]
    )
    if first_n is not None:
        # only the cell numbers are sorted; the wide rows stay where they are
        last = wide.select("cell").orderBy("cell").limit(first_n).agg(F.max("cell")).first()[0]
        wide = wide.filter(F.col("cell") <= last) if last is not None else wide
    long = wide.unpivot("cell", sweeps, "trial", "text")
    return long.select(
        "cell",
        F.col("trial").cast("int").alias("trial"),
        F.posexplode(parse_bracketed(F.col("text"))).alias("t", "value"),
    )
