"""Text matrix formats: dense lines, coordinate triples and vector text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import parse_numbers, parse_vector_text
from ..plans.budget import MAX_BROADCAST_ROWS

COO_SCHEMA = "row_id BIGINT, col_id INT, value DOUBLE"
FORMATS = ("DENSE", "COO")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds consecutive ``row_id`` in (file, position) order, without a sort.

    Files follow one another by folder, then by the number in a ``part-<number>`` name
    (part-100000 comes after part-99999), then by name.

    One counting pass gives the size of each file split; a running total over
    the splits gives each split's first number.  Inside a split the lines are in
    order, so ``monotonically_increasing_id`` supplies the rest.
    """
    tagged = lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    ).withColumn("mid", F.monotonically_increasing_id())
    splits = tagged.groupBy("path", "start").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    # one row per file split, not per line
    before = F.sum("n").over(
        Window.orderBy(*file_order(F.col("path")), "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    splits = splits.withColumn("shift", before - F.col("n") - F.col("first"))
    splits = splits.select("path", "start", "shift")
    # splits <= files + partitions: only a file's last split can be far below the split size
    if lines.rdd.getNumPartitions() <= MAX_BROADCAST_ROWS and len(lines.inputFiles()) <= MAX_BROADCAST_ROWS:
        splits = F.broadcast(splits)
    return tagged.join(splits, ["path", "start"]).select(
        (F.col("mid") + F.col("shift")).alias("row_id"), "value"
    )


def file_order(path):
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    part = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1)
    return folder, F.when(part != "", part.cast("bigint")).asc_nulls_first(), path


def read_dense(spark: SparkSession, path: str, d: int | None = None) -> DataFrame:
    """Whitespace-separated numbers, one matrix row per line; blank lines skipped.

    Lines are numbered from 0 across the files in path order.  With ``d`` given,
    a line of another length raises; without it the first line sets the length.
    """
    lines = spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    if d is None:
        first = lines.select(F.size(parse_numbers(F.col("value")))).first()
        if first is None:
            raise ValueError(f"no matrix rows in {path}")
        d = first[0]
    return number_lines(lines).select(
        "row_id", check_width(parse_numbers(F.col("value")), d).alias("y")
    )


def check_width(y, d: int):
    wrong = F.concat(F.lit("ragged row: "), F.size(y).cast("string"), F.lit(f" values, expected {d}"))
    return F.when(F.size(y) == d, y).otherwise(F.raise_error(wrong).cast("array<double>"))


def read_coo(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """``row,col,value`` triples; ``base`` is subtracted from both indices."""
    if base not in (0, 1):
        raise ValueError("base must be 0 or 1")
    cells = spark.read.schema(COO_SCHEMA).option("mode", "FAILFAST").csv(path)
    return cells.select(
        (F.col("row_id") - base).alias("row_id"),
        (F.col("col_id") - base).cast("int").alias("col_id"),
        "value",
    )


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """``(size,[indices],[values])`` lines, numbered like dense lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return number_lines(lines).select("row_id", parse_vector_text(F.col("value")).alias("v")).select(
        "row_id", "v.size", "v.indices", "v.values"
    )


def convert_matrix(
    spark: SparkSession,
    path: str,
    fmt: str,
    out: str,
    base: int | None = None,
    d: int | None = None,
    sparse: bool = False,
    mode: str = "errorifexists",
) -> DataFrame:
    """Text matrix -> stored rows (parquet); returns the stored table.

    Rows are dense unless ``sparse`` is asked for, which COO input allows.
    """
    fmt = fmt.upper()
    if fmt not in FORMATS:
        raise ValueError(f"unknown input format {fmt!r}; use one of {FORMATS}")
    if fmt == "COO":
        from ..operators.rows import coo_to_rows, coo_to_sparse

        if base is None:
            raise ValueError("COO input needs its index base (0 or 1)")
        cells = read_coo(spark, path, base)
        if d is None:
            d = cells.agg(F.max("col_id")).first()[0] + 1
        rows = coo_to_sparse(cells, d) if sparse else coo_to_rows(cells, d)
    elif sparse:
        raise ValueError("sparse rows need COO input")
    else:
        rows = read_dense(spark, path, d)
    rows.write.mode(mode).parquet(out)
    return spark.read.parquet(out)
