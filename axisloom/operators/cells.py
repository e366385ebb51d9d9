"""Operators on the long forms: sparse cells and trial recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.joins import join_small
from .rows import coo_to_rows


def cells_of(df: DataFrame, keep_null: bool = False) -> DataFrame:
    """Dense rows -> ``row_id, col_id, value``."""
    cells = df.select("row_id", F.posexplode("y").alias("col_id", "value"))
    return cells if keep_null else cells.filter("value IS NOT NULL")


def nonzero_cells(cells: DataFrame, d: int | None = None) -> DataFrame:
    """Drops zero cells and cells outside the columns 0 to ``d`` - 1."""
    kept = (F.col("value") != 0) & (F.col("col_id") >= 0)
    if d is not None:
        kept = kept & (F.col("col_id") < d)
    return cells.filter(kept)


def column_sums_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("col_id").agg(
        F.count("value").alias("nnz"),
        F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("q"),
    )


def column_means_cells(cells: DataFrame, n_rows: int) -> DataFrame:
    """Column sums over the stored cells and their means over N rows."""
    n = F.lit(float(n_rows))
    return column_sums_cells(cells).select("col_id", "nnz", "s", (F.col("s") / n).alias("mean"))


def frobenius_norm2_cells(cells: DataFrame, n_rows: int) -> DataFrame:
    """Squared norm of the centered matrix from its non-zeros.

    Per column, sum (v - m)^2 over the non-zeros plus m^2 for every zero is
    q - n m^2: two partial sums per column, no zero is ever written out.
    """
    n = F.lit(float(n_rows))
    per_column = column_sums_cells(cells)
    return per_column.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / n).alias("norm2"))


def center_nonzero(cells: DataFrame, n_rows: int) -> DataFrame:
    """v - column mean at the stored cells only (zeros stay implicit)."""
    means = column_sums_cells(cells).select("col_id", (F.col("s") / F.lit(float(n_rows))).alias("m"))
    joined = join_small(cells, means, ["col_id"])
    return joined.select("row_id", "col_id", (F.col("value") - F.col("m")).alias("value"))


def min_obs_cells(cells: DataFrame, min_obs: float = -1e3) -> DataFrame:
    """Cells of the columns with at least ``min_obs`` non-NULL values."""
    if min_obs <= 0:
        return cells
    kept = cells.groupBy("col_id").agg(F.count("value").alias("n")).filter(F.col("n") >= min_obs)
    return join_small(cells, kept.select("col_id"), ["col_id"], "left_semi")


def trial_mean(trials: DataFrame) -> DataFrame:
    """Mean over trials per (cell, t); combines before the shuffle."""
    return trials.groupBy("cell", "t").agg(F.avg("value").alias("mean"))


def remove_trial_mean(trials: DataFrame) -> DataFrame:
    """value - trial mean.

    Aggregate and join rather than a window: a window would bring every trial
    of a hot (cell, t) into one task, while this join can be split.
    """
    joined = join_small(trials, trial_mean(trials), ["cell", "t"])
    return joined.select("cell", "trial", "t", (F.col("value") - F.col("mean")).alias("value"))


def trials_to_cells(trials: DataFrame, n_times: int) -> DataFrame:
    """The matrix of rows (trial, t) and columns = cells in long form, for any number of cells.

    ``row_id = trial * n_times + t``; nothing is grouped or moved.
    """
    return trials.select(
        (F.col("trial").cast("bigint") * n_times + F.col("t")).alias("row_id"),
        F.col("cell").alias("col_id"),
        "value",
    )


#: columns of a row that is collected whole
MAX_DENSE_CELLS = 1 << 20


def trials_to_matrix(trials: DataFrame, n_cells: int, n_times: int) -> DataFrame:
    """The same as dense rows, for a stated and bounded number of cells."""
    if n_cells > MAX_DENSE_CELLS:
        raise ValueError(f"{n_cells} cells make rows too long; use trials_to_cells")
    return coo_to_rows(trials_to_cells(trials, n_times), n_cells, unique=True)
