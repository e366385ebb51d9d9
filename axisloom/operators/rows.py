"""Row-level transforms of dense matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import center, densify, literal_array
from ..plans.blocks import checked_rows, linear_rows, map_rows, width
from ..plans.budget import MAX_WIDE_COLUMNS
from ..plans.moments import ColumnStats, column_stats, sparse_linear_rows


def _with_y(df: DataFrame, y) -> DataFrame:
    return df.withColumn("y", y)


# --- sparse cells -> rows ---------------------------------------------------


def _entries(cells: DataFrame, unique: bool) -> DataFrame:
    if not unique:
        # merges repeated cells first, so that a row group never exceeds its columns
        cells = cells.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
    entry = F.struct(F.col("col_id").alias("c"), F.col("value").alias("v"))
    return cells.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))


def coo_to_rows(cells: DataFrame, d: int, unique: bool = False, missing: str = "0D") -> DataFrame:
    """Cells -> dense rows of ``d`` columns; repeated cells add up.

    Cells from column ``d`` on are dropped.  ``unique=True`` promises that no
    cell repeats and saves a shuffle; a repeated cell then raises.  ``missing``
    fills the absent cells.
    """
    rows = _entries(cells.filter((F.col("col_id") >= 0) & (F.col("col_id") < d)), unique)
    y = densify("e", d, missing)
    if not unique:
        return rows.select("row_id", y.alias("y"))
    repeated = F.size("e") != F.size(F.array_distinct(F.col("e.c")))
    problem = F.raise_error(F.lit("repeated cell in a matrix announced as unique")).cast("array<double>")
    return rows.select("row_id", F.when(repeated, problem).otherwise(y).alias("y"))


def coo_to_sparse(cells: DataFrame, d: int, unique: bool = False) -> DataFrame:
    """Cells -> sparse rows ``row_id, idx, val`` without zeros."""
    kept = cells.filter((F.col("col_id") >= 0) & (F.col("col_id") < d) & (F.col("value") != 0))
    return _entries(kept, unique).select("row_id", F.col("e.c").alias("idx"), F.col("e.v").alias("val"))


def drop_out_of_range(df: DataFrame, d: int) -> DataFrame:
    return _with_y(df, F.slice("y", 1, d))


# --- filters ----------------------------------------------------------------


def first_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """First ``n`` rows by key (TakeOrdered: a bounded heap per task)."""
    return df.orderBy(key).limit(n)


def default_sample_rate(n_rows: int) -> float:
    """1 for N of up to four digits, then ten times less per further digit."""
    return 10.0 ** min(0, 4 - len(str(n_rows)))


def sample_rows(df: DataFrame, rate: float, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Bernoulli sample by key: the same rows on every run and every partitioning."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    if rate == 1:
        return df
    bound = f"{int(rate * 2**32):08x}"
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.filter(F.substring(digest, 1, 8) < bound)


# --- centering and scaling --------------------------------------------------


def center_rows(df: DataFrame, stats: ColumnStats | None = None) -> DataFrame:
    stats = stats or column_stats(df)
    return _with_y(df, center(checked_rows("y", stats.d), stats.mean))


def _scaled(df: DataFrame, stats: ColumnStats, divisor: np.ndarray) -> DataFrame:
    y = checked_rows("y", stats.d)
    if stats.d <= MAX_WIDE_COLUMNS:
        cells = [(y[j] - float(stats.mean[j])) / F.lit(float(divisor[j])) for j in range(stats.d)]
        return _with_y(df, F.array(*cells))
    centered = center(y, stats.mean)
    return _with_y(df, F.zip_with(centered, literal_array(divisor), lambda a, s: a / s))


def _check_spread(stats: ColumnStats) -> None:
    flat = np.flatnonzero(~(stats.var_pop > 0))
    if len(flat):
        raise ValueError(f"columns without variance: {flat.tolist()[:20]}")


def zscore_rows(df: DataFrame, stats: ColumnStats | None = None) -> DataFrame:
    """(y - mean) / population sd per column; NULL cells stay NULL."""
    stats = stats or column_stats(df)
    _check_spread(stats)
    return _scaled(df, stats, stats.std_pop)


def variance_normalize(df: DataFrame, stats: ColumnStats | None = None) -> DataFrame:
    """(1/n)(y - mean) / variance per column."""
    stats = stats or column_stats(df)
    _check_spread(stats)
    return _scaled(df, stats, stats.var_pop * stats.n_rows)


# --- missing and infinite cells ---------------------------------------------


def nan_to_null(df: DataFrame) -> DataFrame:
    return _with_y(df, F.transform("y", lambda v: F.when(~F.isnan(v), v)))


def _finite(v):
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def clip_infinite(df: DataFrame) -> DataFrame:
    """Replaces +-inf by the largest finite value of the whole matrix."""
    per_row = F.array_max(F.filter("y", _finite))
    top = df.agg(F.max(per_row)).first()[0]
    if top is None:
        raise ValueError("no finite cell")
    return _with_y(
        df, F.transform("y", lambda v: F.when(F.abs(v) == float("inf"), F.lit(top)).otherwise(v))
    )


def keep_observed_columns(
    df: DataFrame, min_obs: float = -1e3, stats: ColumnStats | None = None
) -> tuple[DataFrame, list[int]]:
    """Keeps columns with at least ``min_obs`` observed cells; also returns their numbers."""
    stats = stats or column_stats(df)
    kept = [int(j) for j in np.flatnonzero(stats.count >= min_obs)]
    if len(kept) == stats.d:
        return df, kept
    positions = F.expr("array(" + ",".join(map(str, kept)) + ")")
    return _with_y(df, F.transform(positions, lambda j: F.get("y", j))), kept


def fill_missing(df: DataFrame) -> DataFrame:
    """z-scored rows with missing cells at 0 (the mean), plus ``n_missing``."""
    missing = F.size(F.filter("y", lambda v: v.isNull() | F.isnan(v)))
    return df.withColumn("n_missing", missing).withColumn(
        "y", F.transform("y", lambda v: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0)))
    )


# --- linear maps ------------------------------------------------------------


def latent_scores(df: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """x = y M, or (y - mean) M when a mean is given, for dense or sparse rows."""
    matrix = np.asarray(matrix, float)
    offset = None if mean is None else -(np.asarray(mean, float) @ matrix)
    if "idx" in df.columns:
        return sparse_linear_rows(df, matrix, offset)
    return linear_rows(df, matrix, "x", offset)


def row_residuals(
    df: DataFrame, score_map: np.ndarray, loadings: np.ndarray, mean: np.ndarray
) -> DataFrame:
    """(y - mean) W C' - (y - mean) per row, as ``residual``."""
    w, c, m = (np.asarray(a, float) for a in (score_map, loadings, mean))

    def residual(block):
        z = block - m
        return (z @ w) @ c.T - z

    return map_rows(df, residual, "residual", width(df, len(m)))
