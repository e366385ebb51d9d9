"""Whole-matrix aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import literal_array
from ..plans.blocks import flat_sum, iter_blocks, width
from ..plans.budget import MAX_GRAM_COLUMNS
from ..plans.moments import column_stats, iter_sparse_blocks, moment_source, scatter
from .lagged import scatter_pairs


def matrix_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A model-sized array as ``i, j, value``."""
    m = np.atleast_2d(m)
    i, j = np.indices(m.shape)
    rows = zip(i.ravel().tolist(), j.ravel().tolist(), m.ravel().tolist())
    return spark.createDataFrame(list(rows), "i INT, j INT, value DOUBLE")


def column_means(df: DataFrame, d: int | None = None) -> DataFrame:
    """``col_id, n, mean, var_pop`` per column."""
    return null_aware_stats(df, d)


def null_aware_stats(df: DataFrame, d: int | None = None) -> DataFrame:
    """Count, mean and population variance over the observed cells of each column."""
    s = column_stats(df, d)
    rows = [
        (j, int(s.count[j]), None if s.count[j] == 0 else float(s.mean[j]),
         None if s.count[j] == 0 else float(s.var_pop[j]))
        for j in range(s.d)
    ]
    return df.sparkSession.createDataFrame(rows, "col_id INT, n BIGINT, mean DOUBLE, var_pop DOUBLE")


def frobenius_norm2(df: DataFrame, d: int | None = None) -> float:
    return column_stats(df, d).norm2


def cross_moments(
    df: DataFrame, w: np.ndarray, plan: str = "rows", d: int | None = None, n_rows: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, Yc'X) for X = Yc W, both centered."""
    return moment_source(df, plan, d, n_rows).moments(np.asarray(w, float))


def variance_cross_term(df: DataFrame, w: np.ndarray, c: np.ndarray, plan: str = "rows") -> float:
    """Sum over rows of x C' (y - mean)' = tr(C' Yc'X); needs no pass of its own."""
    _, ytx = cross_moments(df, w, plan)
    return float(np.sum(np.asarray(c, float) * ytx))


def l1_errors(
    df: DataFrame, fits: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, absent: float = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Column L1 sums of the residuals of several fits and of the centered input.

    One pass over dense or sparse rows serves all (score map, loadings) pairs.
    ``absent`` all-zero rows that are not stored are added in closed form.
    Without any row all sums are NaN: nothing was measured.
    """
    m = np.asarray(mean, float)
    fits = [(np.asarray(w, float), np.asarray(c, float)) for w, c in fits]
    d, sparse = len(m), "idx" in df.columns

    def accumulate(batches):
        n, err, norm = 0, np.zeros((len(fits), d)), np.zeros(d)
        for block in iter_sparse_blocks(batches, d) if sparse else iter_blocks(batches, d):
            z = block - m
            n += len(block)
            norm += np.abs(z).sum(axis=0)
            for r, (w, c) in enumerate(fits):
                err[r] += np.abs((z @ w) @ c.T - z).sum(axis=0)
        return {"n": np.array([n]), "err": err, "norm": norm}

    rows = df.select("idx", "val") if sparse else df.select("y")
    r = flat_sum(rows, {"n": (1,), "err": (len(fits), d), "norm": (d,)}, accumulate)
    err, norm = r["err"], r["norm"]
    if not r["n"][0] and not absent:
        return np.full_like(err, np.nan), np.full_like(norm, np.nan)
    if absent:
        err = err + absent * np.stack([np.abs(m - (m @ w) @ c.T) for w, c in fits])
        norm = norm + absent * np.abs(m)
    return err, norm


def l1_error(
    df: DataFrame, w: np.ndarray, c: np.ndarray, mean: np.ndarray, absent: float = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The same for one fit.  The maxima are matrix 1-norms, their ratio the relative error."""
    err, norm = l1_errors(df, [(w, c)], mean, absent)
    return err[0], norm


def l1_ratio(err: np.ndarray, norm: np.ndarray) -> float | None:
    """The relative error; None when it is not defined.

    That is so when no row was looked at, and for a constant matrix that is not
    reproduced.  A constant matrix that is reproduced has error 0.
    """
    top, most = (float(np.max(a, initial=0.0)) for a in (norm, err))
    if top > 0:
        return most / top
    return 0.0 if top == 0 and most == 0 else None


def array_sum(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """Element-wise sums of an array column per group: ``keys, total``.

    Sums by (key, position) combine before the shuffle and spread a hot key over
    its positions; only the sums are put back into arrays.
    """
    flat = df.select(*keys, F.posexplode(array).alias("pos", "v"))
    sums = flat.groupBy(*keys, "pos").agg(F.sum(F.col("v").cast("double")).alias("v"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("e"))
    return whole.select(*keys, F.col("e.v").alias("total"))


def covariance_matrix(df: DataFrame, d: int | None = None, ddof: int = 0) -> DataFrame:
    """Covariances ``i, j, value``; population form by default.

    One scatter pass up to MAX_GRAM_COLUMNS; beyond, column tiles are multiplied
    on the cluster and the D x D result never visits the driver.
    """
    d = width(df, d)
    if d > MAX_GRAM_COLUMNS:
        return scatter_pairs(df, d, ddof)
    n, _, g = scatter(df, d)
    return matrix_frame(df.sparkSession, g / (n - ddof))


def normalized_scatter_frame(df: DataFrame, d: int | None = None) -> DataFrame:
    """``i, j, value`` of Z'Z for any width: tiles beyond MAX_GRAM_COLUMNS, as for covariances."""
    d = width(df, d)
    if d <= MAX_GRAM_COLUMNS:
        return matrix_frame(df.sparkSession, normalized_scatter(df, d))
    stats = column_stats(df, d)
    scale = 1.0 / (stats.var_pop * stats.n_rows)
    pairs = scatter_pairs(df, d, 0)
    by = lambda c: F.element_at(literal_array(scale), F.col(c) + 1)
    return pairs.select("i", "j", (F.col("value") * float(stats.n_rows) * by("i") * by("j")).alias("value"))


def normalized_scatter(df: DataFrame, d: int | None = None) -> np.ndarray:
    """Z'Z of the variance-normalised rows, from one scatter pass.

    Z scales column j by 1 / (n var_j), and scaling commutes with the scatter.
    """
    n, _, g = scatter(df, d)
    scale = 1.0 / np.diag(g)
    return g * np.outer(scale, scale)
