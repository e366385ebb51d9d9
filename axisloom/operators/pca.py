"""PCA baseline: Spark ML's own estimator, and a randomized one for wide matrices, behind the same model type."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame

from ..plans.blocks import width
from ..plans.budget import gram_fits
from ..plans.moments import column_stats, moment_source
from .model import FactorModel
from .rotate import fix_signs

#: directions beyond k, and passes at most, of the randomized form
OVERSAMPLE, PASSES = 10, 30


def pca_randomized(
    df: DataFrame, k: int, *, d: int | None = None, n_rows: int | None = None, oversample: int = OVERSAMPLE,
    passes: int = PASSES, tol: float = 1e-9, seed: int = 0, plan: str = "auto",
) -> FactorModel:
    """Principal components of dense or sparse rows of any width, by block power passes.

    A random D x (k + ``oversample``) block is multiplied by the centered scatter matrix
    without forming it (one pass over the rows: Yc'(Yc Q)) and made orthonormal, until the
    k largest variances change by less than ``tol`` relatively.  Nothing is larger than the
    block.  Same model as ``pca_fit``.
    """
    src = moment_source(df, plan, d, n_rows)
    size = min(k + oversample, src.d)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((src.d, size)))
    before = None
    for _ in range(passes):
        xtx, ytx = src.moments(q)
        values, vectors = np.linalg.eigh(xtx / (src.n - 1))
        order = np.argsort(values)[::-1][:k]
        if before is not None and np.all(np.abs(values[order] - before) <= tol * max(values[order][0], 1e-300)):
            break
        before = values[order]
        q, _ = np.linalg.qr(ytx)
    else:
        xtx, _ = src.moments(q)
        values, vectors = np.linalg.eigh(xtx / (src.n - 1))
        order = np.argsort(values)[::-1][:k]
    axes, values = fix_signs(q @ vectors[:, order]), values[order]
    total = float(np.sum(src.col_ss)) / (src.n - 1)
    rest = (total - values.sum()) / max(src.d - k, 1)
    return FactorModel(
        "pca", axes, src.mean, np.full(src.d, max(rest, 0.0)), src.n,
        axes=axes, eigenvalues=values, var_exp=np.cumsum(values) / total,
    )


def pca_fit(df: DataFrame, k: int, d: int | None = None) -> FactorModel:
    """Principal components; ``var_exp`` is the cumulative share of variance.

    Wide or sparse rows go to ``pca_randomized``, so no D x D matrix is formed for them.
    """
    if "idx" in df.columns or not gram_fits(width(df, d)):
        return pca_randomized(df, k, d=d)
    stats = column_stats(df)
    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector("y").alias("v")))
    axes = fix_signs(np.array(fitted.pc.toArray()))
    share = np.array(fitted.explainedVariance.toArray())
    total = float(stats.var_pop.sum()) * stats.n_rows / (stats.n_rows - 1)
    rest = (1 - share.sum()) * total / max(stats.d - k, 1)
    return FactorModel(
        "pca", axes, stats.mean, np.full(stats.d, max(rest, 0.0)), stats.n_rows,
        axes=axes, eigenvalues=share * total, var_exp=np.cumsum(share),
    )


def shares_frame(model: FactorModel, spark) -> DataFrame:
    """``comp, share, cumulative`` of explained variance."""
    cumulative = [float(v) for v in model.var_exp]
    rows = [(j, cumulative[j] - (cumulative[j - 1] if j else 0.0), cumulative[j]) for j in range(len(cumulative))]
    return spark.createDataFrame(rows, "comp INT, share DOUBLE, cumulative DOUBLE")
