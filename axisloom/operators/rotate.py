"""Canonical rotation: orthonormal loadings ordered by score variance."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..plans.moments import moment_source


def fix_signs(basis: np.ndarray) -> np.ndarray:
    """Makes the largest entry of every column positive."""
    top = np.argmax(np.abs(basis), axis=0)
    sign = np.sign(basis[top, np.arange(basis.shape[1])])
    return basis * np.where(sign == 0, 1.0, sign)


def orthonormal(loadings: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the column space (rank-deficient columns left out)."""
    u, s, _ = np.linalg.svd(loadings, full_matrices=False)
    keep = s > s.max(initial=0.0) * max(loadings.shape) * np.finfo(float).eps
    return u[:, keep]


def ordered_axes(q: np.ndarray, score_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotates basis ``q`` to the eigenvectors of its score covariance, largest first."""
    values, vectors = np.linalg.eigh(score_cov)
    order = np.argsort(values)[::-1]
    return fix_signs(q @ vectors[:, order]), values[order]


def rotated(model, src):
    """The model with canonical axes; adds eigenvalues and explained variance.

    Eigenvalues are sample variances (ddof 1) of the scores, the total is the
    sum of population variances of the columns.
    """
    q = orthonormal(model.loadings)
    scatter_k, _ = src.moments(q)
    axes, values = ordered_axes(q, scatter_k / (src.n - 1))
    total = float(np.sum(src.col_ss)) / src.n
    return replace(model, axes=axes, eigenvalues=values, var_exp=np.cumsum(values) / total)


def canonical_rotation(df: DataFrame, model, plan: str = "auto"):
    """Canonical form of a fitted model with respect to the rows of ``df``."""
    return rotated(model, moment_source(df, plan, model.d))
