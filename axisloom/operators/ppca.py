"""Probabilistic PCA (isotropic noise) fitted by EM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..plans.moments import moment_source
from .model import FactorModel, Start, StopRule, start_values
from .probe import ErrorProbe, Round, held, run_rounds
from .rotate import rotated

NOISE_TERMS = ("exact", "reference")


def ppca_fit(
    df: DataFrame,
    k: int,
    *,
    max_iter: int = 3,
    error_rate: float | str | None = None,
    tol: float = 1e-5,
    error_tol: float = 0.02,
    noise_term: str = "exact",
    init: Start | int | None = None,
    plan: str = "auto",
    d: int | None = None,
    n_rows: int | None = None,
    canonical: bool = False,
    persist: bool = False,
) -> FactorModel:
    """Fits y = C x + mean + noise with one noise variance for all columns.

    ``df`` holds dense rows (``row_id, y``) or sparse rows (``row_id, idx,
    val`` with ``d``).  Stops after ``max_iter`` rounds, when the noise variance
    changes by at most ``tol`` relatively, or when the reconstruction error is
    at most ``error_tol``.  ``error_rate`` is the share of rows the error looks
    at (None: all; "by_rows": a share that falls with N; 0: no error, and no stop
    by it).

    ``persist`` keeps the rows in memory and on local disk during the fit: worth
    it when they are costly to derive and several passes are needed.

    ``noise_term="exact"`` adds N ss Sx in the M-step, as EM requires;
    ``"reference"`` adds ss Sx once.
    """
    if noise_term not in NOISE_TERMS:
        raise ValueError(f"unknown noise_term {noise_term!r}; use one of {NOISE_TERMS}")
    with held(df, persist) as rows:
        src = moment_source(rows, plan, d, n_rows)
        loadings, ss = start_values(src.d, k, init, per_column=False)
        stop = StopRule(max_iter, tol, relative=True, error_tol=error_tol)
        last = run_rounds(ppca_rounds(src, loadings, ss, noise_term), stop, ErrorProbe(rows, src, error_rate), src)
        noise = np.full(src.d, last.noise)
        model = FactorModel("ppca", last.loadings, src.mean, noise, src.n, history=tuple(stop.history))
        return rotated(model, src) if canonical else model


def ppca_rounds(src, loadings: np.ndarray, ss: float, noise_term: str = "exact") -> Iterator[Round]:
    """EM rounds from k x k algebra and one call for moments each."""
    n, d = src.n, src.d
    norm2 = float(np.sum(src.col_ss))
    weight = n if noise_term == "exact" else 1
    eye = np.eye(loadings.shape[1])
    while True:
        sx = np.linalg.inv(loadings.T @ loadings + ss * eye)
        score_map = loadings @ sx
        xtx, ytx = src.moments(score_map)
        xtx = xtx + weight * ss * sx
        loadings = np.linalg.solve(xtx, ytx.T).T
        fitted = np.sum(xtx * (loadings.T @ loadings))
        ss = float((norm2 + fitted - 2 * np.sum(loadings * ytx)) / (n * d))
        yield Round(score_map, loadings, ss, ss)
