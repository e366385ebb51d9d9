"""Factor analysis (one noise variance per column) fitted by EM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..plans.moments import moment_source
from .model import FactorModel, Start, StopRule, start_values
from .probe import ErrorProbe, Round, held, run_rounds
from .rotate import rotated

MIN_NOISE = 5e-15


def log_likelihood(n, psi, v, beta_s_beta, var) -> float:
    """Log-likelihood from k x k quantities and the column variances.

    With precision M = (psi + C C')^-1: log det M = log det V - sum log psi, and
    tr(M S) = sum S_jj / psi_j - tr(V G), G = V^-1 (b S b') V^-1.
    """
    d = len(psi)
    v_inv = np.linalg.inv(v)
    log_det = np.linalg.slogdet(v)[1] - np.sum(np.log(psi))
    trace = np.sum(var / psi) - np.sum(v * (v_inv @ beta_s_beta @ v_inv))
    return float(-0.5 * n * (d * math.log(2 * math.pi) - log_det + trace))


def fa_fit(
    df: DataFrame,
    k: int,
    *,
    max_iter: int = 3,
    error_rate: float | str | None = None,
    tol: float = 1.0,
    init: Start | int | None = None,
    plan: str = "auto",
    d: int | None = None,
    n_rows: int | None = None,
    canonical: bool = False,
    persist: bool = False,
) -> FactorModel:
    """Fits y = C x + mean + noise with its own noise variance per column.

    Only column variances and the moments of the scores are needed, so no D x D
    inverse is formed.  Stops after ``max_iter`` rounds or when the
    log-likelihood (of the parameters a round starts with) gains at most ``tol``.
    """
    with held(df, persist) as rows:
        src = moment_source(rows, plan, d, n_rows)
        loadings, psi = start_values(src.d, k, init, per_column=True)
        stop = StopRule(max_iter, tol, relative=False)
        last = run_rounds(fa_rounds(src, loadings, psi), stop, ErrorProbe(rows, src, error_rate), src)
        model = FactorModel("fa", last.loadings, src.mean, last.noise, src.n, history=tuple(stop.history))
        return rotated(model, src) if canonical else model


def fa_rounds(src, loadings: np.ndarray, psi: np.ndarray) -> Iterator[Round]:
    """EM rounds; a round's objective belongs to the parameters it starts with."""
    n = src.n
    var = src.col_ss / n
    eye = np.eye(loadings.shape[1])
    psi = np.maximum(psi, MIN_NOISE)
    while True:
        weighted = loadings / psi[:, None]
        v = np.linalg.inv(eye + loadings.T @ weighted)
        score_map = weighted @ v
        xtx, ytx = src.moments(score_map)
        xtx, ytx = xtx / n, ytx / n
        objective = log_likelihood(n, psi, v, xtx, var)
        sigma = eye + xtx - score_map.T @ loadings
        loadings = np.linalg.solve(sigma.T, ytx.T).T
        psi = np.maximum(var - np.sum(loadings * ytx, axis=1), MIN_NOISE)
        yield Round(score_map, loadings, psi, objective)
