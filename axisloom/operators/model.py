"""The fitted model, its start values, stop rules and storage."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.budget import check_bytes
from .rows import latent_scores, row_residuals, zscore_rows
from ..plans.moments import ColumnStats

MODES = ("raw", "centered", "posterior")


@dataclass(frozen=True)
class Start:
    """Explicit start values; parts left out are drawn."""

    loadings: np.ndarray | None = None
    noise: float | np.ndarray | None = None


def start_values(
    d: int, k: int, init: Start | int | None, per_column: bool, dist: str = "uniform"
) -> tuple[np.ndarray, np.ndarray | float]:
    """(loadings, noise): given, or drawn from [0, 1) noise first; seed 0 by default."""
    given = init if isinstance(init, Start) else Start()
    rng = np.random.default_rng(init if isinstance(init, int) else 0)
    noise = rng.random(d) if per_column else rng.random()
    loadings = rng.random((d, k)) if dist == "uniform" else rng.standard_normal((d, k))
    if given.noise is not None:
        noise = np.asarray(given.noise, float) if per_column else float(given.noise)
    if given.loadings is not None:
        loadings = np.asarray(given.loadings, float)
        if loadings.shape != (d, k):
            raise ValueError(f"start loadings must be {d} x {k}, not {loadings.shape}")
    return loadings, noise


@dataclass
class StopRule:
    """Collects one history row per round and says when to stop."""

    max_iter: int | None
    tol: float = 0.0
    relative: bool = True
    error_tol: float | None = None
    min_rounds: int = 0
    history: list[tuple] = field(default_factory=list)

    def _change(self, objective: float) -> float:
        if not self.history:
            return math.inf
        before = self.history[-1][1]
        if not self.relative:
            return objective - before
        return abs(1 - objective / before) if before else math.inf

    def settled(self, objective: float) -> bool:
        """True when a next round with this objective ends the fit whatever its error."""
        done = len(self.history) + 1
        if self.max_iter is not None and done >= self.max_iter:
            return True
        return done > self.min_rounds and self._change(objective) <= self.tol

    def record(self, objective: float, error: float | None = None) -> bool:
        """Adds a round; True when the fit should stop."""
        if math.isnan(objective):
            raise ArithmeticError(f"objective is NaN in round {len(self.history) + 1}")
        stop = self.settled(objective)
        self.history.append((len(self.history) + 1, objective, self._change(objective), error))
        return stop or (error is not None and self.error_tol is not None and error <= self.error_tol)


@dataclass(frozen=True)
class FactorModel:
    kind: str
    loadings: np.ndarray  # D x k
    mean: np.ndarray
    noise: np.ndarray  # per column; constant for the isotropic models
    n_rows: int
    scale: np.ndarray | None = None  # set when the fit z-scored its input
    history: tuple = ()
    axes: np.ndarray | None = None  # orthonormal D x k directions, when rotated
    eigenvalues: np.ndarray | None = None
    var_exp: np.ndarray | None = None
    columns: tuple | None = None  # kept input columns, when some were dropped

    @property
    def d(self) -> int:
        return self.loadings.shape[0]

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    @property
    def directions(self) -> np.ndarray:
        """What rows are projected on: the rotated axes, or the loadings as fitted."""
        return self.loadings if self.axes is None else self.axes

    def score_map(self) -> np.ndarray:
        """D x k map from centered rows to posterior means."""
        weighted = self.loadings / self.noise[:, None]
        return weighted @ np.linalg.inv(np.eye(self.k) + self.loadings.T @ weighted)

    def covariance(self) -> np.ndarray:
        """Model covariance C C' + noise."""
        return self.loadings @ self.loadings.T + np.diag(self.noise)

    def _prepared(self, df: DataFrame, raw: bool) -> DataFrame:
        if self.columns is not None:
            kept = F.expr("array(" + ",".join(map(str, self.columns)) + ")")
            df = df.withColumn("y", F.transform(kept, lambda j: F.get("y", j)))
        if self.scale is None or raw:
            return df
        stats = ColumnStats(self.n_rows, np.full(self.d, self.n_rows), self.mean, self.scale**2)
        return zscore_rows(df, stats)

    def transform(self, df: DataFrame, mode: str = "raw") -> DataFrame:
        """Rows ``row_id, y`` -> ``row_id, x``.

        raw: y C; centered: (y - mean) C, with C the directions; posterior: the
        expected latent scores under the fitted loadings.
        A model fitted on z-scored input applies its own mean and sd first,
        except in raw mode.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; use one of {MODES}")
        ready = self._prepared(df, mode == "raw")
        mean = None if self.scale is not None or mode == "raw" else self.mean
        return latent_scores(ready, self.score_map() if mode == "posterior" else self.directions, mean)

    def residuals(self, df: DataFrame) -> DataFrame:
        mean = np.zeros(self.d) if self.scale is not None else self.mean
        return row_residuals(self._prepared(df, False), self.score_map(), self.loadings, mean)

    # --- as tables ----------------------------------------------------------

    def components(self, spark: SparkSession) -> DataFrame:
        """``col_id, loadings, mean, noise, scale, axes``: one row per column."""
        rows = [
            (j, self.loadings[j].tolist(), float(self.mean[j]), float(self.noise[j]),
             None if self.scale is None else float(self.scale[j]),
             None if self.axes is None else self.axes[j].tolist())
            for j in range(self.d)
        ]
        schema = (
            "col_id INT, loadings ARRAY<DOUBLE>, mean DOUBLE, noise DOUBLE, scale DOUBLE, axes ARRAY<DOUBLE>"
        )
        return spark.createDataFrame(rows, schema)

    def loading_rows(self, spark: SparkSession) -> DataFrame:
        """The D x k result matrix as dense rows, ready for ``write_matrix``."""
        return self.components(spark).select(
            F.col("col_id").cast("bigint").alias("row_id"), F.coalesce("axes", "loadings").alias("y")
        )

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """A row per round; the first round has no change."""
        rows = [(n, o, None if c is None or math.isinf(c) else c, e) for n, o, c, e in self.history]
        return spark.createDataFrame(rows, "round INT, objective DOUBLE, rel_change DOUBLE, error DOUBLE")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        as_list = lambda a: None if a is None else [float(v) for v in a]
        meta = [(self.kind, self.n_rows, as_list(self.eigenvalues), as_list(self.var_exp),
                 None if self.columns is None else list(self.columns))]
        schema = (
            "kind STRING, n_rows BIGINT, eigenvalues ARRAY<DOUBLE>, var_exp ARRAY<DOUBLE>, columns ARRAY<INT>"
        )
        self.components(spark).coalesce(1).write.mode(mode).parquet(os.path.join(path, "components"))
        spark.createDataFrame(meta, schema).coalesce(1).write.mode(mode).parquet(os.path.join(path, "meta"))
        self.history_frame(spark).coalesce(1).write.mode(mode).parquet(os.path.join(path, "history"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FactorModel":
        parts = spark.read.parquet(os.path.join(path, "components"))
        d = parts.count()
        k = parts.select(F.size("loadings")).first()[0]
        check_bytes("model", d * (2 * k + 3))
        rows = parts.orderBy("col_id").collect()
        meta = spark.read.parquet(os.path.join(path, "meta")).first()
        history = spark.read.parquet(os.path.join(path, "history")).orderBy("round").collect()
        as_array = lambda v: None if v is None else np.array(v)
        return FactorModel(
            kind=meta["kind"],
            loadings=np.array([r["loadings"] for r in rows]),
            mean=np.array([r["mean"] for r in rows]),
            noise=np.array([r["noise"] for r in rows]),
            n_rows=meta["n_rows"],
            scale=None if rows[0]["scale"] is None else np.array([r["scale"] for r in rows]),
            history=tuple((n, o, math.inf if c is None else c, e) for n, o, c, e in history),
            axes=None if rows[0]["axes"] is None else np.array([r["axes"] for r in rows]),
            eigenvalues=as_array(meta["eigenvalues"]),
            var_exp=as_array(meta["var_exp"]),
            columns=None if meta["columns"] is None else tuple(meta["columns"]),
        )
