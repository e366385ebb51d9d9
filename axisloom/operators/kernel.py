"""Multi-class support vector machines on dense rows, linear or with a radial kernel.

The kernel exp(-gamma |a - b|^2) is made explicit by random Fourier features: cosines of
fixed random directions, whose products approach it.  Directions come from digests of
column and feature number, so every task and every run has the same ones.

All classes are fitted together, one against the rest, with squared hinge loss: a pass
adds up, per class, the products of the rows inside the margin (blocks in tasks), and a
Newton step follows on the driver.  A handful of passes reaches the optimum, whatever
the partitioning; a job per class and iteration is not needed.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.blocks import dense_block, flat_sum, map_rows, width
from ..plans.budget import BLOCK_CELLS, check_bytes, wake_blas
from ..plans.moments import column_stats

FEATURES = 256
MAX_CLASSES = 1000


def _uniform(text: str) -> float:
    """In (0, 1), from the first 52 bits of a digest."""
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def fourier_map(d: int, n_features: int, gamma: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(d x m directions, m phases): normal directions with variance 2 gamma, phases in [0, 2 pi)."""
    check_bytes("Fourier map", d * n_features)
    draw = lambda j, f, part: _uniform(f"{seed}:{j}:{f}:{part}")
    normal = [[math.sqrt(-2 * math.log(draw(j, f, "r"))) * math.cos(2 * math.pi * draw(j, f, "a")) for f in range(n_features)] for j in range(d)]
    phase = np.array([2 * math.pi * _uniform(f"{seed}:phase:{f}") for f in range(n_features)])
    return math.sqrt(2 * gamma) * np.array(normal).reshape(d, n_features), phase


def scale_gamma(df: DataFrame, d: int, col: str = "y") -> float:
    """1 / (d times the variance of all cells), the usual width of the kernel."""
    stats = column_stats(df.select(F.col(col).alias("y")), d)
    var = float(stats.var_pop.mean() + stats.mean.var())
    return 1.0 / (d * var) if var > 0 else 1.0


def fourier_features(df: DataFrame, n_features: int = FEATURES, gamma: float | None = None, seed: int = 0, col: str = "y", d: int | None = None) -> DataFrame:
    """The rows with ``col`` replaced by ``n_features`` features whose products approach the kernel's values."""
    d = width(df, d, col)
    directions, phase = fourier_map(d, n_features, scale_gamma(df, d, col) if gamma is None else gamma, seed)
    size = math.sqrt(2.0 / n_features)
    made = map_rows(df, lambda block: size * np.cos(block @ directions + phase), "_features", d, col)
    return made.withColumnRenamed("_features", col)


@dataclass(frozen=True)
class SvmModel:
    """``weights``: a column per class, the last row is the bias."""

    classes: tuple
    weights: np.ndarray
    passes: int

    def scores(self, block: np.ndarray) -> np.ndarray:
        return block @ self.weights[:-1] + self.weights[-1]


def svm_fit(df: DataFrame, label: str, c: float = 2.0, col: str = "y", max_iter: int = 20, tol: float = 1e-6) -> SvmModel:
    """Fits all classes against the rest; ``c`` weighs the summed squared hinge loss.

    Rows with a null label are left out.  Classes are numbered in their order; rows of one class
    only give one class that fits all.
    """
    wake_blas()
    rows = df.filter(F.col(label).isNotNull())
    names = [r[0] for r in rows.select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    names.sort()
    if not names:
        raise ValueError("no labelled rows")
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)).cast("int") - 1
    rows = rows.select(F.col(col).alias("y"), number.alias("n"))
    d, k = width(rows), len(names)
    p = d + 1
    check_bytes("second derivatives of all classes", k * p * p)
    w, best, low = np.zeros((p, k)), np.zeros((p, k)), np.full(k, np.inf)
    shapes = {"h": (k, p, p), "g": (p, k), "loss": (k,)}
    step = max(1, BLOCK_CELLS // p)
    settled = np.zeros(k, dtype=bool)
    for done in range(1, max_iter + 1):

        def accumulate(batches, w=w.copy()):
            sums = {name: np.zeros(shape) for name, shape in shapes.items()}
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    x = np.column_stack((dense_block(part.column(0), d), np.ones(part.num_rows)))
                    own = part.column(1).to_numpy(zero_copy_only=False)
                    t = np.where(own[:, None] == np.arange(k), 1.0, -1.0)
                    slack = np.maximum(1 - t * (x @ w), 0)
                    sums["loss"] += (slack**2).sum(axis=0)
                    for j in range(k):
                        inside = slack[:, j] > 0
                        z = x[inside]
                        sums["h"][j] += z.T @ z
                        sums["g"][:, j] += z.T @ t[inside, j]
            return sums

        r = flat_sum(rows, shapes, accumulate)
        # the bias is hardly penalised: enough for an invertible matrix
        ridge = np.append(np.ones(d), 1e-6)
        value = 0.5 * (ridge[:, None] * w**2).sum(axis=0) + c * r["loss"]
        better = value < low
        # a class is settled when a full step has changed next to nothing
        if done > 1:
            settled |= np.abs(low - value) <= tol * np.maximum(np.minimum(low, value), 1e-12)
        best, low = np.where(better, w, best), np.where(better, value, low)
        if settled.all():
            break
        for j in np.flatnonzero(~settled):
            # a step that made things worse is halved
            w[:, j] = np.linalg.solve(np.diag(ridge) + 2 * c * r["h"][j], 2 * c * r["g"][:, j]) if better[j] else (best[:, j] + w[:, j]) / 2
    return SvmModel(tuple(names), best, done)


def svm_predict(df: DataFrame, model: SvmModel, col: str = "y") -> DataFrame:
    """Adds ``predicted``: the class of the largest score (the first of equal ones)."""
    d = len(model.weights) - 1
    kind = df.sparkSession.createDataFrame([(model.classes[0],)], ["n"]).schema["n"].dataType

    def best(block):
        return np.argmax(model.scores(block), axis=1)[:, None].astype(float)

    keyed = map_rows(df.withColumn("_y", F.col(col)), best, "_at", d, "_y")
    names = F.array(*[F.lit(n) for n in model.classes])
    return keyed.withColumn("predicted", F.get(names, F.col("_at")[0].cast("int")).cast(kind)).drop("_at")
