"""Downstream evaluation of reduced rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import literal_array
from ..plans.blocks import checked_rows, dense_block, list_array
from ..plans.cell_blocks import sum_lists
from ..plans.moments import column_stats
from .kernel import FEATURES, fourier_features, svm_fit, svm_predict
from .model import FactorModel, StopRule, start_values
from .pca import shares_frame
from .rotate import orthonormal
from .rows import latent_scores
from .stats import normalized_scatter


#: aggregates of one grouped pass, and bytes of sums that a task of the array form keeps
MAX_GROUP_PRODUCTS, GROUP_BYTES = 600, 64 << 20


def accuracy_of(
    df: DataFrame, label: str, features: str = "x", c: float = 2.0, max_iter: int = 20, kernel: str = "linear",
    n_features: int = FEATURES, gamma: float | None = None,
) -> float:
    """Accuracy of a multi-class SVM trained and scored on the same rows.

    ``c`` weighs the summed squared hinge loss.  ``kernel`` is linear or rbf, the latter by
    ``n_features`` random Fourier features of width ``gamma`` (see ``scale_gamma``).
    """
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"unknown kernel {kernel!r}; use linear or rbf")
    rows = df.select(F.col(features).alias("y"), F.col(label).alias("label")).filter("label IS NOT NULL")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        made = fourier_features(rows, n_features, gamma) if kernel == "rbf" else rows
        scored = svm_predict(made, svm_fit(made, "label", c, max_iter=max_iter))
        return scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    finally:
        rows.unpersist()


def linear_classes(df: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """Rows ``y`` scored by a linear map with a column per class: ``predicted``, the first of the best."""
    scores = latent_scores(df, weights).withColumnRenamed("x", "_scores")
    if bias is not None:
        scores = scores.withColumn("_scores", F.zip_with("_scores", literal_array(np.asarray(bias, float)), lambda a, b: a + b))
    best = F.array_position(F.col("_scores"), F.array_max("_scores")) - 1
    return scores.withColumn("predicted", best.cast("int")).drop("_scores")


def confusion(df: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """``label, predicted, n`` and the share of all rows that are right, ``accuracy``."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    total = counts.agg((right / F.sum("n")).alias("accuracy"))
    # one row, broadcast
    return counts.join(F.broadcast(total))


def explained_variance(model: FactorModel, spark: SparkSession) -> DataFrame:
    """Shares of the total variance along a rotated model's axes."""
    if model.var_exp is None:
        raise ValueError("fit with canonical=True or rotate the model first")
    return shares_frame(model, spark)


def singular_value_share(df: DataFrame, k: int) -> float:
    """Sum of the k largest singular values of the variance-normalised rows over
    the sum of all; the values themselves, not their squares."""
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(normalized_scatter(df))[::-1], 0.0))
    return float(values[:k].sum() / values.sum())


def eigenvalue_share(model: FactorModel, k: int) -> float:
    """Sum of the k largest |eigenvalues| over the sum of all that were fitted."""
    values = np.sort(np.abs(model.eigenvalues))[::-1]
    return float(values[:k].sum() / values.sum())


def score_summary(scores: DataFrame, score: str, *keys: str) -> DataFrame:
    """Mean and population sd of a score per group."""
    return scores.groupBy(*keys).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd")
    )


def group_products(df: DataFrame, d: int, grp: str = "grp") -> DataFrame:
    """``grp, n, var ARRAY, cov ARRAY`` (upper triangle, row by row): population moments of
    the columns of ``y`` in each group, from one aggregation."""
    y = checked_rows("y", d)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = df.select(F.col(grp).alias("grp"), *[y[j].alias(f"y{j}") for j in range(d)])
    return rows.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.array(*[F.count(f"y{j}") for j in range(d)]).alias("seen"),
        F.array(*[F.covar_pop(f"y{i}", f"y{j}") for i, j in pairs]).alias("cov"),
    )


def group_sums(df: DataFrame, d: int, mean: np.ndarray, grp: str = "grp", held_bytes: int = GROUP_BYTES) -> DataFrame:
    """``grp, v``: per group the number of rows, the sums of y - mean, and the upper triangle of its products.

    A task keeps one array per group it meets and passes all of them on when they grow
    beyond ``held_bytes``; arrays of a group are then added up, so columns and groups can both be many.
    """
    upper = np.triu_indices(d)
    size = 1 + d + len(upper[0])

    def task(batches):
        held: dict = {}

        def out(kind):
            return pa.record_batch([pa.array(list(held), kind), list_array(np.stack(list(held.values())))], names=["grp", "v"])

        kind = None
        for batch in batches:
            kind = batch.schema[0].type
            names = batch.column(0).to_pylist()
            order = {}
            for i, name in enumerate(names):
                order.setdefault(name, []).append(i)
            y = dense_block(batch.column(1), d)
            for name, rows in order.items():
                z = y[rows] - mean
                if not np.isfinite(z).all():
                    raise ValueError(f"group {name}: NULL cells: use the fit for missing values")
                held.setdefault(name, np.zeros(size))
                held[name] += np.concatenate(([len(rows)], z.sum(axis=0), (z.T @ z)[upper]))
                if len(held) * size * 8 > held_bytes:
                    yield out(kind)
                    held.clear()
        if held:
            yield out(kind)

    kind = df.schema[grp].dataType.simpleString()
    partial = df.select(F.col(grp).alias("grp"), "y").mapInArrow(task, f"grp {kind}, v ARRAY<DOUBLE>")
    return sum_lists(partial, "grp", "v", size)


def group_covariances(df: DataFrame, d: int, grp: str = "grp") -> DataFrame:
    """``grp, n, cov``: population covariances (upper triangle, row by row) per group of complete rows of any width."""
    mean = column_stats(df, d).mean
    upper = np.triu_indices(d)

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                v = dense_block(batch.column(1), 1 + d + len(upper[0]))
                n, s = v[:, 0], v[:, 1 : d + 1] / v[:, :1]
                cov = v[:, d + 1 :] / n[:, None] - s[:, upper[0]] * s[:, upper[1]]
                yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int64)), list_array(cov)], names=["grp", "n", "cov"])

    kind = df.schema[grp].dataType.simpleString()
    return group_sums(df, d, mean, grp).mapInArrow(task, f"grp {kind}, n BIGINT, cov ARRAY<DOUBLE>")


def model_comparison(df: DataFrame, k: int, d: int, grp: str = "grp", **fit_options) -> DataFrame:
    """Variance share of PCA and PPCA per data group of complete rows: ``method, grp, share``.

    PCA: singular-value share of the variance-normalised rows.  PPCA: fitted with all
    columns as components on z-scored rows, share of the k largest.  Both follow
    from the groups' products, which one pass gathers; groups are fitted in tasks, side
    by side.  Products of narrow rows are written out in SQL, those of wide rows are
    array sums per group.
    """
    options = dict(fit_options)

    def fit(batches):
        for batch in batches:
            methods, names, shares = [], [], []
            cols = {c: batch.column(c).to_pylist() for c in ("grp", "n", "seen", "cov")}
            for name, n, seen, cov in zip(cols["grp"], cols["n"], cols["seen"], cols["cov"]):
                if any(c != n for c in seen):
                    raise ValueError(f"group {name}: NULL cells: use the fit for missing values")
                both = shares_of_products(n, np.array(cov, float), d, k, **options)
                for method, share in zip(("pca", "ppca"), both):
                    methods.append(method)
                    names.append(name)
                    shares.append(share)
            field = batch.schema.field("grp").type
            yield pa.record_batch([pa.array(methods), pa.array(names, field), pa.array(shares, pa.float64())], names=["method", "grp", "share"])

    kind = df.schema[grp].dataType.simpleString()
    if d * (d + 1) // 2 <= MAX_GROUP_PRODUCTS:
        products = group_products(df, d, grp)
    else:
        products = group_covariances(df, d, grp).select("grp", "n", F.array("n").alias("seen"), "cov")
    return products.mapInArrow(fit, f"method STRING, grp {kind}, share DOUBLE")


def shares_of_products(n: int, cov: np.ndarray, d: int, k: int, max_iter: int | None = None, tol: float = 1e-4, init=None):
    """(PCA share, PPCA share) from a group's covariances."""
    from .missing import Patterns, along_axes, missing_rounds

    full = np.zeros((d, d))
    full[np.triu_indices(d)] = cov
    full = full + np.triu(full, 1).T
    var = np.diag(full)
    # rows scaled by 1 / (n var): the scatter scales with them
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(full * n / np.outer(var * n, var * n))[::-1], 0.0))
    pca = float(values[:k].sum() / values.sum())
    corr = full / np.sqrt(np.outer(var, var))
    whole = Patterns(np.zeros((1, d), dtype=bool), np.array([n]), np.zeros((1, d)), n * corr[None])
    loadings, _ = start_values(d, d, init, per_column=False, dist="normal")
    loadings, _ = missing_rounds(whole, loadings, n, 0, StopRule(max_iter, tol, relative=True, min_rounds=6))
    q = orthonormal(loadings)
    _, found, _ = along_axes(whole.projections(q), q, n)
    found = np.sort(np.abs(found))[::-1]
    return pca, float(found[:k].sum() / found.sum())
