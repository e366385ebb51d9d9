"""The kernel classifier and the randomized components."""

import time

import numpy as np
import pytest
from fixtures import angle, low_rank
from pyspark.sql import functions as F

from axisloom import operators as op
from axisloom.operators.evaluate import accuracy_of
from axisloom.operators.kernel import fourier_map


def labelled(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id BIGINT, y ARRAY<DOUBLE>, label INT").repartition(5)


def blobs(n=600, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((4, 6)) * 1.6
    y = rng.integers(0, 4, n)
    return centers[y] + rng.standard_normal((n, 6)), y


def test_features_approach_the_kernel(spark):
    x, y = blobs(80)
    got = op.fourier_features(labelled(spark, x, y), 4000, gamma=0.1).orderBy("row_id").collect()
    z = np.array([r.y for r in got])
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.08
    w, phase = fourier_map(3, 500, 0.5)
    assert abs(w.var() - 1) < 0.1 and 0 < phase.min() and phase.max() < 2 * np.pi
    assert np.isclose(op.scale_gamma(labelled(spark, x, y), 6), 1 / (6 * x.var()))


def test_linear_fit_is_the_optimum(spark):
    x, y = blobs()
    model = op.svm_fit(labelled(spark, x, y), "label", c=2.0)
    z = np.column_stack((x, np.ones(len(x))))
    ridge = np.append(np.ones(6), 1e-6)
    for j in range(4):
        t = np.where(y == j, 1.0, -1.0)
        slack = np.maximum(1 - t * (z @ model.weights[:, j]), 0)
        gradient = ridge * model.weights[:, j] - 4.0 * z.T @ (t * slack)
        assert np.abs(gradient).max() < 1e-2 * len(x)
    assert model.passes < 20


def test_accuracy_within_a_point_of_one_against_the_rest(spark):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    x, y = blobs()
    df = labelled(spark, x, y)
    data = df.select(array_to_vector("y").alias("features"), F.col("label").cast("double").alias("label"))
    fitted = OneVsRest(classifier=LinearSVC(maxIter=100, regParam=1.0 / (2 * len(x))), parallelism=4).fit(data)
    want = fitted.transform(data).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(accuracy_of(df, "label", "y") - want) < 0.01


def test_rings_need_the_kernel(spark):
    rng = np.random.default_rng(0)
    a, r = rng.uniform(0, 2 * np.pi, 600), rng.integers(1, 4, 600)
    x = np.column_stack((r * np.cos(a), r * np.sin(a))) + 0.1 * rng.standard_normal((600, 2))
    df = labelled(spark, x, r)
    assert accuracy_of(df, "label", "y") < 0.7 < 0.97 < accuracy_of(df, "label", "y", kernel="rbf", gamma=1.0)
    with pytest.raises(ValueError, match="kernel"):
        accuracy_of(df, "label", "y", kernel="cubic")


def test_odd_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "b"), (2, [2.0, 1.0], "b"), (3, [0.0, 0.0], None)], "row_id BIGINT, y ARRAY<DOUBLE>, label STRING")
    model = op.svm_fit(df, "label")
    assert model.classes == ("b",)
    assert {r.predicted for r in op.svm_predict(df, model).collect()} == {"b"}
    with pytest.raises(ValueError, match="no labelled"):
        op.svm_fit(df.filter("label IS NULL"), "label")


def test_randomized_components_equal_exact_ones(spark, as_rows):
    m = low_rank(200, 64, 5, noise=0.2)
    got = op.pca_randomized(as_rows(m), 5, plan="rows")
    centered = m - m.mean(axis=0)
    _, s, vt = np.linalg.svd(centered, full_matrices=False)
    assert np.allclose(got.eigenvalues, s[:5] ** 2 / 199, rtol=1e-6) and angle(got.axes, vt[:5].T) < 1e-3
    assert np.allclose(got.var_exp, np.cumsum(s[:5] ** 2) / (s**2).sum(), rtol=1e-6)
    assert np.allclose(got.axes.T @ got.axes, np.eye(5))
    sparse = np.where(np.abs(m) > 5.5, m, 0.0)
    rows = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(sparse)], "row_id BIGINT, idx ARRAY<INT>, val ARRAY<DOUBLE>")
    found = op.pca_fit(rows, 3, d=64)
    s = np.linalg.svd(sparse - sparse.mean(axis=0), compute_uv=False)
    assert np.allclose(found.eigenvalues, s[:3] ** 2 / 199, rtol=1e-4)


def test_wide_rows_form_no_scatter_matrix(spark):
    d, n = 20_000, 60
    begin = time.time()
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000.0) + F.col("id") * (j % 7 == 0).cast("double")).alias("y"))
    model = op.pca_fit(rows, 2, d=d)
    assert model.axes.shape == (d, 2) and model.var_exp[0] > 0.9 and time.time() - begin < 120
