import numpy as np
import pytest
from fixtures import low_rank
from pyspark.sql import functions as F

from axisloom import operators as op
from axisloom.operators.rows import default_sample_rate
from axisloom.plans.moments import column_stats


def values(df, col="y"):
    return np.array([[np.nan if v is None else v for v in r[col]] for r in df.orderBy("row_id").collect()])


@pytest.fixture(scope="module", params=[4, 40])
def m(request):
    """Narrow (SQL plan) and wide (Arrow plan) rows."""
    return low_rank(60, request.param, 3) + 1e3


def with_gaps(m):
    gaps = m.copy()
    gaps[np.random.default_rng(2).random(m.shape) < 0.15] = np.nan
    return gaps


def test_statistics_ignore_missing_cells(as_rows, m):
    gaps = with_gaps(m)
    s = column_stats(as_rows(gaps))
    assert s.n_rows == len(m)
    assert np.array_equal(s.count, (~np.isnan(gaps)).sum(axis=0))
    assert np.allclose(s.mean, np.nanmean(gaps, axis=0), rtol=1e-12)
    assert np.allclose(s.var_pop, np.nanvar(gaps, axis=0), rtol=1e-9)


def test_scaling(as_rows, m):
    df = as_rows(m)
    assert np.allclose(values(op.center_rows(df)), m - m.mean(axis=0))
    assert np.allclose(values(op.zscore_rows(df)), (m - m.mean(axis=0)) / m.std(axis=0))
    assert np.allclose(values(op.variance_normalize(df)), (m - m.mean(axis=0)) / m.var(axis=0) / len(m))
    gaps = with_gaps(m)
    z = values(op.zscore_rows(as_rows(gaps)))
    assert np.allclose(z, (gaps - np.nanmean(gaps, axis=0)) / np.nanstd(gaps, axis=0), equal_nan=True)
    filled = op.fill_missing(op.zscore_rows(as_rows(gaps)))
    assert np.allclose(values(filled), np.nan_to_num(z))
    assert filled.agg(F.sum("n_missing")).first()[0] == np.isnan(gaps).sum()


def test_columns_without_variance_are_refused(as_rows):
    with pytest.raises(ValueError, match="variance"):
        op.zscore_rows(as_rows(np.ones((5, 2))))


def test_scatter_and_norm(as_rows, m):
    z = (m - m.mean(axis=0)) / m.var(axis=0) / len(m)
    assert np.allclose(op.normalized_scatter(as_rows(m)), z.T @ z, rtol=1e-6, atol=1e-12)
    assert np.isclose(op.frobenius_norm2(as_rows(m)), ((m - m.mean(axis=0)) ** 2).sum())
    s = np.linalg.svd(z)[1]
    assert np.isclose(op.singular_value_share(as_rows(m[:, :4]), 2), _share(m[:, :4], 2))
    assert len(s)


def _share(m, k):
    s = np.linalg.svd((m - m.mean(axis=0)) / m.var(axis=0) / len(m))[1]
    return s[:k].sum() / s.sum()


def test_infinite_cells_become_the_largest_finite_one(as_rows):
    m = np.array([[1, np.inf, np.nan], [7, -np.inf, 3], [2, 5, -9]])
    want = np.array([[1, 7, np.nan], [7, 7, 3], [2, 5, -9]])
    assert np.array_equal(values(op.clip_infinite(as_rows(m))), want, equal_nan=True)


def test_rarely_observed_columns_are_dropped(as_rows):
    m = np.array([[1, np.nan, 3], [4, np.nan, np.nan], [7, 8, 9]])
    df, kept = op.keep_observed_columns(as_rows(m), 2)
    assert kept == [0, 2]
    assert np.array_equal(values(df), m[:, kept], equal_nan=True)
    assert op.keep_observed_columns(as_rows(m))[1] == [0, 1, 2]


def test_linear_maps(as_rows, m):
    d = m.shape[1]
    w, c = np.random.default_rng(0).standard_normal((2, d, 3))
    mean = m.mean(axis=0)
    assert np.allclose(values(op.latent_scores(as_rows(m), w), "x"), m @ w)
    assert np.allclose(values(op.latent_scores(as_rows(m), w, mean), "x"), (m - mean) @ w)
    z = m - mean
    assert np.allclose(values(op.row_residuals(as_rows(m), w, c, mean), "residual"), z @ w @ c.T - z)
    err, norm = op.l1_error(as_rows(m), w, c, mean)
    assert np.allclose(err, np.abs(z @ w @ c.T - z).sum(axis=0))
    assert np.allclose(norm, np.abs(z).sum(axis=0))
    assert np.isclose(op.variance_cross_term(as_rows(m), w, c), np.sum((z @ w) * (z @ c)))


def test_sample_rule_and_repeatability(spark):
    assert [default_sample_rate(n) for n in (1, 9999, 10_000, 123_456)] == [1, 1, 0.1, 0.01]
    df = spark.range(20_000).select(F.col("id").alias("row_id"))
    one = {r.row_id for r in op.sample_rows(df, 0.1).collect()}
    assert one == {r.row_id for r in op.sample_rows(df.repartition(7), 0.1).collect()}
    assert 1800 < len(one) < 2200
    assert one != {r.row_id for r in op.sample_rows(df, 0.1, seed=1).collect()}
    assert op.sample_rows(df, 0).count() == 0


def test_array_sum(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0])], "k STRING, v ARRAY<DOUBLE>")
    assert {r.k: r.total for r in op.array_sum(df, "v", "k").collect()} == {"a": [4.0, 6.0], "b": [5.0]}
    assert op.array_sum(df.filter("k = 'a'"), "v").first().total == [4.0, 6.0]


def test_trials(spark):
    x = np.random.default_rng(0).standard_normal((3, 4, 5))
    rows = [(c, i, t, float(x[c, i, t])) for c in range(3) for i in range(4) for t in range(5)]
    trials = spark.createDataFrame(rows, "cell INT, trial INT, t INT, value DOUBLE")
    noise = op.trials_to_matrix(op.remove_trial_mean(trials), 3, 5)
    assert np.allclose(values(noise), (x - x.mean(axis=1, keepdims=True)).reshape(3, 20).T)


def test_ragged_rows_raise(spark):
    df = spark.createDataFrame([(0, [0.0] * 40), (1, [0.0] * 39)], "row_id BIGINT, y ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="ragged"):
        column_stats(df, 40)
