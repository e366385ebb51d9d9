"""One behaviour on both sides of every size limit, and no stop for want of an error."""

import numpy as np
import pytest

from axisloom import operators as op
from axisloom.operators.model import Start
from axisloom.plans.blocks import linear_rows
from axisloom.plans.moments import SparseMoments, column_stats, scatter

# below and above the limits for written-out aggregates, products and columns
WIDTHS = (3, 40)


def rows_of(spark, m, extra=()):
    data = [(i, [None if v != v else float(v) for v in row]) for i, row in enumerate(m)]
    return spark.createDataFrame(data + list(extra), "row_id BIGINT, y ARRAY<DOUBLE>")


@pytest.mark.parametrize("d", WIDTHS)
@pytest.mark.parametrize("bad", ["short", "long", "null"])
def test_bad_rows_raise_behind_many_good_ones(spark, d, bad):
    m = np.random.default_rng(0).normal(size=(400, d))
    y = {"short": [1.0] * (d - 1), "long": [1.0] * (d + 1), "null": None}[bad]
    df = rows_of(spark, m, [(400, y)])
    stats = column_stats(rows_of(spark, m))
    calls = [
        lambda: column_stats(df, d),
        lambda: scatter(df, d),
        lambda: linear_rows(df, np.ones((d, 2))).collect(),
        lambda: op.center_rows(df, stats).collect(),
        lambda: op.zscore_rows(df, stats).collect(),
        lambda: op.ppca_fit(df, 2, d=d),
    ]
    for call in calls:
        with pytest.raises(Exception, match="ragged|NULL"):
            call()


@pytest.mark.parametrize("d", WIDTHS)
def test_a_null_cell_gives_null_and_a_nan_cell_nan(spark, d):
    m = np.ones((3, d))
    df = rows_of(spark, m, [(3, [None] + [1.0] * (d - 1)), (4, [float("nan")] + [1.0] * (d - 1))])
    x = {r.row_id: r.x for r in op.latent_scores(df, np.ones((d, 2))).collect()}
    assert x[0] == [d, d] and x[3] == [None, None] and all(np.isnan(x[4]))
    stats = column_stats(df, d)
    assert stats.n_rows == 5 and stats.count[0] == 3 and stats.count[1] == 5
    with pytest.raises(ValueError, match="NULL"):
        scatter(df, d)


@pytest.mark.parametrize("d", WIDTHS)
def test_far_from_zero(spark, d):
    m = np.random.default_rng(1).normal(size=(500, d)) + 1e7
    n, mean, g = scatter(rows_of(spark, m), d)
    z = m - m.mean(axis=0)
    assert np.allclose(mean, m.mean(axis=0), rtol=1e-12) and np.allclose(g, z.T @ z, rtol=1e-5, atol=1e-4)
    assert np.allclose(column_stats(rows_of(spark, m), d).var_pop, m.var(axis=0), rtol=1e-6)
    cells = op.cells_of(rows_of(spark, m))
    assert np.allclose(SparseMoments(op.coo_to_sparse(cells, d), d).col_ss, np.diag(z.T @ z), rtol=1e-6)


@pytest.mark.parametrize("rate", [None, 1.0, 0.001])
@pytest.mark.parametrize("plan", ["gram", "rows"])
def test_an_empty_sample_does_not_end_a_fit(spark, rate, plan):
    m = np.random.default_rng(2).normal(size=(40, 5))
    with pytest.warns() if rate == 0.001 else np.errstate():
        model = op.ppca_fit(rows_of(spark, m), 2, max_iter=5, tol=0, error_rate=rate, error_tol=0.0, plan=plan, init=1)
    assert len(model.history) == 5
    assert all((h[3] is None) == (rate == 0.001) for h in model.history)


def test_error_rate_by_rows(spark):
    m = np.random.default_rng(2).normal(size=(40, 5))
    fit = lambda rate: op.ppca_fit(rows_of(spark, m), 2, max_iter=2, error_rate=rate, error_tol=0.0, init=1).history
    assert fit("by_rows") == fit(None)
    with pytest.raises(ValueError):
        fit("by_columns")


def test_ratio_of_constant_matrices():
    from axisloom.operators.stats import l1_ratio

    assert l1_ratio(np.zeros(2), np.zeros(2)) == 0.0 and l1_ratio(np.ones(2), np.zeros(2)) is None
    assert l1_ratio(np.full(2, np.nan), np.full(2, np.nan)) is None and l1_ratio(np.ones(2), np.full(2, 2.0)) == 0.5


@pytest.mark.parametrize("values", [([0, 0], [1.0, 2.0]), ([0, 1], [1.0, float("nan")]), ([0, 1], [1.0, None])])
def test_bad_sparse_rows_raise(spark, values):
    df = spark.createDataFrame([(0, *values)], "row_id BIGINT, idx ARRAY<INT>, val ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="repeated|NaN"):
        SparseMoments(df, 3)
    with pytest.raises(Exception, match="repeated|NaN"):
        op.latent_scores(df, np.ones((3, 1))).collect()


def test_cells_outside_the_columns(spark):
    cells = spark.createDataFrame([(0, -1, 1.0), (0, 0, 1.0), (0, 5, 1.0), (0, 1, 0.0)], "row_id BIGINT, col_id INT, value DOUBLE")
    assert [r.col_id for r in op.nonzero_cells(cells, 3).collect()] == [0]
    assert [r.col_id for r in op.nonzero_cells(cells).orderBy("col_id").collect()] == [0, 5]


def test_unknown_event_types_raise(spark):
    from axisloom.catalog.register import type_number

    events = spark.createDataFrame([("view",), ("novel",)], "event_type STRING")
    known = spark.createDataFrame([("view",)], "event_type STRING")
    assert known.select(type_number()).first()[0] == 4
    with pytest.raises(Exception, match="unknown event type"):
        events.select(type_number()).collect()


def test_wide_normalized_scatter_by_tiles(spark, monkeypatch):
    from axisloom.operators import stats

    m = np.random.default_rng(3).normal(size=(60, 7))
    want = op.normalized_scatter(rows_of(spark, m))
    monkeypatch.setattr(stats, "MAX_GRAM_COLUMNS", 4)
    got = np.zeros((7, 7))
    for r in stats.normalized_scatter_frame(rows_of(spark, m)).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, want)


@pytest.mark.parametrize("tile,bundle", [(256, 1 << 18), (7, 50)])
def test_covariance_of_sparse_cells(spark, tile, bundle):
    """Also with many small tiles and bundles, an empty column and a column that every row has."""
    rng = np.random.default_rng(5)
    m = np.where(rng.random((120, 40)) < 0.1, rng.normal(size=(120, 40)), 0.0)
    m[:, 3], m[:, 39], m[7] = 0.0, 1 + rng.random(120), 2.0
    m[7, 3] = 0.0
    cells = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(500, 3, None), (501, 3, 0.0)]
    df = spark.createDataFrame(cells, "row_id BIGINT, col_id INT, value DOUBLE").repartition(4)
    got = {(r.i, r.j): r.cov for r in op.covariance_cells(df, 120, 40, tile, bundle).collect()}
    want = np.cov(m.T, bias=True)
    assert len(got) == 40 * 41 // 2 and all(np.isclose(v, want[k]) for k, v in got.items())
    some = op.covariance_cells(df, 120, None, tile, bundle).collect()
    met = {(i, j) for i in range(40) for j in range(i, 40) if np.any((m[:, i] != 0) & (m[:, j] != 0))}
    assert {(r.i, r.j) for r in some} == met
    assert op.covariance_cells(df.limit(0), 120).count() == 0


def test_wide_groups_are_compared(spark, monkeypatch):
    """40 columns, as array sums per group that a task passes on in between; null is a group."""
    from axisloom.operators import evaluate

    rng = np.random.default_rng(9)
    groups = ["a", None, "b"]
    m = rng.standard_normal((240, 40)) * np.linspace(1, 3, 40) + 1000
    df = spark.createDataFrame([(groups[i % 3], r.tolist()) for i, r in enumerate(m)], "grp STRING, y ARRAY<DOUBLE>").repartition(3)
    sums = evaluate.group_sums(df, 40, m.mean(axis=0), held_bytes=10_000)
    assert {r.grp: r.v[0] for r in sums.collect()} == dict.fromkeys(groups, 80.0)
    got = {r.grp: (r.n, r.cov) for r in op.group_covariances(df, 40).collect()}
    for g, name in enumerate(groups):
        want = np.cov(m[g::3].T, bias=True)[np.triu_indices(40)]
        assert got[name][0] == 80 and np.allclose(got[name][1], want)
    shares = {(r.method, r.grp): r.share for r in op.model_comparison(df, 5, 40, max_iter=3).collect()}
    for g, name in enumerate(groups):
        want = evaluate.shares_of_products(80, np.cov(m[g::3].T, bias=True)[np.triu_indices(40)], 40, 5, max_iter=3)
        assert np.allclose([shares["pca", name], shares["ppca", name]], want)
