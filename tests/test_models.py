import numpy as np
import pytest
from fixtures import SMALL, SMALL_LOADINGS, SMALL_NOISE, START_LOADINGS, START_NOISE, TOY, angle, low_rank

from axisloom import operators as op
from axisloom.operators import missing
from axisloom.operators.model import Start, StopRule


def ppca_numpy(m, c, ss, rounds, weight=None):
    """One EM round after the other on explicit scores."""
    n, d = m.shape
    z = m - m.mean(axis=0)
    weight = n if weight is None else weight
    history = []
    for _ in range(rounds):
        sx = np.linalg.inv(ss * np.eye(c.shape[1]) + c.T @ c)
        w = c @ sx
        x = z @ w
        xx = x.T @ x + weight * ss * sx
        c = z.T @ x @ np.linalg.inv(xx)
        ss = (np.sum(z**2) + np.trace(xx @ c.T @ c) - 2 * np.sum(x * (z @ c))) / (n * d)
        e = x @ c.T - z
        history.append((ss, np.abs(e).sum(axis=0).max() / np.abs(z).sum(axis=0).max()))
    return c, ss, history


def fa_numpy(m, c, psi, rounds):
    """Textbook form with the D x D precision matrix."""
    n, d = m.shape
    z = m - m.mean(axis=0)
    s = z.T @ z / n
    ll = []
    for _ in range(rounds):
        sigma = np.diag(psi) + c @ c.T
        precision = np.linalg.inv(sigma)
        ll.append(-n / 2 * (d * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1] + np.trace(precision @ s)))
        beta = c.T @ precision
        xx = np.eye(c.shape[1]) + beta @ s @ beta.T - beta @ c
        c = s @ beta.T @ np.linalg.inv(xx)
        psi = np.diag(s) - np.diag(c @ beta @ s)
    return c, psi, ll


@pytest.mark.parametrize("plan", ["gram", "rows"])
@pytest.mark.parametrize("term,weight", [("exact", None), ("reference", 1)])
def test_ppca_equals_explicit_rounds(as_rows, plan, term, weight):
    init = Start(START_LOADINGS, START_NOISE)
    model = op.ppca_fit(as_rows(TOY), 3, max_iter=3, init=init, noise_term=term, plan=plan, error_tol=-1)
    c, ss, history = ppca_numpy(TOY, START_LOADINGS, START_NOISE, 3, weight)
    assert np.allclose(model.loadings, c, rtol=1e-8)
    assert np.isclose(model.noise[0], ss, rtol=1e-8)
    assert np.allclose([(h[1], h[3]) for h in model.history], history, rtol=1e-7)


def test_sparse_rows_give_the_dense_fit(spark, as_rows):
    init = Start(START_LOADINGS, START_NOISE)
    cells = op.nonzero_cells(op.cells_of(as_rows(TOY)))
    sparse = op.ppca_fit(op.coo_to_sparse(cells, 5), 3, d=5, init=init, error_tol=-1)
    dense = op.ppca_fit(as_rows(TOY), 3, init=init, error_tol=-1)
    assert np.allclose(sparse.loadings, dense.loadings, rtol=1e-7)
    assert np.allclose([h[1:] for h in sparse.history[1:]], [h[1:] for h in dense.history[1:]], rtol=1e-6)
    fa = [op.fa_fit(df, 2, d=5, max_iter=4, tol=-np.inf) for df in (op.coo_to_sparse(cells, 5), as_rows(TOY))]
    assert np.allclose(fa[0].loadings, fa[1].loadings, rtol=1e-6)


def test_absent_rows_count_as_zero_rows(as_rows):
    m = np.vstack([TOY, np.zeros((5, 5))])
    init = Start(START_LOADINGS, START_NOISE)
    want = op.ppca_fit(as_rows(m), 3, init=init, error_tol=-1)
    cells = op.nonzero_cells(op.cells_of(as_rows(TOY)))
    for df, plan in ((as_rows(TOY), "gram"), (as_rows(TOY), "rows"), (op.coo_to_sparse(cells, 5), "auto")):
        got = op.ppca_fit(df, 3, init=init, error_tol=-1, plan=plan, d=5, n_rows=12)
        assert np.allclose(got.loadings, want.loadings, rtol=1e-7)
        assert np.allclose([h[1] for h in got.history], [h[1] for h in want.history])
        assert np.allclose([h[3] for h in got.history], [h[3] for h in want.history])
    with pytest.raises(ValueError):
        op.ppca_fit(as_rows(TOY), 3, n_rows=3)


def test_ppca_converges_to_the_eigenvectors(as_rows):
    m = low_rank()
    model = op.ppca_fit(as_rows(m), 3, max_iter=3000, tol=1e-13, error_rate=0, canonical=True)
    values, vectors = np.linalg.eigh(np.cov(m.T, ddof=0))
    assert angle(model.axes, vectors[:, -3:]) < 1e-4
    assert np.isclose(model.noise[0], values[:4].mean(), rtol=1e-5)
    assert np.allclose(model.eigenvalues * (len(m) - 1) / len(m), values[:3:-1], rtol=1e-5)
    assert np.isclose(model.var_exp[-1], values[-3:].sum() / values.sum() * len(m) / (len(m) - 1), rtol=1e-6)
    assert np.allclose(model.axes.T @ model.axes, np.eye(3), atol=1e-12)
    pca = op.pca_fit(as_rows(m), 3)
    assert np.allclose(np.abs(pca.axes.T @ vectors[:, :3:-1]), np.eye(3), atol=1e-8)
    assert np.allclose(pca.var_exp, np.cumsum(values[:3:-1]) / values.sum())


def test_stop_by_error_is_the_same_under_every_plan(as_rows):
    m = low_rank(noise=0.01)
    fits = [op.ppca_fit(as_rows(m), 3, max_iter=60, error_tol=0.05, plan=p) for p in ("gram", "rows")]
    assert 1 < len(fits[0].history) < 60
    assert len(fits[0].history) == len(fits[1].history)
    assert fits[0].history[-1][3] <= 0.05 < fits[0].history[-2][3]
    assert np.allclose(fits[0].loadings, fits[1].loadings, rtol=1e-5)


@pytest.mark.parametrize("plan", ["gram", "rows"])
def test_fa_equals_explicit_rounds(as_rows, plan):
    init = Start(SMALL_LOADINGS, SMALL_NOISE)
    model = op.fa_fit(as_rows(SMALL), 3, max_iter=4, tol=-np.inf, init=init, plan=plan)
    c, psi, ll = fa_numpy(SMALL, SMALL_LOADINGS, SMALL_NOISE, 4)
    assert np.allclose(model.loadings, c, rtol=1e-6)
    assert np.allclose(model.noise, psi, rtol=1e-6)
    assert np.allclose([h[1] for h in model.history], ll, rtol=1e-9)
    assert all(0 < h[3] for h in model.history)


def test_fa_likelihood_never_falls_and_finds_the_noise(as_rows):
    m = low_rank(n=4000, d=8)
    model = op.fa_fit(as_rows(m), 3, max_iter=400, tol=1e-6, error_rate=0)
    ll = [h[1] for h in model.history]
    assert np.all(np.diff(ll) > -1e-6)
    sd = 0.3 * np.linspace(0.5, 1.5, 8)  # of the generator, column by column
    assert np.allclose(model.noise, sd**2, rtol=0.25)
    assert np.allclose(model.covariance(), np.cov(m.T, ddof=0), rtol=0.1, atol=0.05)


def fit_with_gaps(as_rows, noise_term="exact", **more):
    m = low_rank(120, 6)
    m[np.random.default_rng(5).random(m.shape) < 0.15] = np.nan
    c0 = np.random.default_rng(6).standard_normal((6, 2))
    more = {"max_iter": 5, "tol": 0, **more}
    return m, op.ppca_missing_fit(as_rows(m), 2, init=Start(c0), noise_term=noise_term, **more)


@pytest.mark.parametrize("noise_term", ["exact", "reference"])
def test_sums_by_pattern_and_passes_over_rows_agree(as_rows, monkeypatch, noise_term):
    m, by_pattern = fit_with_gaps(as_rows, noise_term)
    assert by_pattern.n_missing == np.isnan(m).sum()
    monkeypatch.setattr(missing, "MAX_PATTERNS", 1)
    for every, masked in ((2, 0), (2, 1 << 20), (10, 1 << 20)):
        monkeypatch.setattr(missing, "MAX_MASKED_MOMENTS", masked)
        _, fit = fit_with_gaps(as_rows, noise_term, checkpoint_every=every)
        for name in ("loadings", "noise", "axes", "eigenvalues", "var_exp"):
            assert np.allclose(getattr(fit.model, name), getattr(by_pattern.model, name), rtol=1e-6, atol=1e-9), name
        for frame, col in (("scores", "x"), ("filled", "y")):
            a, b = (np.array([r[col] for r in getattr(f, frame)().orderBy("row_id").collect()]) for f in (fit, by_pattern))
            assert np.allclose(a, b, atol=1e-8)
        fit.close()
    by_pattern.close()


def test_scores_and_filled_rows_belong_together(as_rows):
    m, fit = fit_with_gaps(as_rows)
    model, seen = fit.model, ~np.isnan(m)
    filled = np.array([r.y for r in fit.filled().orderBy("row_id").collect()])
    assert np.allclose(filled[seen], m[seen]) and np.isfinite(filled).all()
    data = (filled - model.mean) / model.scale
    scores = np.array([r.x for r in fit.scores().orderBy("row_id").collect()])
    assert np.allclose(scores, data @ model.axes, atol=1e-8)
    assert np.allclose(model.eigenvalues, np.var(scores, axis=0, ddof=1), rtol=1e-6)
    assert np.allclose(model.var_exp, np.cumsum(model.eigenvalues) / data.var(axis=0).sum())


def test_a_settled_fit_fills_cells_with_what_the_model_expects(as_rows):
    m, fit = fit_with_gaps(as_rows, max_iter=4000, tol=1e-13)
    model = fit.model
    filled = np.array([r.y for r in fit.filled().orderBy("row_id").collect()])
    z = (filled - model.mean) / model.scale
    # regression of each row's missing cells on its seen ones under the model's covariance
    cov = model.covariance()
    for row, gaps in zip(z, np.isnan(m)):
        if gaps.any():
            want = cov[np.ix_(gaps, ~gaps)] @ np.linalg.solve(cov[np.ix_(~gaps, ~gaps)], row[~gaps])
            assert np.allclose(row[gaps], want, atol=2e-2)


def test_wide_fit_with_the_default_number_of_components(as_rows):
    m = np.random.default_rng(8).normal(size=(30, 1600))
    m[3, 5] = np.nan
    fit = op.ppca_missing_fit(as_rows(m), max_iter=1, d=1600)
    assert fit.model.k == 320 and np.isfinite(fit.model.loadings).all()


def test_missing_fit_on_complete_rows_is_ppca(as_rows):
    m = low_rank(200, 6)
    fit = op.ppca_missing_fit(as_rows(m), 2, tol=1e-12, max_iter=60).model
    plain = op.ppca_fit(op.zscore_rows(as_rows(m)), 2, max_iter=3000, tol=1e-13, error_rate=0)
    assert angle(fit.loadings, plain.loadings) < 0.02
    z = (m - m.mean(axis=0)) / m.std(axis=0)
    c0 = np.random.default_rng(0).random((6, 2))
    one = op.ppca_missing_fit(as_rows(m), 2, tol=0, max_iter=2, init=Start(c0)).model
    x = z @ c0 @ np.linalg.inv(c0.T @ c0)
    c, ss, _ = ppca_numpy(z, c0, np.mean((x @ c0.T - z) ** 2), 2)
    assert np.allclose(one.loadings, c) and np.isclose(one.noise[0], ss)


def test_all_components_leave_no_noise(as_rows):
    m = low_rank(200, 4)
    model = op.ppca_missing_fit(as_rows(m), 4).model
    values = np.linalg.eigvalsh(np.cov(((m - m.mean(0)) / m.std(0)).T))[::-1]
    assert np.allclose(model.eigenvalues, values, rtol=1e-8)
    assert len(model.history) >= 7


def test_missing_fit_drops_columns_and_defaults(as_rows):
    m = low_rank(80, 10)
    m[5:, 3] = np.nan
    m[0, 0] = np.inf
    fit = op.ppca_missing_fit(as_rows(m), min_obs=20, max_iter=2)
    assert fit.model.columns == (0, 1, 2, 4, 5, 6, 7, 8, 9)
    assert fit.model.k == 2
    assert fit.model.transform(as_rows(m[:3]), "centered").count() == 3


@pytest.mark.parametrize("kind", ["ppca", "missing"])
def test_save_and_load(spark, as_rows, tmp_path, kind):
    m = low_rank(100, 5)
    if kind == "ppca":
        model = op.ppca_fit(as_rows(m), 2, max_iter=5, canonical=True)
    else:
        model = op.ppca_missing_fit(as_rows(m), 2, max_iter=3).model
    model.save(spark, str(tmp_path / "m"))
    back = op.FactorModel.load(spark, str(tmp_path / "m"))
    for name in ("loadings", "mean", "noise", "axes", "eigenvalues", "var_exp", "scale"):
        a, b = getattr(model, name), getattr(back, name)
        assert (a is None and b is None) or np.array_equal(a, b)
    assert back.history == tuple(model.history) and back.kind == model.kind and back.n_rows == 100


def test_transform_modes(as_rows):
    m = low_rank(50, 5)
    model = op.ppca_fit(as_rows(m), 2, max_iter=20, error_rate=0)
    get = lambda mode: np.array([r.x for r in model.transform(as_rows(m), mode).orderBy("row_id").collect()])
    z, c = m - m.mean(axis=0), model.loadings
    assert np.allclose(get("raw"), m @ c)
    assert np.allclose(get("centered"), z @ c)
    assert np.allclose(get("posterior"), z @ c @ np.linalg.inv(c.T @ c + model.noise[0] * np.eye(2)))
    with pytest.raises(ValueError):
        model.transform(as_rows(m), "other")


def test_projection_accepts_a_stream(spark, as_rows, tmp_path):
    m = low_rank(40, 30)
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    as_rows(m).write.parquet(rows)
    model = op.ppca_fit(as_rows(m), 2, max_iter=2, error_rate=0)
    stream = spark.readStream.schema("row_id BIGINT, y ARRAY<DOUBLE>").parquet(rows)
    writer = model.transform(stream, "centered").writeStream.format("parquet").trigger(availableNow=True)
    run = writer.option("checkpointLocation", str(tmp_path / "state")).start(out)
    run.awaitTermination(120)
    got = [r.x for r in spark.read.parquet(out).orderBy("row_id").collect()]
    assert np.allclose(got, (m - m.mean(axis=0)) @ model.loadings)


def test_result_does_not_depend_on_partitioning(as_rows):
    m = low_rank(90, 40)
    fits = [op.ppca_fit(as_rows(m, parts), 3, max_iter=5, plan="rows", error_rate=0) for parts in (1, 5, 64)]
    for f in fits[1:]:
        assert np.allclose(f.loadings, fits[0].loadings, rtol=1e-9)


def test_missing_values_are_refused_by_plain_fits(as_rows):
    m = low_rank(30, 5)
    m[2, 2] = np.nan
    for plan in ("gram", "rows"):
        with pytest.raises(ValueError, match="missing"):
            op.ppca_fit(as_rows(m), 2, plan=plan)


def test_stop_rules():
    stop = StopRule(5, tol=0.1, relative=True)
    assert [stop.record(v) for v in (10.0, 5.0, 4.9)] == [False, False, True]
    gain = StopRule(None, tol=1.0, relative=False)
    assert [gain.record(v) for v in (-100.0, -50.0, -49.5)] == [False, False, True]
    late = StopRule(None, tol=0.5, relative=True, min_rounds=6)
    assert [late.record(1.0) for _ in range(7)] == [False] * 6 + [True]
    assert StopRule(1).record(3.0)
    assert StopRule(9, error_tol=0.02).record(1.0, 0.01)
    with pytest.raises(ArithmeticError):
        StopRule(3).record(float("nan"))


def test_start_values():
    from axisloom.operators.model import start_values

    a, b = start_values(4, 2, 0, False), start_values(4, 2, None, False)
    assert np.array_equal(a[0], b[0]) and 0 <= a[1] < 1 and a[0].min() >= 0 and a[0].max() < 1
    assert not np.array_equal(a[0], start_values(4, 2, 1, False)[0])
    assert start_values(4, 2, 0, True)[1].shape == (4,)
    with pytest.raises(ValueError):
        start_values(4, 2, Start(np.ones((3, 2))), False)


@pytest.mark.parametrize("kind", ["ppca", "fa"])
def test_model_as_a_table_gives_the_same_fit(spark, as_rows, kind):
    m = np.where(np.random.default_rng(3).random((60, 6)) < 0.5, low_rank(60, 6), 0.0)
    c0 = np.random.default_rng(4).random((6, 2))
    psi0 = np.full(6, 0.7)
    cells = op.nonzero_cells(op.cells_of(as_rows(m)))
    begin = spark.createDataFrame(
        [(j, c0[j].tolist(), 0.7) for j in range(6)], "col_id INT, c ARRAY<DOUBLE>, noise DOUBLE"
    )
    got = op.fit_cells(cells, 2, 60, 6, kind=kind, max_iter=3, tol=-1e9, start=begin)
    fit = op.ppca_fit if kind == "ppca" else op.fa_fit
    noise = 0.7 if kind == "ppca" else psi0
    want = fit(as_rows(m), 2, max_iter=3, tol=-1e9, error_rate=0, init=Start(c0, noise))
    rows = got.components().orderBy("col_id").collect()
    assert np.allclose([r.loadings for r in rows], want.loadings, rtol=1e-8)
    assert np.allclose([r.noise for r in rows], want.noise, rtol=1e-8)
    assert np.allclose([h[1] for h in got.history], [h[1] for h in want.history])
    x = np.array([r.x for r in got.transform(cells).orderBy("row_id").collect()])
    assert np.allclose(x, m @ want.loadings)
    drawn = op.fit_cells(cells, 2, 60, 6, kind=kind, max_iter=1)
    assert drawn.table.count() == 6
