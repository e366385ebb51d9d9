"""The fit with the model as a table, also with many components."""

import time

import numpy as np
import pytest
from fixtures import low_rank

from axisloom import operators as op


def cells_of(spark, m):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1]) if m[i, j]]
    return spark.createDataFrame(rows, "row_id BIGINT, col_id INT, value DOUBLE")


@pytest.mark.parametrize("kind", ["ppca", "fa"])
def test_equals_the_array_fit(spark, as_rows, kind):
    m = np.round(low_rank(60, 8), 3)
    c = np.random.default_rng(1).random((8, 3))
    start = spark.createDataFrame([(j, r.tolist(), 0.5) for j, r in enumerate(c)], "col_id INT, c ARRAY<DOUBLE>, noise DOUBLE")
    tol = 0 if kind == "ppca" else -np.inf
    got = op.fit_cells(cells_of(spark, m), 3, 60, 8, kind=kind, max_iter=3, tol=tol, start=start)
    init = op.model.Start(c, 0.5 if kind == "ppca" else np.full(8, 0.5))
    fit = op.ppca_fit if kind == "ppca" else op.fa_fit
    want = fit(as_rows(m), 3, max_iter=3, tol=tol, error_rate=0, init=init, d=8)
    table = got.components().orderBy("col_id").collect()
    assert np.allclose([r.loadings for r in table], want.loadings) and np.allclose([r.noise for r in table], want.noise)
    assert np.allclose([h[1] for h in got.history], [h[1] for h in want.history])
    got.close()


def test_many_components_are_quick(spark):
    m = np.random.default_rng(0).normal(size=(30, 50))
    begin = time.time()
    model = op.fit_cells(cells_of(spark, m), 40, 30, 50, max_iter=1)
    assert model.components().count() == 50 and time.time() - begin < 60
    model.close()


def test_a_column_without_start_values_raises(spark):
    m = np.ones((4, 3))
    start = spark.createDataFrame([(0, [1.0], 0.5)], "col_id INT, c ARRAY<DOUBLE>, noise DOUBLE")
    with pytest.raises(Exception, match="no start values"):
        op.fit_cells(cells_of(spark, m), 1, 4, 3, start=start)


def random_cells(spark, n_rows, n_cols, nnz, seed=0):
    """Distinct random cells made by the engine, some columns far more frequent than others."""
    from pyspark.sql import functions as F

    cells = spark.range(nnz).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_rows)).alias("row_id"),
        F.floor(F.pow(F.rand(seed), 3) * n_cols).cast("int").alias("col_id"),
        F.rand(seed + 1).alias("value"),
    )
    return cells.dropDuplicates(["row_id", "col_id"])


def exchanges_above(plan: str, column: str) -> list[str]:
    """Shuffles between a scan of the column and the operator that multiplies."""
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.splitlines() if x.strip()]
    found = []
    for i, (depth, line) in enumerate(lines):
        if "Scan" in line and column in line:
            for up, above in reversed(lines[:i]):
                if up < depth:
                    depth = up
                    if "CoGroups" in above:
                        break
                    if "Exchange" in above:
                        found.append(above)
    return found


@pytest.mark.parametrize("bundle_bytes", [48 << 20, 1 << 12])
def test_blocks_equal_the_joins(spark, bundle_bytes):
    """Also with tiny bundles, where most rows are too long for one."""
    from pyspark.sql import functions as F

    from axisloom.operators.cells_fit import uniform_start
    from axisloom.plans.cell_blocks import CellBlocks

    cells = random_cells(spark, 60, 200, 3000)
    k = 11
    w = spark.range(205).select(F.col("id").cast("int").alias("col_id")).withColumn("w", uniform_start(k, 3)).filter("col_id <> 7")
    blocks = CellBlocks(cells.withColumn("other", F.lit(1)), k, bundle_bytes)
    assert (blocks.long is None) == (bundle_bytes > 1 << 20)
    got = {r.col_id: r.ytx for r in blocks.moments(w).collect()}
    want = {r.col_id: r.ytx for r in op.cross_moments_cells(cells, w, k).collect()}
    want.pop(7, None)
    got.pop(7, None)
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)
    blocks.close()
    empty = CellBlocks(cells.filter("value > 2"), k)
    assert empty.moments(w).count() == 0
    empty.close()


def test_a_round_moves_no_cell(spark):
    from pyspark.sql import functions as F

    from axisloom.operators.cells_fit import uniform_start
    from axisloom.plans.cell_blocks import CellBlocks
    from axisloom.session import stored

    blocks = CellBlocks(random_cells(spark, 500, 300, 20_000), 12, 1 << 16)
    w, _ = stored(spark.range(300).select(F.col("id").cast("int").alias("col_id")).withColumn("w", uniform_start(12, 3)), "weights")
    plan = blocks.moments(w)._jdf.queryExecution().executedPlan().toString()
    assert "vals" in plan and not exchanges_above(plan, "vals")
    assert exchanges_above(plan, "w#")  # the model does move
    blocks.close()


def test_hundred_components_on_a_million_cells(spark):
    cells = random_cells(spark, 50_000, 20_000, 1_000_000)
    begin = time.time()
    model = op.fit_cells(cells, 100, 50_000, 20_000, max_iter=1)
    assert model.components().count() > 10_000 and np.isfinite(model.history[-1][1])
    assert time.time() - begin < 300
    model.close()


def test_sums_of_lists(spark):
    from pyspark.sql import functions as F

    from axisloom.plans.cell_blocks import sum_lists

    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r.k: r.v for r in sum_lists(rows, "k", "v", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(1000):
        s = want.setdefault(i % 7 * (i % 3), [0.0, 0.0])
        s[0] += i
        s[1] += 1
    assert got == want


def test_tall_decomposition(spark):
    from axisloom.plans import tall

    rng = np.random.default_rng(3)
    c = rng.standard_normal((400, 4)) @ np.diag([1e6, 1, 1e-3, 1e-6])
    c = np.column_stack((c, c[:, 0] - c[:, 1]))  # one column too many
    table = spark.createDataFrame([(j, r.tolist()) for j, r in enumerate(c)], "col_id INT, c ARRAY<DOUBLE>").repartition(40)
    r = tall.tall_triangle(table, "c", 5, fan=3)
    assert np.allclose(r.T @ r, c.T @ c)
    m = tall.orthonormal_map(table, "c", 5)
    q = c @ m
    assert m.shape == (5, 4) and np.allclose(q.T @ q, np.eye(4), atol=1e-9)
    nothing = table.filter("col_id < 0")
    assert tall.orthonormal_map(nothing, "c", 5).shape == (5, 0)


def test_canonical_axes_and_round_trip(spark, as_rows, tmp_path):
    m = np.round(low_rank(80, 9), 3)
    m[:, 4] = 0.0  # a column without cells
    cells = cells_of(spark, m)
    model = op.fit_cells(cells, 3, 80, 9, max_iter=4, tol=0, canonical=True)
    rows = as_rows(m)
    plain = op.FactorModel("ppca", np.array([r.loadings for r in model.components().orderBy("col_id").collect()]), m.mean(axis=0), np.ones(8), 80)
    keep = [j for j in range(9) if j != 4]
    want = op.canonical_rotation(as_rows(m[:, keep]), plain)
    axes = np.array([r.axis for r in model.components().orderBy("col_id").collect()])
    assert np.allclose(axes, want.axes) and np.allclose(model.eigenvalues, want.eigenvalues) and np.allclose(model.var_exp, want.var_exp)
    model.save(str(tmp_path / "m"))
    again = op.CellModel.load(spark, str(tmp_path / "m"))
    assert again.eigenvalues == model.eigenvalues and again.var_exp == model.var_exp and again.history == model.history
    for mode in ("raw", "centered"):
        got = {r.row_id: r.x for r in again.transform(cells, mode).collect()}
        x = (m if mode == "raw" else m - m.mean(axis=0))[:, keep] @ want.axes
        assert all(np.allclose(got[i], x[i]) for i in range(80))
    noise = again.components().first().noise
    c = np.array([r.loadings for r in again.components().orderBy("col_id").collect()])
    x = (m - m.mean(axis=0))[:, keep] @ c @ np.linalg.inv(c.T @ c + noise * np.eye(3))
    got = {r.row_id: r.x for r in again.transform(cells, "posterior").collect()}
    assert all(np.allclose(got[i], x[i]) for i in range(80))
    assert again.loading_rows().count() == 8 and rows.count() == 80
    model.close()
