import itertools

import numpy as np
import pandas as pd
import pytest

from axisloom.operators import covariance_matrix, lagged_covariance
from axisloom.operators.lagged import fill_gaps, scatter_pairs


def brute(table, window):
    """pandas covariance of every shifted pair."""
    s = len(table)
    out = np.zeros((s, s))
    for i, j, lag in itertools.product(range(s), range(s), range(-window, window + 1)):
        a, b = pd.Series(table[i]), pd.Series(table[j]).shift(lag)
        c = a.cov(b)
        out[i, j] += 0 if np.isnan(c) else c
    return out


@pytest.mark.parametrize("tile,bucket", [(512, None), (3, 5), (2, 4), (4, 7)])
@pytest.mark.parametrize("gaps", [False, True])
def test_matches_shifted_series(spark, tile, bucket, gaps):
    rng = np.random.default_rng(3)
    table = rng.standard_normal((7, 60)).cumsum(axis=1) + 100
    if gaps:
        table[rng.random(table.shape) < 0.2] = np.nan
    rows = [(i, t - 11, float(v)) for i, row in enumerate(table) for t, v in enumerate(row) if v == v]
    cells = spark.createDataFrame(rows, "series INT, t BIGINT, value DOUBLE")
    out = lagged_covariance(cells, 4, 7, tile=tile, bucket=bucket).collect()
    got = np.zeros((7, 7))
    for r in out:
        got[r.s1, r.s2] = r.value
    assert len(out) == 49
    assert np.allclose(got, brute(table, 4), rtol=1e-9)


@pytest.mark.parametrize("tile,bucket", [(512, None), (3, 31)])
def test_long_windows_equal_shifted_series(spark, tile, bucket):
    """Transforms against every shifted pair, with gaps and negative times."""
    rng = np.random.default_rng(6)
    table = rng.standard_normal((5, 200)).cumsum(axis=1) + 50
    table[rng.random(table.shape) < 0.2] = np.nan
    rows = [(i, t - 77, float(v)) for i, row in enumerate(table) for t, v in enumerate(row) if v == v]
    cells = spark.createDataFrame(rows, "series INT, t BIGINT, value DOUBLE")
    got = np.zeros((5, 5))
    for r in lagged_covariance(cells, 30, 5, tile=tile, bucket=bucket).collect():
        got[r.s1, r.s2] = r.value
    assert np.allclose(got, brute(table, 30), rtol=1e-8)


def test_transforms_equal_products(spark, monkeypatch):
    """Window 500, in tiles that keep the sums as small as those of window 4."""
    from axisloom.operators import lagged

    rng = np.random.default_rng(2)
    rows = [(i, int(t), float(v)) for i in range(3) for t, v in enumerate(rng.standard_normal(1500).cumsum()) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "series INT, t BIGINT, value DOUBLE")
    got = {(r.s1, r.s2): r.value for r in lagged_covariance(cells, 500, 3).collect()}
    monkeypatch.setattr(lagged, "FFT_WINDOW", 10_000)
    want = {(r.s1, r.s2): r.value for r in lagged_covariance(cells, 500, 3).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-7) for k in want)
    tile = int(np.sqrt(lagged.SUMS / (4 * 501)))
    assert 4 * 501 * tile**2 <= lagged.SUMS


def test_gaps_can_be_filled(spark):
    cells = spark.createDataFrame([(0, 5, 1.0), (1, 8, 2.0)], "series INT, t BIGINT, value DOUBLE")
    got = {(r.series, r.t): r.value for r in fill_gaps(cells, 2).collect()}
    assert got == {(s, t): {(0, 5): 1.0, (1, 8): 2.0}.get((s, t), 0.0) for s in (0, 1) for t in range(5, 9)}


def test_covariance_plans_agree(spark, as_rows):
    m = np.random.default_rng(0).standard_normal((200, 20)) * np.arange(1, 21) + 1e4
    want = np.cov(m.T, ddof=0)
    for out in (covariance_matrix(as_rows(m)), scatter_pairs(as_rows(m), 20, tile=8)):
        got = np.zeros((20, 20))
        for r in out.collect():
            got[r.i, r.j] = r.value
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    narrow = {(r.i, r.j): r.value for r in covariance_matrix(as_rows(m[:, :3]), ddof=1).collect()}
    assert np.allclose([[narrow[i, j] for j in range(3)] for i in range(3)], np.cov(m[:, :3].T))
