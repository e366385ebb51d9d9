import numpy as np
import pytest

from axisloom.operators import center_nonzero, coo_to_rows, min_obs_cells
from axisloom.operators.cells import column_means_cells, remove_trial_mean
from axisloom.plans import joins


def hot_cells(spark):
    """One column holds most of the cells."""
    rng = np.random.default_rng(0)
    rows = [(i, 0 if i % 3 else int(rng.integers(1, 5)), float(v)) for i, v in enumerate(rng.standard_normal(300))]
    return rows, spark.createDataFrame(rows, "row_id BIGINT, col_id INT, value DOUBLE")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_broadcast_and_salted_joins_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", limit)
    rows, cells = hot_cells(spark)
    means = column_means_cells(cells, 300).select("col_id", "mean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.join_lookup(cells, means, ["col_id"])
        assert ("Broadcast" in df._jdf.queryExecution().executedPlan().toString()) == bool(limit)
        got = {(r.row_id, r.col_id): r["mean"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    known = {r.col_id: r["mean"] for r in means.collect()}
    assert got == {(i, c): known[c] for i, c, _ in rows}


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_lookups_run_nothing_while_being_defined(spark, threshold):
    rows, cells = hot_cells(spark)
    means = {r.col_id: r["mean"] for r in column_means_cells(cells, 300).collect()}
    trials = cells.selectExpr("cast(row_id % 5 as int) AS cell", "cast(row_id as int) AS trial", "col_id AS t", "value")
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sparkContext.setJobGroup(f"define{threshold}", "define")
    try:
        df, kept, rest = center_nonzero(cells, 300), min_obs_cells(cells, 50), remove_trial_mean(trials)
        assert not tracker.getJobIdsForGroup(f"define{threshold}")
        got = sorted((r.row_id, r.col_id, r.value) for r in df.collect())
        assert {r.col_id for r in kept.collect()} == {0} and kept.count() == 200
        assert abs(sum(r.value for r in rest.collect())) < 1e-9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose([g[2] for g in got], [v - means[c] for _, c, v in sorted(rows)])


def test_repeated_cells_raise_when_announced_as_unique(spark):
    cells = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "row_id BIGINT, col_id INT, value DOUBLE")
    with pytest.raises(Exception, match="repeated cell"):
        coo_to_rows(cells, 3, unique=True).collect()
