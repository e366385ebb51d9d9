"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from axisloom import operators as op
from axisloom.catalog import QUERIES
from axisloom.catalog import register as r
from axisloom.session import local_session, stored

HEADLINE = [
    "covariance_matrix",
    "covariance_wide",
    "column_means",
    "zscore",
    "row_residuals",
    "project_rows",
    "cross_moments",
    "l1_error_ratio",
    "coo_to_rows",
    "read_dense",
    "read_coo",
    "read_trials",
    "trial_mean_removed",
    "trials_to_matrix",
    "array_sum_by_label",
    "lagged_covariance",
    "lagged_covariance_filled",
    "frobenius_norm_cells",
    "ppca_fit_sparse",
    "ppca_missing_fit_k1",
    "ppca_missing_fit_k2",
    "ppca_fit_cells_k1",
    "fa_fit_cells",
    "model_comparison",
    "lagged_covariance_users",
    "classifier_accuracy",
    "classifier_confusion",
    "job_run",
    "covariance_cells",
    "canonical_rotation_cells",
    "fourier_features",
    "group_covariances",
    "lagged_covariance_long",
]


def shape(spark, n: int, d: int, rank: int):
    """Rows of a promised shape, derived from the keys of a range: rank waves plus a ripple."""
    i = F.col("id")
    waves = F.array(*[F.sin(i * (0.37 + 0.11 * k)) * (rank - k) for k in range(rank)])
    add = lambda s, x: s + x
    cell = lambda j: F.aggregate(F.transform(waves, lambda w, k: w * F.cos(j * (k + 1))), 0.1 * F.cos(i * (1.7 + j)), add)
    return spark.range(n).select(i.alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), cell).alias("y"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fits(spark, sf) -> dict:
    """Fits with a fixed number of rounds: name -> (function, rounds)."""
    emb, items = r.embeddings(spark, sf), op.zscore_rows(r.lineitem(spark, sf))
    users = r.weekday_hours(spark, sf)
    exact = dict(tol=0.0, error_tol=-1.0)
    tall, _ = stored(shape(spark, 10_000, 80, 20), "tall")
    small, _ = stored(shape(spark, 1_000, 10, 3), "small")
    # hours of all users as cells, many components: the model as a table
    cells, n_users = op.cells_of(users).filter("value <> 0"), users.count()
    return {
        "ppca_cells_k40": (lambda: op.fit_cells(cells, 40, n_users, 168, max_iter=3, tol=0.0).close(), 3),
        "ppca_embeddings_k3": (lambda: op.ppca_fit(emb, 3, max_iter=20, d=64, **exact), 20),
        "ppca_embeddings_k10": (lambda: op.ppca_fit(emb, 10, max_iter=20, d=64, **exact), 20),
        "ppca_embeddings_k10_rows": (
            lambda: op.ppca_fit(emb, 10, max_iter=10, d=64, plan="rows", **exact), 10),
        "ppca_lineitem_k2": (lambda: op.ppca_fit(items, 2, max_iter=20, d=4, **exact), 20),
        "ppca_user_hours_k30": (lambda: op.ppca_fit(users, 30, max_iter=200, d=168, persist=True, **exact), 200),
        "ppca_10000x80_k30": (lambda: op.ppca_fit(tall, 30, max_iter=200, d=80, **exact), 200),
        "fa_1000x10_k3": (lambda: op.fa_fit(small, 3, max_iter=200, d=10, tol=float("-inf")), 200),
        "fa_embeddings_k3": (lambda: op.fa_fit(emb, 3, max_iter=200, d=64, tol=float("-inf")), 200),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "axisloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["array_sum_by_label"](spark, sf))  # starts executors
    run(QUERIES["row_residuals"](spark, sf))  # and Python workers
    times, per_round = {}, {}
    for name in HEADLINE:
        begin = time.perf_counter()
        run(QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - begin, 3)
    for name, (fit, rounds) in fits(spark, sf).items():
        begin = time.perf_counter()
        fit()
        times[name] = round(time.perf_counter() - begin, 3)
        per_round[name] = round(times[name] / rounds, 4)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sec_per_round": per_round,
                "sf": sf.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
