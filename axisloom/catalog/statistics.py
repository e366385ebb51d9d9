"""Aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import operators as op
from ..operators.cells import column_means_cells
from ..operators.lagged import fill_gaps
from ..operators.rows import coo_to_sparse
from ..operators.stats import l1_ratio
from ..plans.moments import SparseMoments, column_stats
from . import register as r
from .register import query
from .rows import CENTERED_CELLS, RESIDUALS


def stats_sql(base: str) -> str:
    return f"""
WITH {base}, cell AS ({r.unpivot('lineitem4')})
SELECT col_id, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var_pop
FROM cell GROUP BY col_id"""


def rounded_stats(df):
    return df.select("col_id", "n", r.rounded(F.col("mean")).alias("mean"), r.rounded(F.col("var_pop")).alias("var_pop"))


@query("column_means", stats_sql(r.LINEITEM))
def column_means(spark, sf):
    return rounded_stats(op.column_means(r.lineitem(spark, sf)))


@query("null_aware_stats", stats_sql(r.LINEITEM_GAPS))
def null_aware(spark, sf):
    return rounded_stats(op.null_aware_stats(r.lineitem_gaps(spark, sf)))


@query("column_means_wide", f"""
WITH {r.EMBEDDINGS}
SELECT col_id, count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS var_pop
FROM cell GROUP BY col_id""")
def column_means_wide(spark, sf):
    return rounded_stats(op.column_means(r.embeddings(spark, sf), r.WIDTH))


@query("column_means_cells", f"""
WITH {r.EVENT_SUMS}, n AS (SELECT count(DISTINCT row_id) AS n FROM sums)
SELECT col_id, count(value) AS nnz, round(sum(value), 4) + 0.0 AS s, round(sum(value) / max(n), 6) + 0.0 AS mean
FROM sums, n GROUP BY col_id""")
def cell_means(spark, sf):
    cells = r.event_sums(spark, sf)
    n = cells.select("row_id").distinct().count()
    return column_means_cells(cells, n).select(
        "col_id", "nnz", r.rounded(F.col("s"), 4).alias("s"), r.rounded(F.col("mean")).alias("mean")
    )


@query("frobenius_norm", f"""
WITH {r.LINEITEM}, cell AS ({r.unpivot('lineitem4')})
SELECT round(sqrt(sum(q)), 6) AS norm FROM (SELECT var_pop(value) * count(*) AS q FROM cell GROUP BY col_id)""")
def frobenius(spark, sf):
    return r.one_row(spark, norm=np.sqrt(op.frobenius_norm2(r.lineitem(spark, sf))))


@query("frobenius_norm_cells", f"""
WITH {r.EVENT_SUMS}, {r.dense_sql('sums')}
SELECT round(sqrt(sum(q)), 6) AS norm FROM (SELECT var_pop(value) * count(*) AS q FROM dense GROUP BY col_id)""")
def frobenius_cells(spark, sf):
    cells = r.event_sums(spark, sf)
    n = cells.select("row_id").distinct().count()
    return op.frobenius_norm2_cells(cells, n).select(r.rounded(F.sqrt("norm2")).alias("norm"))


CROSS = """SELECT 'xtx' AS part, a.comp AS i, b.comp AS j, round(sum(a.x * b.x), 6) + 0.0 AS value
FROM x a JOIN x b USING (row_id) GROUP BY a.comp, b.comp
UNION ALL SELECT 'ytx', z.col_id, x.comp, round(sum(z * x), 6) + 0.0 FROM z JOIN x USING (row_id) GROUP BY z.col_id, x.comp"""


def cross_frame(spark, xtx, ytx):
    part = lambda name, m: r.matrix(spark, m).select(F.lit(name).alias("part"), "*")
    return part("xtx", xtx).unionAll(part("ytx", ytx))


@query("cross_moments", f"WITH {r.EMBEDDINGS}, {r.FIXED}, {CENTERED_CELLS} {CROSS}")
def cross(spark, sf):
    return cross_frame(spark, *op.cross_moments(r.embeddings(spark, sf), r.fixed_map(), "rows", r.WIDTH))


@query("cross_moments_gram", f"WITH {r.EMBEDDINGS}, {r.FIXED}, {CENTERED_CELLS} {CROSS}")
def cross_gram(spark, sf):
    return cross_frame(spark, *op.cross_moments(r.embeddings(spark, sf), r.fixed_map(), "gram", r.WIDTH))


@query("cross_moments_sparse", f"""
WITH {r.EVENT_COUNTS}, {r.dense_sql('counts')},
cell AS (SELECT row_id, col_id, value AS v FROM dense), {r.FIXED}, {CENTERED_CELLS} {CROSS}""")
def cross_sparse(spark, sf):
    d = len(r.TYPES)
    rows = coo_to_sparse(r.event_counts(spark, sf), d, unique=True)
    return cross_frame(spark, *SparseMoments(rows, d).moments(r.fixed_map(d)))


@query("variance_cross_term", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}, {CENTERED_CELLS},
yc AS (SELECT row_id, comp, sum(z * c) AS y FROM z JOIN fixed USING (col_id) GROUP BY row_id, comp)
SELECT round(sum(x * y), 6) AS value FROM x JOIN yc USING (row_id, comp)""")
def variance_term(spark, sf):
    return r.one_row(
        spark, value=op.variance_cross_term(r.embeddings(spark, sf), r.fixed_map(), r.fixed_loadings())
    )


@query("l1_error_ratio", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}, {RESIDUALS},
sums AS (SELECT col_id, sum(abs(e)) AS err, sum(abs(z)) AS norm FROM residual GROUP BY col_id)
SELECT round(max(err), 6) AS error_norm, round(max(norm), 6) AS input_norm,
       round(max(err) / max(norm), 6) AS ratio FROM sums""")
def l1_error(spark, sf):
    df = r.embeddings(spark, sf)
    err, norm = op.l1_error(df, r.fixed_map(), r.fixed_loadings(), column_stats(df, r.WIDTH).mean)
    return r.one_row(spark, error_norm=err.max(), input_norm=norm.max(), ratio=l1_ratio(err, norm))


@query("array_sum_by_label", """
WITH cell AS (SELECT label, unnest(range(0, len(embedding))) AS col_id, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(col_id AS INTEGER) AS col_id, round(sum(CAST(v AS DOUBLE)), 6) + 0.0 AS value
FROM cell GROUP BY label, col_id""")
def array_sums(spark, sf):
    sums = op.array_sum(r.table(spark, sf, "embeddings").select("label", "embedding"), "embedding", "label")
    long = sums.select("label", F.posexplode("total").alias("col_id", "value"))
    return long.select("label", "col_id", r.rounded(F.col("value")).alias("value"))


def covariance_sql(cells: str, value: str = "covar_pop(a.v, b.v)", digits: int = 6) -> str:
    return f"""
WITH {cells}
SELECT a.col_id AS i, b.col_id AS j, round({value}, {digits}) + 0.0 AS value
FROM cell a JOIN cell b USING (row_id) GROUP BY a.col_id, b.col_id"""


# lineitem has no row key, so its pairs come from the wide form
PAIRS = "\n UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, y{i} AS a, y{j} AS b FROM lineitem4" for i in range(4) for j in range(4)
)


@query("covariance_matrix", f"""
WITH {r.LINEITEM}, pair AS ({PAIRS})
SELECT i, j, round(covar_pop(a, b), 6) + 0.0 AS value FROM pair GROUP BY i, j""")
def covariance(spark, sf):
    out = op.covariance_matrix(r.lineitem(spark, sf))
    return out.withColumn("value", r.rounded(F.col("value")))


@query("covariance_wide", covariance_sql(r.EMBEDDINGS))
def covariance_wide(spark, sf):
    out = op.covariance_matrix(r.embeddings(spark, sf), r.WIDTH)
    return out.withColumn("value", r.rounded(F.col("value")))


@query("covariance_tiles", covariance_sql(r.EMBEDDINGS))
def covariance_tiles(spark, sf):
    """The plan for very wide rows, on tiles of 24 columns."""
    from ..operators.lagged import scatter_pairs

    out = scatter_pairs(r.embeddings(spark, sf), r.WIDTH, 0, tile=24)
    return out.withColumn("value", r.rounded(F.col("value")))


@query("normalized_scatter", f"""
WITH {r.LINEITEM}, pair AS ({PAIRS})
SELECT i, j, round(covar_pop(a, b) / var_pop(a) / var_pop(b) / count(*), 12) + 0.0 AS value FROM pair GROUP BY i, j""")
def scatter(spark, sf):
    return r.matrix(spark, op.normalized_scatter(r.lineitem(spark, sf)), 12)


@query("trial_mean_removed", f"""
WITH {r.TRIALS_SQL}, m AS (SELECT cell, t, avg(value) AS m FROM trials GROUP BY cell, t)
SELECT cell, trial, t, round(value - m, 6) + 0.0 AS value FROM trials JOIN m USING (cell, t)""")
def trial_mean_removed(spark, sf):
    out = op.remove_trial_mean(r.trials(spark, sf))
    return out.withColumn("value", r.rounded(F.col("value")))


LAGGED = """per_lag AS (
  SELECT a.series AS s1, b.series AS s2, lag, covar_samp(a.value, b.value) AS c
  FROM {source} a CROSS JOIN range(-4, 5) l(lag) JOIN {source} b ON b.t = a.t - lag GROUP BY 1, 2, 3)
SELECT s1, s2, round(sum(c), 4) + 0.0 AS value FROM per_lag GROUP BY s1, s2"""


@query("lagged_covariance", f"WITH {r.HOURLY}, {LAGGED.format(source='hourly')}")
def lagged(spark, sf):
    out = op.lagged_covariance(r.hourly(spark, sf), 4, len(r.TYPES))
    return out.withColumn("value", r.rounded(F.col("value"), 4))


@query("lagged_covariance_filled", f"""
WITH {r.HOURLY}, ends AS (SELECT min(t) AS lo, max(t) AS hi FROM hourly), filled AS (
  SELECT CAST(s.i AS INTEGER) AS series, g.t, coalesce(value, 0) AS value
  FROM (SELECT unnest(range(lo, hi + 1)) AS t FROM ends) g CROSS JOIN range({len(r.TYPES)}) s(i)
  LEFT JOIN hourly h ON h.t = g.t AND h.series = s.i),
{LAGGED.format(source='filled')}""")
def lagged_filled(spark, sf):
    series = fill_gaps(r.hourly(spark, sf), len(r.TYPES))
    out = op.lagged_covariance(series, 4, len(r.TYPES))
    return out.withColumn("value", r.rounded(F.col("value"), 4))


@query("lagged_covariance_long", f"WITH {r.HOURLY}, {LAGGED.format(source='hourly').replace('range(-4, 5)', 'range(-48, 49)').replace('sum(c), 4', 'sum(c), 2')}")
def lagged_long(spark, sf):
    """Two days each way: all lags from transforms."""
    out = op.lagged_covariance(r.hourly(spark, sf), 48, len(r.TYPES))
    return out.withColumn("value", r.rounded(F.col("value"), 2))


COHORTS = 200


@query("lagged_covariance_users", f"""
WITH daily AS (
  SELECT CAST(user_id % {COHORTS} AS INTEGER) AS series, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t,
         sum(value) / 24 AS value FROM events GROUP BY 1, 2),
per_lag AS (
  SELECT a.series AS s1, b.series AS s2, lag, covar_samp(a.value, b.value) AS c
  FROM daily a CROSS JOIN range(-1, 2) l(lag) JOIN daily b ON b.t = a.t - lag GROUP BY 1, 2, 3)
SELECT s1, s2, round(sum(c), 3) + 0.0 AS value FROM per_lag GROUP BY s1, s2""")
def lagged_users(spark, sf):
    """Many series: users by day, in a fixed number of cohorts, as pairs grow with its square."""
    daily = (
        r.table(spark, sf, "events")
        .groupBy(
            (F.col("user_id") % COHORTS).cast("int").alias("series"),
            F.expr("cast(date_diff(to_date(ts), date'1970-01-01') AS bigint)").alias("t"),
        )
        .agg((F.sum("value") / 24).alias("value"))
    )
    seen = daily.select("series").distinct()
    out = op.lagged_covariance(daily, 1, COHORTS)
    for side in ("s1", "s2"):
        out = out.join(seen.withColumnRenamed("series", side), side, "left_semi")
    return out.withColumn("value", r.rounded(F.col("value"), 3))


@query("score_summary", """
SELECT event_type AS method, CAST(isodow(ts) - 1 AS INTEGER) AS grp, count(value) AS n, round(avg(value), 6) + 0.0 AS mean,
       round(stddev_pop(value), 6) + 0.0 AS sd FROM events GROUP BY 1, 2""")
def summary(spark, sf):
    scores = r.table(spark, sf, "events").select(
        F.col("event_type").alias("method"), F.expr("weekday(to_date(ts))").alias("grp"), "value"
    )
    out = op.score_summary(scores, "value", "method", "grp")
    return out.select("method", "grp", "n", r.rounded(F.col("mean")).alias("mean"), r.rounded(F.col("sd")).alias("sd"))
