"""Row-level transforms and filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import operators as op
from ..plans.moments import column_stats
from ..sources import rows_from_columns
from . import register as r
from .register import query

MEANS = ", ".join(f"avg(y{j}) AS m{j}, stddev_pop(y{j}) AS s{j}, var_pop(y{j}) AS v{j}" for j in range(4))
STATS = f"stats AS (SELECT count(*) AS n, {MEANS} FROM lineitem4), joined AS (SELECT * FROM lineitem4, stats)"


def lineitem_sql(value: str, base: str = r.LINEITEM, digits: int = 6) -> str:
    return f"""
WITH {base}, {STATS}
SELECT row_id, col_id, round(value, {digits}) + 0.0 AS value FROM ({r.unpivot('joined', 4, value)})"""


@query("nonzero_filter", f"""
SELECT event_id AS row_id, {r.TYPE_NUMBER} AS col_id, value FROM events
WHERE value <> 0 AND {r.TYPE_NUMBER} < {len(r.TYPES) - 1}""")
def nonzero(spark, sf):
    cells = r.table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), r.type_number().alias("col_id"), "value"
    )
    return op.nonzero_cells(cells, len(r.TYPES) - 1)


@query("first_cells", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100")
def first_cells(spark, sf):
    return op.first_rows(r.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), 100, "c_custkey")


@query("center_rows", lineitem_sql("y{j} - m{j}"))
def centered(spark, sf):
    return r.cells(op.center_rows(r.lineitem(spark, sf)))


@query("center_nonzero", f"""
WITH {r.EVENT_SUMS}, n AS (SELECT count(DISTINCT row_id) AS n FROM sums),
means AS (SELECT col_id, sum(value) / max(n) AS m FROM sums, n GROUP BY col_id)
SELECT row_id, col_id, round(value - m, 6) + 0.0 AS value FROM sums JOIN means USING (col_id) WHERE value <> 0""")
def centered_cells(spark, sf):
    cells = r.event_sums(spark, sf)
    n = cells.select("row_id").distinct().count()
    out = op.center_nonzero(op.nonzero_cells(cells), n)
    return out.withColumn("value", r.rounded(F.col("value")))


@query("zscore", lineitem_sql("(y{j} - m{j}) / s{j}"))
def zscore(spark, sf):
    return r.cells(op.zscore_rows(r.lineitem(spark, sf)))


@query("var_normalize", lineitem_sql("(y{j} - m{j}) / v{j} / n", digits=12))
def var_normalized(spark, sf):
    return r.cells(op.variance_normalize(r.lineitem(spark, sf)), digits=12)


@query("latent_scores", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}
SELECT row_id, comp AS col_id, round(sum(v * w), 6) + 0.0 AS value
FROM cell JOIN fixed USING (col_id) GROUP BY row_id, comp""")
def scores(spark, sf):
    return r.cells(op.latent_scores(r.embeddings(spark, sf), r.fixed_map()), "x")


CENTERED_CELLS = """means AS (SELECT col_id, avg(v) AS m FROM cell GROUP BY col_id),
z AS (SELECT row_id, col_id, v - m AS z FROM cell JOIN means USING (col_id)),
x AS (SELECT row_id, comp, sum(z * w) AS x FROM z JOIN fixed USING (col_id) GROUP BY row_id, comp)"""

RESIDUALS = f"""{CENTERED_CELLS},
recon AS (SELECT row_id, col_id, sum(x * c) AS y FROM x JOIN fixed USING (comp) GROUP BY row_id, col_id),
residual AS (SELECT row_id, col_id, y - z AS e, z FROM recon JOIN z USING (row_id, col_id))"""


@query("row_residuals", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}, {RESIDUALS}
SELECT row_id, col_id, round(e, 6) + 0.0 AS value FROM residual""")
def residuals(spark, sf):
    df = r.embeddings(spark, sf)
    mean = column_stats(df, r.WIDTH).mean
    return r.cells(op.row_residuals(df, r.fixed_map(), r.fixed_loadings(), mean), "residual")


SAMPLE_BOUND = f"{int(0.1 * 2**32):08x}"


@query("sample_rows", f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE substr(md5(o_orderkey || ':7'), 1, 8) < '{SAMPLE_BOUND}'""")
def sampled(spark, sf):
    orders = r.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return op.sample_rows(orders, 0.1, seed=7, key="o_orderkey")


@query("inf_clip", """
WITH m AS (SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 'Infinity'::DOUBLE
                  WHEN event_type = 'signup' THEN '-Infinity'::DOUBLE ELSE value END AS y0, value / 2 AS y1 FROM events),
top AS (SELECT max(greatest(CASE WHEN isinf(y0) THEN NULL ELSE y0 END, y1)) AS top FROM m)
SELECT row_id, 0 AS col_id, CASE WHEN isinf(y0) THEN top ELSE y0 END AS value FROM m, top
UNION ALL SELECT row_id, 1, y1 FROM m""")
def clipped(spark, sf):
    inf = F.lit(float("inf"))
    y0 = F.when(F.col("event_type") == "error", inf).when(F.col("event_type") == "signup", -inf)
    events = r.table(spark, sf, "events")
    df = op.clip_infinite(rows_from_columns(events, [y0.otherwise(F.col("value")), F.col("value") / 2], "event_id"))
    return df.select("row_id", F.posexplode("y").alias("col_id", "value"))


@query("min_obs_columns", f"""
WITH {r.LINEITEM_GAPS}, cell AS ({r.unpivot('lineitem4')}),
counted AS (SELECT *, count(value) OVER (PARTITION BY col_id) AS c, count(*) OVER (PARTITION BY col_id) AS n FROM cell)
SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM counted WHERE c >= 0.945 * n""")
def observed_columns(spark, sf):
    df = r.lineitem_gaps(spark, sf)
    stats = column_stats(df)
    kept_rows, kept = op.keep_observed_columns(df, 0.945 * stats.n_rows, stats)
    number = F.expr("array(" + ",".join(map(str, kept)) + ")")
    cells = r.cells(kept_rows)
    return cells.withColumn("col_id", F.get(number, F.col("col_id")))


@query("min_obs_cells", f"""
WITH {r.EVENT_SUMS}, kept AS (
  SELECT col_id FROM sums GROUP BY col_id HAVING count(value) >= 0.999 * (SELECT count(DISTINCT row_id) FROM sums))
SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM sums WHERE col_id IN (SELECT col_id FROM kept)""")
def observed_cells(spark, sf):
    cells = r.event_sums(spark, sf)
    n = cells.select("row_id").distinct().count()
    return op.min_obs_cells(cells, 0.999 * n).select("row_id", "col_id", r.rounded(F.col("value")).alias("value"))


@query("mask_fill", lineitem_sql("coalesce((y{j} - m{j}) / s{j}, 0)", r.LINEITEM_GAPS))
def filled(spark, sf):
    return r.cells(op.fill_missing(op.zscore_rows(r.lineitem_gaps(spark, sf))))


@query("missing_per_row", f"""
WITH {r.LINEITEM_GAPS}
SELECT CAST((y2 IS NULL)::INT + (y3 IS NULL)::INT AS INTEGER) AS n_missing, count(*) AS n_rows
FROM lineitem4 GROUP BY 1""")
def missing_per_row(spark, sf):
    return op.fill_missing(r.lineitem_gaps(spark, sf)).groupBy("n_missing").agg(F.count("*").alias("n_rows"))


@query("trials_to_matrix", f"""
WITH {r.TRIALS_SQL}, width AS (SELECT max(cell) AS top FROM trials), rows AS (
  SELECT DISTINCT CAST(trial * {r.TIMES} + t AS BIGINT) AS row_id FROM trials)
SELECT row_id, CAST(c.j AS INTEGER) AS col_id, round(coalesce(value, 0), 6) + 0.0 AS value
FROM rows CROSS JOIN (SELECT unnest(range(0, top + 1)) AS j FROM width) c
LEFT JOIN trials ON cell = c.j AND trial * {r.TIMES} + t = row_id""")
def trial_matrix(spark, sf):
    trials = r.trials(spark, sf)
    top = trials.agg(F.max("cell")).first()[0]
    return r.cells(op.trials_to_matrix(trials, top + 1, r.TIMES))


@query("trials_to_cells", f"""
WITH {r.TRIALS_SQL}
SELECT CAST(trial * {r.TIMES} + t AS BIGINT) AS row_id, cell AS col_id, round(value, 6) + 0.0 AS value FROM trials""")
def trial_cells(spark, sf):
    """The long form, which has no row that grows with the number of cells."""
    return op.trials_to_cells(r.trials(spark, sf), r.TIMES).withColumn("value", r.rounded(F.col("value")))


@query("project_rows", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}, means AS (SELECT col_id, avg(v) AS m FROM cell GROUP BY col_id)
SELECT 'raw' AS mode, row_id, comp AS col_id, round(sum(v * c), 6) + 0.0 AS value
FROM cell JOIN fixed USING (col_id) GROUP BY row_id, comp
UNION ALL SELECT 'centered', row_id, comp, round(sum((v - m) * c), 6) + 0.0
FROM cell JOIN fixed USING (col_id) JOIN means USING (col_id) GROUP BY row_id, comp""")
def projected(spark, sf):
    df = r.embeddings(spark, sf)
    mean = column_stats(df, r.WIDTH).mean
    model = op.FactorModel("ppca", r.fixed_loadings(), mean, np.ones(r.WIDTH), 0)
    parts = [
        r.cells(model.transform(df, mode), "x").select(F.lit(mode).alias("mode"), "*")
        for mode in ("raw", "centered")
    ]
    return parts[0].unionAll(parts[1])


@query("project_rows_sparse", f"""
WITH {r.EVENT_COUNTS}, {r.FIXED}
SELECT row_id, comp AS col_id, round(sum(value * c), 6) + 0.0 AS value
FROM counts JOIN fixed USING (col_id) GROUP BY row_id, comp""")
def projected_sparse(spark, sf):
    d = len(r.TYPES)
    rows = op.coo_to_sparse(r.event_counts(spark, sf), d, unique=True)
    model = op.FactorModel("ppca", r.fixed_loadings(d), np.zeros(d), np.ones(d), 0)
    return r.cells(model.transform(rows), "x")


@query("latent_scores_cells", f"""
WITH {r.EVENT_SUMS}, {r.FIXED}
SELECT row_id, comp AS col_id, round(sum(value * w), 6) + 0.0 AS value
FROM sums JOIN fixed USING (col_id) GROUP BY row_id, comp""")
def scores_cells(spark, sf):
    d = len(r.TYPES)
    w = spark.createDataFrame([(j, row.tolist()) for j, row in enumerate(r.fixed_map(d))], "col_id INT, w ARRAY<DOUBLE>")
    return r.cells(op.latent_scores_cells(r.event_sums(spark, sf), w, r.COMPONENTS), "x")
