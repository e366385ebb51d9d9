"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rows import coo_to_rows
from ..session import scratch_path
from ..sinks.text import as_lines, write_matrix, write_projected
from ..sources import (
    convert_matrix,
    read_coo,
    read_dense,
    read_trials,
    read_vector_text,
    rows_from_vectors,
    scan_rows,
)
from . import register as r
from .register import query

DENSE_CELLS = "SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM dense"


@query("read_dense", f"""
WITH {r.EMBEDDINGS}, ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM embeddings)
SELECT line AS row_id, col_id, round(v, 6) + 0.0 AS value FROM cell JOIN ranked ON vec_id = row_id""")
def dense_text(spark, sf):
    path = scratch_path(spark, "dense")
    write_matrix(r.embeddings(spark, sf), path, "DENSE")
    return r.cells(read_dense(spark, path))


@query("read_coo", f"WITH {r.EVENT_COUNTS} SELECT row_id, col_id, value FROM counts")
def coo_text(spark, sf):
    path = scratch_path(spark, "coo")
    one_based = r.event_counts(spark, sf).select(F.col("row_id") + 1, F.col("col_id") + 1, "value")
    one_based.write.csv(path)
    return read_coo(spark, path, base=1)


@query("coo_to_rows", f"WITH {r.EVENT_SUMS}, {r.dense_sql('sums')} {DENSE_CELLS}")
def coo_rows(spark, sf):
    events = r.table(spark, sf, "events").select(
        F.col("user_id").alias("row_id"), r.type_number().alias("col_id"), "value"
    )
    return r.cells(coo_to_rows(events, len(r.TYPES)))


@query("scan_rows", f"WITH {r.EMBEDDINGS} SELECT row_id, col_id, round(v, 6) + 0.0 AS value FROM cell")
def stored_rows(spark, sf):
    path = scratch_path(spark, "rows")
    r.embeddings(spark, sf).write.parquet(path)
    return r.cells(scan_rows(spark, path, r.WIDTH))


@query("rows_from_columns", f"""
WITH {r.LINEITEM} SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM ({r.unpivot('lineitem4')})""")
def column_rows(spark, sf):
    return r.cells(r.lineitem(spark, sf))


@query("rows_from_vectors", f"WITH {r.EMBEDDINGS} SELECT row_id, col_id, round(v, 6) + 0.0 AS value FROM cell")
def vector_rows(spark, sf):
    from pyspark.ml.functions import array_to_vector

    vectors = r.embeddings(spark, sf).select("row_id", array_to_vector("y").alias("v"))
    return r.cells(rows_from_vectors(vectors, "v", "row_id"))


@query("read_vector_text", f"""
WITH {r.EVENT_COUNTS}, ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS line FROM (SELECT DISTINCT row_id FROM counts))
SELECT line AS row_id, {len(r.TYPES)} AS size, col_id, value FROM counts JOIN ranked USING (row_id)""")
def vector_text(spark, sf):
    rows = coo_to_rows(r.event_counts(spark, sf), len(r.TYPES), unique=True)
    out = scratch_path(spark, "vectors")
    path = write_projected(rows.withColumnRenamed("y", "x"), out, "VECTOR")
    long = read_vector_text(spark, path).select(
        "row_id", "size", F.explode(F.arrays_zip("indices", "values")).alias("e")
    )
    return long.select("row_id", "size", F.col("e.indices").alias("col_id"), F.col("e.values").alias("value"))


@query("read_trials", f"WITH {r.TRIALS_SQL} SELECT cell, trial, t, round(value, 6) + 0.0 AS value FROM trials")
def trial_text(spark, sf):
    path = scratch_path(spark, "trials")
    sweeps = [
        F.concat(
            F.lit("["), F.array_join(F.slice("y", k * r.TIMES + 1, r.TIMES).cast("array<string>"), " "), F.lit("]")
        ).alias(str(k))
        for k in range(r.TRIALS)
    ]
    wide = r.weekday_hours(spark, sf).select(
        F.col("row_id").alias("Unnamed: 0"), *sweeps, F.lit("-").alias("dx")
    )
    wide.write.option("header", True).csv(path)
    long = read_trials(spark, path, multi_line=False)
    return long.select("cell", "trial", "t", r.rounded(F.col("value")).alias("value"))


@query("convert_matrix", f"WITH {r.EVENT_COUNTS}, {r.dense_sql('counts')} SELECT row_id, col_id, value FROM dense")
def converted(spark, sf):
    path, out = scratch_path(spark, "coo"), scratch_path(spark, "converted")
    r.event_counts(spark, sf).write.csv(path)
    return r.cells(convert_matrix(spark, path, "COO", out, base=0, d=len(r.TYPES)))


@query("convert_matrix_sparse", f"WITH {r.EVENT_COUNTS} SELECT row_id, col_id, value FROM counts WHERE value <> 0")
def converted_sparse(spark, sf):
    path, out = scratch_path(spark, "coo"), scratch_path(spark, "converted")
    r.event_counts(spark, sf).write.csv(path)
    convert_matrix(spark, path, "COO", out, base=0, d=len(r.TYPES), sparse=True)
    entries = scan_rows(spark, out, len(r.TYPES)).select("row_id", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return entries.select("row_id", F.col("e.idx").alias("col_id"), F.col("e.val").alias("value"))


def _count_rows(spark, sf):
    return coo_to_rows(r.event_counts(spark, sf), len(r.TYPES), unique=True)


@query("fmt_dense", f"""
WITH {r.EVENT_COUNTS}, {r.dense_sql('counts')}
SELECT row_id, string_agg(CAST(value AS VARCHAR), ' ' ORDER BY col_id) AS value FROM dense GROUP BY row_id""")
def dense_lines(spark, sf):
    return as_lines(_count_rows(spark, sf), "DENSE")


@query("fmt_lil", f"""
WITH {r.EVENT_COUNTS}
SELECT row_id, '{{' || string_agg(col_id || ':' || CAST(value AS VARCHAR), ',' ORDER BY col_id) || '}}' AS value
FROM counts WHERE value <> 0 GROUP BY row_id""")
def lil_lines(spark, sf):
    return as_lines(_count_rows(spark, sf), "LIL")


@query("fmt_coo", f"""
WITH {r.EVENT_COUNTS}
SELECT row_id, col_id, row_id || ',' || col_id || ',' || CAST(value AS VARCHAR) AS value
FROM counts WHERE value <> 0""")
def coo_lines(spark, sf):
    return as_lines(_count_rows(spark, sf), "COO")


@query("write_matrix", f"""
WITH {r.EVENT_COUNTS}
SELECT '{{' || string_agg(col_id || ':' || CAST(value AS VARCHAR), ',' ORDER BY col_id) || '}}' AS value
FROM counts WHERE value <> 0 GROUP BY row_id""")
def written(spark, sf):
    path = scratch_path(spark, "lil")
    write_matrix(_count_rows(spark, sf), path, "LIL")
    return spark.read.text(path)
