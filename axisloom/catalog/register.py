"""Registry plus the matrices that the queries share, in DataFrame and SQL form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import rows_from_arrays, rows_from_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(column, digits: int = 6):
    """Rounding for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def cells(df: DataFrame, col: str = "y", digits: int = 6) -> DataFrame:
    """``row_id, col_id, value`` of an array column, rounded."""
    long = df.select("row_id", F.posexplode(col).alias("col_id", "value"))
    return long.select("row_id", "col_id", rounded(F.col("value"), digits).alias("value"))


def matrix(spark: SparkSession, m: np.ndarray, digits: int = 6) -> DataFrame:
    from ..operators.stats import matrix_frame

    return matrix_frame(spark, m).withColumn("value", rounded(F.col("value"), digits))


def one_row(spark: SparkSession, **values: float) -> DataFrame:
    schema = ", ".join(f"{name} DOUBLE" for name in values)
    df = spark.createDataFrame([tuple(float(v) for v in values.values())], schema)
    return df.select(*[rounded(F.col(name)).alias(name) for name in values])


# --- lineitem: four numeric columns -----------------------------------------


def lineitem(spark, sf) -> DataFrame:
    return rows_from_columns(
        table(spark, sf, "lineitem"),
        ["l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100],
        "l_orderkey",
    )


LINEITEM = """lineitem4 AS (
  SELECT l_orderkey AS row_id, l_quantity AS y0, l_extendedprice / 1000 AS y1,
         l_discount * 100 AS y2, l_tax * 100 AS y3 FROM lineitem)"""


def lineitem_gaps(spark, sf) -> DataFrame:
    """Discounts and taxes of zero count as not observed."""
    return rows_from_columns(
        table(spark, sf, "lineitem"),
        [
            "l_quantity",
            F.col("l_extendedprice") / 1000,
            F.expr("nullif(l_discount, 0)") * 100,
            F.expr("nullif(l_tax, 0)") * 100,
        ],
        "l_orderkey",
    )


LINEITEM_GAPS = LINEITEM.replace("l_discount * 100", "nullif(l_discount, 0) * 100").replace(
    "l_tax * 100", "nullif(l_tax, 0) * 100"
)


def unpivot(source: str, width: int = 4, value: str = "y{j}") -> str:
    """SQL: one SELECT per column of a wide CTE."""
    return "\n UNION ALL ".join(
        f"SELECT row_id, {j} AS col_id, {value.format(j=j)} AS value FROM {source}" for j in range(width)
    )


def correlated(spark, sf) -> DataFrame:
    """Three columns, two of them close to each other."""
    return rows_from_columns(
        table(spark, sf, "lineitem"),
        [
            "l_quantity",
            F.col("l_quantity") * (1 - F.col("l_discount")),
            F.col("l_extendedprice") / 1000 * (1 + F.col("l_tax")),
        ],
        "l_orderkey",
    )


CORRELATED = """correlated AS (
  SELECT l_orderkey AS row_id, l_quantity AS y0, l_quantity * (1 - l_discount) AS y1,
         l_extendedprice / 1000 * (1 + l_tax) AS y2 FROM lineitem)"""

# --- embeddings: 64 columns, with a fixed map and fixed loadings -------------

WIDTH, COMPONENTS = 64, 3


def embeddings(spark, sf) -> DataFrame:
    return rows_from_arrays(table(spark, sf, "embeddings"), "embedding", "vec_id")


EMBEDDINGS = """cell AS (
  SELECT vec_id AS row_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS col_id,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def fixed_loadings(d: int = WIDTH, k: int = COMPONENTS) -> np.ndarray:
    i, j = np.indices((d, k))
    return ((i * 7 + j * 13) % 11 - 5) / 10.0


def fixed_map(d: int = WIDTH, k: int = COMPONENTS) -> np.ndarray:
    i, j = np.indices((d, k))
    return ((i * 5 + j * 3) % 7 - 3) / 20.0


FIXED = f"""fixed AS (
  SELECT CAST(i AS INTEGER) AS col_id, CAST(j AS INTEGER) AS comp,
         ((i * 7 + j * 13) % 11 - 5) / 10.0::DOUBLE AS c, ((i * 5 + j * 3) % 7 - 3) / 20.0::DOUBLE AS w
  FROM range({WIDTH}) a(i), range({COMPONENTS}) b(j))"""

# --- events: users x types, and series by hour ------------------------------

TYPES = ("click", "error", "purchase", "signup", "view")
TYPE_LIST = ", ".join(f"'{t}'" for t in TYPES)


def type_number():
    """Number of an event type; a type that is not in the list raises, none is dropped."""
    return F.expr(
        f"cast(if(event_type in ({TYPE_LIST}), array_position(array({TYPE_LIST}), event_type), "
        "cast(raise_error(concat('unknown event type: ', coalesce(event_type, 'NULL'))) AS bigint)) - 1 AS int)"
    )


TYPE_NUMBER = (
    f"CAST(CASE WHEN event_type IN ({TYPE_LIST}) THEN list_position([{TYPE_LIST}], event_type) "
    "ELSE error('unknown event type') END - 1 AS INTEGER)"
)


def event_sums(spark, sf) -> DataFrame:
    """Cells user x type: summed value."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("row_id"), type_number().alias("col_id"))
        .agg(F.sum("value").alias("value"))
    )


EVENT_SUMS = f"""sums AS (
  SELECT user_id AS row_id, {TYPE_NUMBER} AS col_id, sum(value) AS value FROM events GROUP BY 1, 2)"""


def event_counts(spark, sf) -> DataFrame:
    """Cells user x type: number of events."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("row_id"), type_number().alias("col_id"))
        .agg(F.count("*").cast("double").alias("value"))
    )


EVENT_COUNTS = f"""counts AS (
  SELECT user_id AS row_id, {TYPE_NUMBER} AS col_id, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2)"""


def dense_sql(source: str, width: int = len(TYPES)) -> str:
    """SQL CTE ``dense``: every (row, column), absent cells as 0."""
    return f"""dense AS (
  SELECT r.row_id, CAST(c.j AS INTEGER) AS col_id, coalesce(s.value, 0) AS value
  FROM (SELECT DISTINCT row_id FROM {source}) r CROSS JOIN range({width}) c(j)
  LEFT JOIN {source} s ON s.row_id = r.row_id AND s.col_id = c.j)"""


def hour_number():
    """Hours since 1970; timestamps have no zone, so no session setting matters."""
    return F.expr("cast(date_diff(to_date(ts), date'1970-01-01') * 24 + hour(ts) AS bigint)")


HOUR_NUMBER = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT)"


def hourly(spark, sf) -> DataFrame:
    """Series by type: summed value per hour."""
    return (
        table(spark, sf, "events")
        .groupBy(type_number().alias("series"), hour_number().alias("t"))
        .agg(F.sum("value").alias("value"))
    )


HOURLY = f"""hourly AS (
  SELECT {TYPE_NUMBER} AS series, {HOUR_NUMBER} AS t, sum(value) AS value FROM events GROUP BY 1, 2)"""

# trials: user = cell, weekday = trial, hour of day = t
TRIALS, TIMES = 7, 24


def weekday_hours(spark, sf) -> DataFrame:
    """Dense rows per user over weekday x hour (summed value)."""
    from ..operators.rows import coo_to_rows

    slots = (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("row_id"),
            F.expr(f"cast(weekday(to_date(ts)) * {TIMES} + hour(ts) AS int)").alias("col_id"),
        )
        .agg(F.sum("value").alias("value"))
    )
    return coo_to_rows(slots, TRIALS * TIMES, unique=True)


def trials(spark, sf) -> DataFrame:
    """``cell, trial, t, value``."""
    long = weekday_hours(spark, sf).select(
        F.col("row_id").cast("int").alias("cell"), F.posexplode("y").alias("slot", "value")
    )
    return long.select(
        "cell",
        F.expr(f"cast(slot div {TIMES} AS int)").alias("trial"),
        (F.col("slot") % TIMES).alias("t"),
        "value",
    )


TRIALS_SQL = f"""slots AS (
  SELECT CAST(user_id AS INTEGER) AS cell, CAST(isodow(ts) - 1 AS INTEGER) AS trial,
         CAST(hour(ts) AS INTEGER) AS t, sum(value) AS value FROM events GROUP BY 1, 2, 3),
trials AS (
  SELECT u.cell, CAST(a.i AS INTEGER) AS trial, CAST(b.i AS INTEGER) AS t, coalesce(s.value, 0) AS value
  FROM (SELECT DISTINCT cell FROM slots) u CROSS JOIN range({TRIALS}) a(i) CROSS JOIN range({TIMES}) b(i)
  LEFT JOIN slots s ON s.cell = u.cell AND s.trial = a.i AND s.t = b.i)"""
