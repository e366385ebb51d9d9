"""PPCA and factor analysis on sparse cells with the model itself as a table.

For matrices so wide that D x k no longer belongs on the driver or in a task:
loadings are a DataFrame ``col_id, mean, var, noise, c ARRAY<DOUBLE>``.  The cells are
stored once as bucketed blocks; a round sends the model's columns to the blocks and adds
up partial sums per column.  Only k x k sums reach the driver.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.blocks import flat_sum, list_array
from ..plans.cell_blocks import CellBlocks, sum_lists
from ..plans.joins import join_lookup
from ..plans.tall import orthonormal_map, times
from ..session import drop_stored, stored
from .cells import column_sums_cells
from .factor import MIN_NOISE
from .model import MODES, StopRule


def _lists(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Array columns as (rows, k) blocks, plain columns as vectors."""
    out = []
    for name in names:
        column = batch.column(name)
        values = column.flatten() if pa.types.is_list(column.type) else column
        flat = values.to_numpy(zero_copy_only=False).astype(float)
        out.append(flat.reshape(batch.num_rows, -1) if pa.types.is_list(column.type) else flat)
    return out


def _model_sums(table: DataFrame, shapes: dict, fn) -> dict[str, np.ndarray]:
    """Sums of ``fn(batch)`` over the model table, in tasks."""

    def accumulate(batches):
        sums = {name: np.zeros(shape) for name, shape in shapes.items()}
        for batch in batches:
            if batch.num_rows:
                for name, value in fn(batch).items():
                    sums[name] += value
        return sums

    return flat_sum(table, shapes, accumulate)


def _map_model(table: DataFrame, fn, schema: str) -> DataFrame:
    """The model table with columns as ``fn(batch)`` gives them: name -> array or column."""

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                cols = [list_array(v) if isinstance(v, np.ndarray) and v.ndim == 2 else v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                yield pa.RecordBatch.from_arrays(cols, names=list(made))

    return table.mapInArrow(task, schema)


#: sums of more components than this are made in tasks, not in generated code
MAX_UNROLLED = 8


def _weighted_sums(df: DataFrame, key: str, value: Column, row: str, out: str, k: int) -> DataFrame:
    """Per key, the sum of value times the list."""
    if k <= MAX_UNROLLED:
        sums = df.groupBy(key).agg(*[F.sum(value * F.col(row)[j]).alias(f"s{j}") for j in range(k)])
        return sums.select(key, F.array(*[F.col(f"s{j}") for j in range(k)]).alias(out))
    return sum_lists(df.select(key, F.transform(row, lambda x: value * x).alias(out)), key, out, k)


def latent_scores_cells(cells: DataFrame, matrix: DataFrame, k: int, col: str = "w") -> DataFrame:
    """x = y M from cells and ``col_id, <col> ARRAY<DOUBLE>``: ``row_id, x``.

    The matrix is broadcast when small; beyond that hot columns are salted.
    Products combine per row before the shuffle.
    """
    joined = join_lookup(cells, matrix.select("col_id", col), ["col_id"], 32 + 8 * k)
    return _weighted_sums(joined, "row_id", F.col("value"), col, "x", k)


def cross_moments_cells(cells: DataFrame, matrix: DataFrame, k: int, col: str = "w") -> DataFrame:
    """Uncentered Y'X for X = Y M: ``col_id, ytx``.

    X'X and the sum of X follow from it and M, so no other pass is needed.
    """
    x = latent_scores_cells(cells, matrix, k, col)
    return _weighted_sums(cells.join(x, "row_id"), "col_id", F.col("value"), "x", "ytx", k)


@dataclass(frozen=True)
class CellModel:
    """``table``: ``col_id, mean, var, noise, c``; columns without non-zeros are left out.

    With canonical axes there is a further column ``axis``.
    """

    kind: str
    table: DataFrame
    k: int
    n_rows: int
    history: tuple
    path: str | None = None
    eigenvalues: tuple | None = None
    var_exp: tuple | None = None

    def close(self) -> None:
        """Removes the stored table; the model can no longer be read then."""
        if self.path is not None:
            drop_stored(self.table.sparkSession, self.path)

    @property
    def direction(self) -> str:
        """The column that rows are projected on."""
        return "axis" if self.eigenvalues is not None else "c"

    def transform(self, cells: DataFrame, mode: str = "raw") -> DataFrame:
        """``row_id, x`` of the rows that have cells; modes as for the array models."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; use one of {MODES}")
        if mode == "raw":
            width = self.k if self.eigenvalues is None else len(self.eigenvalues)
            return latent_scores_cells(cells, self.table, width, self.direction)
        table, col, k = self.table, self.direction, self.k if self.eigenvalues is None else len(self.eigenvalues)
        if mode == "posterior":
            k = self.k

            def begin(batch):
                c, noise = _lists(batch, "c", "noise")
                return {"p": c.T @ (c / noise[:, None])}

            v = np.linalg.inv(np.eye(k) + _model_sums(table, {"p": (k, k)}, begin)["p"])

            def weigh(batch):
                c, noise = _lists(batch, "c", "noise")
                return {"col_id": batch.column("col_id"), "mean": batch.column("mean"), "w": c @ v / noise[:, None]}

            table, col = _map_model(table, weigh, "col_id INT, mean DOUBLE, w ARRAY<DOUBLE>"), "w"

        def middle(batch):
            w, mean = _lists(batch, col, "mean")
            return {"xm": mean @ w}

        xm = _model_sums(table, {"xm": (k,)}, middle)["xm"]
        shift = F.array(*[F.lit(float(v)) for v in xm])
        scores = latent_scores_cells(cells, table, k, col)
        return scores.select("row_id", F.zip_with("x", shift, lambda x, m: x - m).alias("x"))

    def components(self) -> DataFrame:
        axis = [] if self.eigenvalues is None else ["axis"]
        return self.table.select("col_id", F.col("c").alias("loadings"), "mean", "noise", *axis)

    def loading_rows(self) -> DataFrame:
        """The D x k result matrix as dense rows, ready for ``write_matrix``."""
        return self.table.select(F.col("col_id").cast("bigint").alias("row_id"), F.col(self.direction).alias("y"))

    def history_frame(self, spark) -> DataFrame:
        """A row per round; the first round has no change, and no round an error."""
        rows = [(n, o, None if c is None or math.isinf(c) else c, e) for n, o, c, e in self.history]
        return spark.createDataFrame(rows, "round INT, objective DOUBLE, rel_change DOUBLE, error DOUBLE")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        spark = self.table.sparkSession
        as_list = lambda a: None if a is None else [float(v) for v in a]
        meta = [(self.kind, self.k, self.n_rows, as_list(self.eigenvalues), as_list(self.var_exp))]
        self.table.write.mode(mode).parquet(os.path.join(path, "table"))
        schema = "kind STRING, k INT, n_rows BIGINT, eigenvalues ARRAY<DOUBLE>, var_exp ARRAY<DOUBLE>"
        spark.createDataFrame(meta, schema).coalesce(1).write.mode(mode).parquet(os.path.join(path, "meta"))
        self.history_frame(spark).coalesce(1).write.mode(mode).parquet(os.path.join(path, "history"))

    @staticmethod
    def load(spark, path: str) -> "CellModel":
        meta = spark.read.parquet(os.path.join(path, "meta")).first()
        history = spark.read.parquet(os.path.join(path, "history")).orderBy("round").collect()
        as_tuple = lambda v: None if v is None else tuple(v)
        return CellModel(
            meta["kind"], spark.read.parquet(os.path.join(path, "table")), meta["k"], meta["n_rows"],
            tuple((n, o, math.inf if c is None else c, e) for n, o, c, e in history),
            None, as_tuple(meta["eigenvalues"]), as_tuple(meta["var_exp"]),
        )


def canonical_rotation_cells(cells: DataFrame, model: CellModel) -> CellModel:
    """The model with orthonormal axes in order of score variance, as ``canonical_rotation``.

    The basis comes from a tree of small QR decompositions, the score covariance from
    one round over the cells; signs are fixed by the largest entry of an axis (the
    smallest column where several are equal).
    """
    m = orthonormal_map(model.table, "c", model.k)
    k, n = m.shape[1], float(model.n_rows)
    basis, basis_path = stored(times(model.table, "c", m, "w"), "basis")
    blocks = CellBlocks(cells, k)
    joined = model.table.select("col_id", "mean", "var").join(basis, "col_id").join(blocks.moments(basis), "col_id")

    def begin(batch):
        w, ytx, mean, var = _lists(batch, "w", "ytx", "mean", "var")
        return {"xtx": w.T @ ytx, "xm": mean @ w, "total": np.array([var.sum()])}

    r = _model_sums(joined, {"xtx": (k, k), "xm": (k,), "total": (1,)}, begin)
    scatter = (r["xtx"] + r["xtx"].T) / 2 - n * np.outer(r["xm"], r["xm"])
    values, vectors = np.linalg.eigh(scatter / (n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    turned = times(basis, "w", vectors, "axis")
    flat = turned.select("col_id", F.posexplode("axis").alias("comp", "v"))
    top = flat.groupBy("comp").agg(F.max(F.struct(F.abs("v"), -F.col("col_id"), "v"))["v"].alias("v")).collect()  # k rows
    sign = np.ones(k)
    for x in top:
        sign[x["comp"]] = -1.0 if x["v"] < 0 else 1.0
    axes = times(basis, "w", vectors * sign, "axis")
    table, path = stored(model.table.select("col_id", "mean", "var", "noise", "c").join(axes, "col_id"), "model")
    blocks.close()
    drop_stored(cells.sparkSession, basis_path)
    return replace(
        model, table=table, path=path, eigenvalues=tuple(map(float, values)),
        var_exp=tuple(map(float, np.cumsum(values) / r["total"][0])),
    )


def uniform_start(k: int, seed: int) -> Column:
    """Loadings in [0, 1) from digests of column number, seed and component."""

    def draw(j):
        text = F.concat_ws(":", F.col("col_id").cast("string"), F.lit(str(seed)), j.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)

    # one expression for all components, however many
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw)


def fit_cells(
    cells: DataFrame,
    k: int,
    n_rows: int,
    n_cols: int,
    *,
    kind: str = "ppca",
    max_iter: int = 3,
    tol: float | None = None,
    start: DataFrame | None = None,
    seed: int = 0,
    canonical: bool = False,
) -> CellModel:
    """EM rounds on cells ``row_id, col_id, value`` (each cell at most once).

    Same rounds and stop rules as the array forms, without the error pass.  The cells are
    shuffled and stored once; no round moves them again.
    ``start`` gives ``col_id, c, noise``; otherwise loadings are drawn in [0, 1)
    and the noise is 0.5.
    """
    if kind not in ("ppca", "fa"):
        raise ValueError(f"unknown kind {kind!r}; use ppca or fa")
    n, eye = float(n_rows), np.eye(k)
    mean = F.col("s") / n
    columns = column_sums_cells(cells).select(
        "col_id", mean.alias("mean"), (F.col("q") / n - mean * mean).alias("var")
    )
    if start is None:
        table = columns.withColumn("c", uniform_start(k, seed)).withColumn("noise", F.lit(0.5))
    else:
        lacking = F.raise_error(F.concat(F.lit("no start values for column "), F.col("col_id").cast("string")))
        table = columns.join(start.select("col_id", "c", "noise"), "col_id", "left").withColumn(
            "c", F.coalesce("c", lacking.cast("array<double>"))
        )
    table, path = stored(table.select("col_id", "mean", "var", "noise", "c"), "model")
    isotropic = kind == "ppca"
    blocks = CellBlocks(cells, k)
    stop = StopRule(max_iter, (1e-5 if isotropic else 1.0) if tol is None else tol, relative=isotropic)
    while True:
        def begin(batch):
            c, noise, var = _lists(batch, "c", "noise", "var")
            return {
                "p": c.T @ (c / noise[:, None]),
                "s": np.array([np.log(noise).sum(), (var / noise).sum(), var.sum()]),
            }

        r = _model_sums(table, {"p": (k, k), "s": (3,)}, begin)
        log_noise, scaled_var, total_var = r["s"]
        v = np.linalg.inv(eye + r["p"])

        def weigh(batch, v=v):
            c, noise = _lists(batch, "c", "noise")
            return {"col_id": batch.column("col_id"), "w": c @ v / noise[:, None]}

        weights = _map_model(table, weigh, "col_id INT, w ARRAY<DOUBLE>")
        # the one query over the data in a round
        moments = blocks.moments(weights)
        joined, newer = stored(table.join(weights, "col_id").join(moments, "col_id"), "model")
        drop_stored(cells.sparkSession, path)
        path = newer

        def square(batch):
            w, ytx, mean = _lists(batch, "w", "ytx", "mean")
            return {"xtx": w.T @ ytx / n, "xm": mean @ w}

        r = _model_sums(joined, {"xtx": (k, k), "xm": (k,)}, square)
        xtx, xm = r["xtx"], r["xm"]
        xtx = (xtx + xtx.T) / 2 - np.outer(xm, xm)
        # M-step; (xtx + v) n is X'X + N ss Sx in the isotropic case
        inverse = np.linalg.inv(xtx + v)

        def moved(batch, xm=xm, inverse=inverse):
            ytx, mean = _lists(batch, "ytx", "mean")
            t = ytx / n - mean[:, None] * xm
            c = t @ inverse
            return c, np.sum(c * t, axis=1)

        if isotropic:
            def ends(batch):
                c, explained = moved(batch)
                return {"cc": c.T @ c, "e": np.array([explained.sum()])}

            r = _model_sums(joined, {"cc": (k, k), "e": (1,)}, ends)
            objective = (total_var + float(np.sum((xtx + v) * r["cc"])) - 2 * float(r["e"][0])) / n_cols
        else:
            v_inv = np.linalg.inv(v)
            trace = scaled_var - float(np.sum(v * (v_inv @ xtx @ v_inv)))
            log_det = np.linalg.slogdet(v)[1] - log_noise
            objective = -0.5 * n * (n_cols * math.log(2 * math.pi) - log_det + trace)

        def renew(batch, common=float(objective) if isotropic else None):
            c, explained = moved(batch)
            (var,) = _lists(batch, "var")
            noise = np.full(len(var), common) if isotropic else np.maximum(var - explained, MIN_NOISE)
            return {"col_id": batch.column("col_id"), "mean": batch.column("mean"), "var": batch.column("var"), "noise": noise, "c": c}

        table = _map_model(joined, renew, "col_id INT, mean DOUBLE, var DOUBLE, noise DOUBLE, c ARRAY<DOUBLE>")
        if stop.record(float(objective)):
            blocks.close()
            model = CellModel(kind, table, k, n_rows, tuple(stop.history), path)
            if canonical:
                fitted, model = model, canonical_rotation_cells(cells, model)
                fitted.close()
            return model
