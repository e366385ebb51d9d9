"""Column statistics and cross moments, each behind the plan that suits its shape.

* narrow dense rows: aggregates written out as SQL, inside generated code;
* dense rows: Arrow blocks and matrix products, one partial per partition;
* sparse rows: Arrow blocks over the non-zeros only.

``moments(W)`` returns ``X'X`` and ``Yc'X`` for ``X = Yc W`` with ``Yc`` the
centered rows.  For matrices of moderate width the scatter matrix ``Yc'Yc`` is a
sufficient statistic: one pass over the data then serves every EM round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import checked_rows, flat_sum, iter_blocks, list_array, width
from .budget import BLOCK_CELLS, MAX_WIDE_AGGREGATES, check_bytes, gram_fits, wake_blas, wide_gram_fits


@dataclass(frozen=True)
class ColumnStats:
    """Per-column figures over the non-NULL cells of an N x D matrix."""

    n_rows: int
    count: np.ndarray
    mean: np.ndarray
    var_pop: np.ndarray

    @property
    def d(self) -> int:
        return len(self.mean)

    @property
    def std_pop(self) -> np.ndarray:
        return np.sqrt(self.var_pop)

    @property
    def norm2(self) -> float:
        """Squared Frobenius norm of the centered matrix."""
        return float(np.sum(self.var_pop * self.count))


def _sums(df: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, observed cells per column, their means) over all rows."""

    def accumulate(batches):
        n, c, s = 0, np.zeros(d), np.zeros(d)
        for block in iter_blocks(batches, d):
            ok = ~np.isnan(block)
            n += len(block)
            c += ok.sum(axis=0)
            s += np.where(ok, block, 0.0).sum(axis=0)
        return {"n": np.array([n]), "c": c, "s": s} if n else None

    r = flat_sum(df.select("y"), {"n": (1,), "c": (d,), "s": (d,)}, accumulate)
    if r["n"][0] == 0:
        raise ValueError("empty matrix")
    with np.errstate(invalid="ignore"):
        return int(r["n"][0]), r["c"], r["s"] / np.maximum(r["c"], 1)


def column_stats(df: DataFrame, d: int | None = None) -> ColumnStats:
    """Counts, means and population variances; NULL and NaN cells are left out.

    Narrow rows: the engine's own stable aggregates, one pass.  Wide rows: a pass for
    the means and one for squared distances from them.
    """
    d = width(df, d)
    if 3 * d + 1 <= MAX_WIDE_AGGREGATES:
        rows = df.select(checked_rows("y", d).alias("y"))
        aggs = [F.count("*").alias("n")]
        for j in range(d):
            y = F.nanvl(F.col("y")[j], F.lit(None).cast("double"))
            aggs += [F.count(y).alias(f"c{j}"), F.avg(y).alias(f"m{j}"), F.var_pop(y).alias(f"v{j}")]
        r = rows.agg(*aggs).first()
        if r["n"] == 0:
            raise ValueError("empty matrix")
        c, mean, var = (np.array([np.nan if r[f"{p}{j}"] is None else r[f"{p}{j}"] for j in range(d)], float) for p in "cmv")
        return ColumnStats(int(r["n"]), c, mean, var)
    n, c, mean = _sums(df, d)

    def accumulate(batches):
        s, q = np.zeros(d), np.zeros(d)
        for block in iter_blocks(batches, d):
            z = np.where(np.isnan(block), 0.0, block - mean)
            s += z.sum(axis=0)
            q += np.einsum("ij,ij->j", z, z)
        return {"s": s, "q": q}

    with np.errstate(invalid="ignore"):  # infinite cells give NaN
        r = flat_sum(df.select("y"), {"s": (d,), "q": (d,)}, accumulate)
        safe = np.maximum(c, 1)
        # what the rounding of the means has left over
        var = np.maximum(r["q"] / safe - (r["s"] / safe) ** 2, 0.0)
        return ColumnStats(n, c, np.where(c > 0, mean + r["s"] / safe, np.nan), np.where(c > 0, var, np.nan))


def scatter(df: DataFrame, d: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(N, mean, Yc'Yc) over complete rows: one pass when narrow, else one for the means first."""
    d = width(df, d)
    gaps = "NULL, NaN or infinite cells: use the fit for missing values"
    if wide_gram_fits(d):
        rows = df.select(checked_rows("y", d).alias("y"))
        y = [F.col("y")[j] for j in range(d)]
        aggs = [F.count("*").alias("n")]
        aggs += [F.count(y[j]).alias(f"c{j}") for j in range(d)]
        aggs += [F.avg(y[j]).alias(f"m{j}") for j in range(d)]
        aggs += [F.covar_pop(y[i], y[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
        r = rows.agg(*aggs).first()
        n = r["n"]
        if n == 0:
            raise ValueError("empty matrix")
        if any(r[f"c{j}"] != n for j in range(d)):
            raise ValueError(gaps)
        mean = np.array([r[f"m{j}"] for j in range(d)], float)
        g = n * np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    else:
        check_bytes("scatter matrix", d * d)
        n, c, mean = _sums(df, d)
        if np.any(c != n) or not np.all(np.isfinite(mean)):
            raise ValueError(gaps)

        def accumulate(batches):
            s, g = np.zeros(d), np.zeros((d, d))
            for block in iter_blocks(batches, d):
                z = block - mean
                s += z.sum(axis=0)
                g += z.T @ z
            return {"s": s, "g": g}

        r = flat_sum(df.select("y"), {"s": (d,), "g": (d, d)}, accumulate)
        s = r["s"]
        g, mean = r["g"] - np.outer(s, s) / n, mean + s / n
    if not np.all(np.isfinite(g)):
        raise ValueError(gaps)
    return int(n), mean, g


def score_square(w: np.ndarray, ytx: np.ndarray) -> np.ndarray:
    """X'X = W' Yc'X, because X = Yc W; symmetric up to rounding, so made so."""
    xtx = w.T @ ytx
    return (xtx + xtx.T) / 2


class GramMoments:
    """Moments from the scatter matrix; the data is read once, whatever the rounds."""

    passes_per_call = 0

    def __init__(self, df: DataFrame, d: int | None = None, n_rows: int | None = None):
        counted, self.mean, self.scatter = scatter(df, d)
        self.n = self.stored = counted
        if n_rows is not None and n_rows != counted:
            self.n, self.mean, self.scatter = with_absent_rows(counted, n_rows, self.mean, self.scatter)
        self.d = len(self.mean)
        self.col_ss = np.diag(self.scatter).copy()

    def moments(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ytx = self.scatter @ w
        return score_square(w, ytx), ytx


def with_absent_rows(counted, n_rows, mean, g):
    """All-zero rows that were not stored still count towards N."""
    if n_rows < counted:
        raise ValueError(f"{n_rows} rows announced, {counted} found")
    raw = g + counted * np.outer(mean, mean)
    mean = mean * (counted / n_rows)
    return n_rows, mean, raw - n_rows * np.outer(mean, mean)


class _PassMoments:
    """Moments from one pass per call.

    A pass can take along the L1 error of the fit before: ``watch`` names the
    fit, and after the next ``moments`` call ``watched`` holds its column sums.
    """

    passes_per_call = 1

    def __init__(self):
        self._fit = None
        self.watched: tuple[np.ndarray, np.ndarray] | None = None

    def watch(self, score_map: np.ndarray, loadings: np.ndarray) -> None:
        self._fit = (score_map, loadings)

    def _run(self, shapes, accumulate):
        """One pass; ``accumulate(add_error, more)`` makes the task function."""
        fit, mean, d = self._fit, self.mean, self.d
        self._fit = self.watched = None
        if fit is None:
            return flat_sum(self.df, shapes, accumulate(None, {}))
        w, c = fit
        start = {"err": (d,), "norm": (d,)}

        def add_error(sums, z):
            sums["norm"] += np.abs(z).sum(axis=0)
            sums["err"] += np.abs((z @ w) @ c.T - z).sum(axis=0)

        r = flat_sum(self.df, {**shapes, **start}, accumulate(add_error, start))
        absent = self.n - self.stored
        self.watched = (
            r["err"] + absent * np.abs(mean - (mean @ w) @ c.T),
            r["norm"] + absent * np.abs(mean),
        )
        return r


class RowMoments(_PassMoments):
    """One Arrow block pass over dense rows per call."""

    def __init__(self, df: DataFrame, d: int | None = None, n_rows: int | None = None):
        super().__init__()
        stats = column_stats(df, d)
        if np.any(stats.count != stats.n_rows):
            raise ValueError("NULL cells: use the fit for missing values")
        self.df = df.select("y")
        self.n, self.d, self.stored = n_rows or stats.n_rows, stats.d, stats.n_rows
        self.absent = self.n - self.stored
        if self.absent < 0:
            raise ValueError(f"{n_rows} rows announced, {stats.n_rows} found")
        self.mean = stats.mean * (stats.n_rows / self.n)
        self.col_ss = (
            stats.var_pop * stats.n_rows
            + stats.n_rows * (stats.mean - self.mean) ** 2
            + self.absent * self.mean**2
        )

    def moments(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, k = w.shape
        mean = self.mean

        def accumulate(add_error, more):
            def walk(batches):
                sums = {n: np.zeros(shape) for n, shape in {**shapes, **more}.items()}
                for block in iter_blocks(batches, d):
                    z = block - mean
                    sums["ytx"] += z.T @ (z @ w)
                    if add_error:
                        add_error(sums, z)
                return sums

            return walk

        shapes = {"ytx": (d, k)}
        # rows that were not stored are zero before centering
        ytx = self._run(shapes, accumulate)["ytx"] + self.absent * np.outer(mean, mean @ w)
        return score_square(w, ytx), ytx


def sparse_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, column indices, values) of a sparse-row batch."""
    idx = batch.column(batch.schema.get_field_index("idx"))
    val = batch.column(batch.schema.get_field_index("val"))
    lengths = np.diff(idx.offsets.to_numpy())
    rows = np.repeat(np.arange(batch.num_rows), lengths)
    cols = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    values = val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(cols) != len(values):
        raise ValueError("sparse rows: idx and val differ in length")
    if not np.all(np.isfinite(values)):
        raise ValueError("NULL, NaN or infinite cells in sparse rows")
    rising = (rows[1:] != rows[:-1]) | (cols[1:] > cols[:-1])
    if not rising.all() and len(np.unique(np.stack((rows, cols)), axis=1)[0]) != len(rows):
        raise ValueError("sparse rows: a column is repeated in a row")
    return rows, cols, values


def iter_sparse_blocks(batches, d: int):
    """Dense blocks of bounded size from sparse rows, for results that are dense anyway."""
    step = max(1, BLOCK_CELLS // d)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            rows, cols, values = sparse_arrays(part)
            block = np.zeros((part.num_rows, d))
            block[rows, cols] = values
            yield block


def sparse_times(rows, cols, values, n, matrix) -> np.ndarray:
    """Sparse block (n rows) times a dense matrix, touching non-zeros only."""
    out = np.zeros((n, matrix.shape[1]))
    for j in range(matrix.shape[1]):
        out[:, j] = np.bincount(rows, weights=values * matrix[cols, j], minlength=n)
    return out


def sparse_linear_rows(df: DataFrame, matrix: np.ndarray, offset: np.ndarray | None = None) -> DataFrame:
    """Sparse rows times a (d, k) matrix plus an offset: ``x`` in place of ``idx, val``."""
    check_bytes("projection matrix", matrix.size)
    keep = [c for c in df.columns if c not in ("idx", "val")]
    x_field = T.StructField("x", T.ArrayType(T.DoubleType()))

    def task(batches):
        for batch in batches:
            rows, cols, values = sparse_arrays(batch)
            x = sparse_times(rows, cols, values, batch.num_rows, matrix)
            same = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            x = x if offset is None else x + offset
            yield pa.RecordBatch.from_arrays(same + [list_array(x)], names=[*keep, "x"])

    return df.mapInArrow(task, T.StructType([*[df.schema[c] for c in keep], x_field]))


class SparseMoments(_PassMoments):
    """Sparse rows ``idx, val``: means are carried apart, zeros are never visited
    (except for the error, which is dense in every row)."""

    def __init__(self, df: DataFrame, d: int, n_rows: int | None = None):
        super().__init__()
        self.df = df.select("idx", "val")
        self.d = d

        def accumulate(batches):
            n, s, nnz = 0, np.zeros(d), np.zeros(d)
            for batch in batches:
                _, cols, values = sparse_arrays(batch)
                n += batch.num_rows
                s += np.bincount(cols, weights=values, minlength=d)
                nnz += np.bincount(cols, minlength=d)
            return {"n": np.array([n]), "s": s, "nnz": nnz} if n else None

        r = flat_sum(self.df, {"n": (1,), "s": (d,), "nnz": (d,)}, accumulate)
        self.stored = int(r["n"][0])
        if n_rows is not None and n_rows < self.stored:
            raise ValueError(f"{n_rows} rows announced, {self.stored} found")
        self.n = n_rows or self.stored
        if self.n == 0:
            raise ValueError("empty matrix")
        self.mean = mean = r["s"] / self.n

        def squares(batches):
            q = np.zeros(d)
            for batch in batches:
                _, cols, values = sparse_arrays(batch)
                q += np.bincount(cols, weights=(values - mean[cols]) ** 2, minlength=d)
            return {"q": q}

        # distances from the mean at the stored cells, the mean itself at all others
        q = flat_sum(self.df, {"q": (d,)}, squares)["q"]
        self.col_ss = q + (self.n - r["nnz"]) * mean**2

    def moments(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, k = w.shape
        mean = self.mean

        def accumulate(add_error, more):
            def walk(batches):
                sums = {n: np.zeros(shape) for n, shape in {**shapes, **more}.items()}
                for batch in batches:
                    rows, cols, values = sparse_arrays(batch)
                    x = sparse_times(rows, cols, values, batch.num_rows, w)
                    for j in range(k):
                        sums["ytx"][:, j] += np.bincount(cols, weights=values * x[rows, j], minlength=d)
                    if add_error:
                        for block in iter_sparse_blocks([batch], d):
                            add_error(sums, block - mean)
                return sums

            return walk

        shapes = {"ytx": (d, k)}
        # the sum of x over all rows is N xm, so centering is a rank-one correction
        ytx = self._run(shapes, accumulate)["ytx"] - self.n * np.outer(mean, mean @ w)
        return score_square(w, ytx), ytx


def moment_source(
    df: DataFrame, plan: str = "auto", d: int | None = None, n_rows: int | None = None
):
    """Picks gram (one pass in all), rows or sparse (one pass per round)."""
    wake_blas()
    if "idx" in df.columns:
        if d is None:
            raise ValueError("sparse rows need the number of columns")
        return SparseMoments(df, d, n_rows)
    d = width(df, d)
    if plan == "auto":
        plan = "gram" if gram_fits(d) else "rows"
    if plan == "gram":
        return GramMoments(df, d, n_rows)
    if plan == "rows":
        return RowMoments(df, d, n_rows)
    raise ValueError(f"unknown plan {plan!r}; use auto, gram or rows")
