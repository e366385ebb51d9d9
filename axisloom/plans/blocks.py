"""Arrow block passes over dense rows.

Each task walks its partition once, turns Arrow batches into numpy blocks
without copying rows one by one, and either maps rows or emits one partial sum.
Partial sums are cut into short chunks, so that the final aggregation is an
ordinary ``groupBy`` spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .budget import BLOCK_CELLS, MAX_WIDE_PRODUCTS, check_bytes

# doubles per partial-sum row: short rows plan quickly, long ones save per-row cost
SHORT_CHUNK, LONG_CHUNK, SHORT_TOTAL = 8, 64, 1 << 14
# partial sums: a few per core, but never so few that executors which register later stay idle
PARTIALS_PER_CORE, LEAST_PARTIALS = 4, 1024


def width(df: DataFrame, d: int | None = None, col: str = "y") -> int:
    """Number of columns of a dense matrix; reads one row when not given."""
    if d is not None:
        return d
    first = df.select(F.size(col)).first()
    if first is None:
        raise ValueError("empty matrix")
    return first[0]


def checked_rows(col: str, d: int):
    """The array column, raising for rows that are NULL or have another width: all plans
    treat such rows alike."""
    wrong = F.concat(
        F.lit("ragged matrix rows: "),
        F.coalesce(F.size(col).cast("string"), F.lit("a matrix row is NULL")),
        F.lit(f" where {d} values are expected in each"),
    )
    return F.when(F.size(col) == d, F.col(col)).otherwise(F.raise_error(wrong).cast("array<double>"))


def dense_block(column: pa.Array, d: int) -> np.ndarray:
    """List column -> (rows, d) float64; NULL becomes NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a matrix row is NULL")
    flat = column.flatten()
    n = len(column)
    if len(flat) != n * d or (n and not np.all(np.diff(column.offsets.to_numpy()) == d)):
        raise ValueError(f"ragged matrix rows: expected {d} values in each")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, d)


def iter_blocks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Row blocks of bounded size from a one-column batch stream."""
    rows = max(1, BLOCK_CELLS // max(d, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield dense_block(batch.column(0).slice(start, rows), d)


def rows_with_null(column: pa.Array) -> np.ndarray:
    """Which rows of a list column (without NULL rows) have a NULL cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if not flat.null_count:
        return np.zeros(len(column), dtype=bool)
    null = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    out = np.zeros(len(column), dtype=bool)
    out[np.searchsorted(ends, null, side="right")] = True
    return out


def list_array(block: np.ndarray, null_rows: np.ndarray | None = None) -> pa.Array:
    """Rows as lists; all cells of ``null_rows`` are NULL."""
    n, k = block.shape
    mask = None if null_rows is None or not null_rows.any() else np.repeat(null_rows, k)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)),
        pa.array(np.ascontiguousarray(block).ravel(), from_pandas=False, mask=mask),
    )


def map_rows(
    df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out: str, d: int, col: str = "y"
) -> DataFrame:
    """Adds ``out ARRAY<DOUBLE>`` = fn(block of ``col``); drops ``col``.

    A row with a NULL cell has NULL in all its results.
    """
    keep = [c for c in df.columns if c != col]
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    )

    def task(batches):
        step = max(1, BLOCK_CELLS // max(d, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                source = part.column(part.schema.get_field_index(col))
                block = dense_block(source, d)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                made = list_array(fn(block), rows_with_null(source))
                yield pa.RecordBatch.from_arrays(cols + [made], names=keep + [out])

    return df.mapInArrow(task, schema)


def linear_rows(
    df: DataFrame,
    matrix: np.ndarray,
    out: str = "x",
    offset: np.ndarray | None = None,
    col: str = "y",
) -> DataFrame:
    """Rows times a (d, k) matrix, plus an offset of length k.

    Small products are written as SQL and stay in generated code; larger ones
    run as one matrix product per Arrow block.
    """
    d, k = matrix.shape
    check_bytes("projection matrix", d * k)
    shift = np.zeros(k) if offset is None else np.asarray(offset, float)
    if d * k <= MAX_WIDE_PRODUCTS:
        y = checked_rows(col, d)
        cells = [
            sum((y[i] * float(matrix[i, j]) for i in range(d)), F.lit(float(shift[j]))) for j in range(k)
        ]
        keep = [c for c in df.columns if c != col]
        return df.select(*keep, F.array(*cells).alias(out))
    return map_rows(df, lambda block: block @ matrix + shift, out, d, col)


def flat_sum(
    df: DataFrame,
    shapes: Mapping[str, Sequence[int]],
    accumulate: Callable[[Iterable[pa.RecordBatch]], Mapping[str, np.ndarray] | None],
) -> dict[str, np.ndarray]:
    """Sums named arrays over all partitions.

    ``accumulate`` sees the batches of one partition and returns its partial
    arrays.  The result has model size, not data size.  Scan splits are taken
    together, so that there are a few partial sums per core and not one per split.
    """
    names = list(shapes)
    sizes = [int(np.prod(shapes[n], dtype=np.int64)) for n in names]
    total = sum(sizes)
    check_bytes("sum of partial arrays", total)
    chunk = SHORT_CHUNK if total <= SHORT_TOTAL else LONG_CHUNK
    n_chunks = -(-total // chunk)

    def task(batches):
        part = accumulate(batches)
        if part is None:
            return
        flat = np.zeros(n_chunks * chunk)
        flat[:total] = np.concatenate([np.asarray(part[n], float).ravel() for n in names])
        ids = np.arange(n_chunks, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), list_array(flat.reshape(n_chunks, chunk))], names=["chunk", "v"]
        )

    most = max(PARTIALS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, LEAST_PARTIALS)
    partial = df.coalesce(most).mapInArrow(task, "chunk INT, v ARRAY<DOUBLE>")
    sums = [F.expr(f"sum(v[{j}])").alias(f"s{j}") for j in range(chunk)]
    table = partial.groupBy("chunk").agg(*sums).toArrow()
    flat = np.zeros((n_chunks, chunk))
    if table.num_rows:
        rows = table.column("chunk").to_numpy()
        flat[rows] = np.column_stack([table.column(f"s{j}").to_numpy() for j in range(chunk)])
    flat = flat.ravel()
    result, at = {}, 0
    for n, size in zip(names, sizes):
        result[n] = flat[at : at + size].reshape(tuple(shapes[n]))
        at += size
    return result
