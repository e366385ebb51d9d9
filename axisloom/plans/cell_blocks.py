"""Sparse cells stored once as blocks, for fits whose model is a table.

Rows are dealt to *bundles* of bounded size.  A bundle's cells are kept column by
column: one stored row ``bundle, col_id, rows, vals`` per column that it has, with row
numbers local to the bundle.  The table is bucketed by bundle, so a round never moves a
cell: the model's columns travel to the bundles that use them, a bundle multiplies
(its scores never leave the task), and one shuffle adds up partial sums per column.

Rows with so many cells that they would burst a bundle are kept apart as cells and
take the relational way (two joins); they may be of any length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import drop_stored, scratch_path, stored
from .blocks import list_array
from .budget import wake_blas
from .moments import sparse_times

#: model columns and products that a bundle may need at once
BUNDLE_BYTES = 48 << 20
#: the longest row of a bundle, as a part of its cells
LONG_ROW = 8
#: bundles of one bucket, and buckets at most
PER_BUCKET, MAX_BUCKETS = 8, 50_000


def list_block(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """Lists of k doubles as a (rows, k) block."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, k)


def sum_lists(df: DataFrame, key: str, col: str, k: int) -> DataFrame:
    """``key, col``: element-wise sums of lists of k doubles per key.

    Sorted rows are added in runs with what is left of the run before, so a key with
    any number of rows needs the memory of a batch.
    """
    kind = dict(df.dtypes)[key]

    def task(batches):
        key_now, sum_now, key_type = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_type = batch.schema[0].type
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            block = list_block(pa.chunked_array([batch.column(1)]), k)
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums, found = np.add.reduceat(block, start, axis=0), keys[start]
            if key_now is not None:
                if found[0] == key_now:
                    sums[0] += sum_now
                else:
                    sums, found = np.concatenate((sum_now[None], sums)), np.concatenate(([key_now], found))
            key_now, sum_now = found[-1], sums[-1].copy()
            if len(found) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(found[:-1], key_type), list_array(sums[:-1])], names=[key, col])
        if key_now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key_now], key_type), list_array(sum_now[None])], names=[key, col])

    dealt = df.select(key, col).repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(task, f"{key} {kind}, {col} ARRAY<DOUBLE>")


def _pack(cells: pa.Table) -> pa.Table:
    """Cells of one bundle, column by column."""
    row = np.unique(cells.column("row_id").to_numpy(), return_inverse=True)[1].astype(np.int32)
    col, value = cells.column("col_id").to_numpy(), cells.column("value").to_numpy()
    order = np.lexsort((row, col))
    row, col, value = row[order], col[order], value[order]
    start = np.flatnonzero(np.append(True, col[1:] != col[:-1])) if len(col) else np.empty(0, np.int64)
    bounds = pa.array(np.append(start, len(col)).astype(np.int32))
    return pa.table(
        {
            "bundle": pa.array(np.full(len(start), cells.column("bundle")[0].as_py() if len(col) else 0, np.int64)),
            "col_id": pa.array(col[start].astype(np.int32)),
            "rows": pa.ListArray.from_arrays(bounds, pa.array(row)),
            "vals": pa.ListArray.from_arrays(bounds, pa.array(value)),
        }
    )


def bundle_products(k: int):
    """For one bundle: its columns' parts of Y'X with X = Y W, from blocks and the rows of W."""

    def run(blocks: pa.Table, weights: pa.Table) -> pa.Table:
        have, known = blocks.column("col_id").to_numpy(), weights.column("col_id").to_numpy()
        order = np.argsort(known, kind="stable")
        at = np.searchsorted(known[order], have)
        at[at == len(known)] = 0
        with_weights = known[order][at] == have if len(known) else np.zeros(len(have), dtype=bool)
        blocks, at = blocks.filter(pa.array(with_weights)), at[with_weights]
        if not blocks.num_rows:
            return pa.table({"col_id": pa.array([], pa.int32()), "ytx": pa.array([], pa.list_(pa.float64()))})
        w = list_block(weights.column("w"), k)[order][at]
        rows = blocks.column("rows").combine_chunks()
        length = rows.value_lengths().to_numpy()
        row = rows.flatten().to_numpy().astype(np.int64)
        value = blocks.column("vals").combine_chunks().flatten().to_numpy()
        col = np.repeat(np.arange(len(length)), length)
        x = sparse_times(row, col, value, int(row.max()) + 1, w)
        ytx = sparse_times(col, row, value, len(length), x)
        return pa.table({"col_id": blocks.column("col_id"), "ytx": list_array(ytx)})

    return run


class CellBlocks:
    """Stored blocks of ``row_id, col_id, value`` (each cell at most once; NULL values are left out)."""

    def __init__(self, cells: DataFrame, k: int, bundle_bytes: int = BUNDLE_BYTES):
        self.spark, self.k = cells.sparkSession, k
        wake_blas()
        cells = cells.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
        limit = max(256, bundle_bytes // (8 * k))
        counts, counts_path = stored(cells.groupBy("row_id").agg(F.count("*").alias("n")), "row-cells")
        is_long = F.col("n") > max(1, limit // LONG_ROW)
        sizes = counts.agg(F.sum(F.when(~is_long, F.col("n"))).alias("short"), F.count(F.when(is_long, 1)).alias("long")).first()
        self.n_bundles = max(1, -(-int(sizes["short"] or 0) * 2 // limit))
        self.buckets = min(self.n_bundles, MAX_BUCKETS, max(self.spark.sparkContext.defaultParallelism, -(-self.n_bundles // PER_BUCKET)))
        self.long = None
        if sizes["long"]:
            # the engine broadcasts a short list of long rows, and splits them otherwise
            marked = cells.join(counts.filter(is_long).select("row_id"), "row_id", "left_semi")
            self.long, self.long_path = stored(marked, "long-rows")
            cells = cells.join(counts.filter(is_long).select("row_id"), "row_id", "left_anti")
        bundle = F.pmod(F.xxhash64("row_id"), F.lit(self.n_bundles)).alias("bundle")
        dealt = cells.select(bundle, "row_id", "col_id", "value").repartition(self.buckets, "bundle")
        packed = dealt.groupBy("bundle").applyInArrow(_pack, "bundle BIGINT, col_id INT, rows ARRAY<INT>, vals ARRAY<DOUBLE>")
        self.blocks = self._bucketed(packed, "bundle", self.buckets)
        # which bundles need a column of the model
        index = self.spark.table(self.blocks).select("bundle", "col_id").repartition(self.buckets, "col_id")
        self.index = self._bucketed(index, "col_id", self.buckets)
        drop_stored(self.spark, counts_path)

    def _bucketed(self, df: DataFrame, key: str, n: int) -> str:
        name, path = f"axisloom_{uuid.uuid4().hex}", scratch_path(self.spark, "cell-blocks")
        df.write.format("parquet").bucketBy(n, key).sortBy(key, *(["col_id"] if key != "col_id" else [])).option("path", path).saveAsTable(name)
        self.__dict__.setdefault("paths", []).append(path)
        return name

    def moments(self, weights: DataFrame) -> DataFrame:
        """``col_id, ytx``: uncentered Y'X for X = Y W, from ``col_id, w ARRAY<DOUBLE>``.

        The stored blocks are read in place; model columns are shuffled to the bundles,
        partial sums to the columns.
        """
        needed = self.spark.table(self.index).join(weights.select("col_id", "w"), "col_id").select("bundle", "col_id", "w")
        partial = (
            self.spark.table(self.blocks).groupBy("bundle").cogroup(needed.groupBy("bundle")).applyInArrow(bundle_products(self.k), "col_id INT, ytx ARRAY<DOUBLE>")
        )
        if self.long is not None:
            from ..operators.cells_fit import cross_moments_cells

            partial = partial.unionByName(cross_moments_cells(self.long, weights, self.k))
        return sum_lists(partial, "col_id", "ytx", self.k)

    def close(self) -> None:
        """Removes the tables."""
        for name, path in zip((self.blocks, self.index), self.paths):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_stored(self.spark, path)
        if self.long is not None:
            drop_stored(self.spark, self.long_path)
