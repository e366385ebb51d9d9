"""Orthogonal bases of tall tables ``col_id, c ARRAY<DOUBLE>`` (D x k) by TSQR.

Each task reduces its rows to the k x k triangle R of their QR decomposition, block by
block; triangles are stacked and reduced in a tree of tasks until a handful is left.
Only those reach the driver, so D is bound by nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blocks import list_array
from .budget import BLOCK_CELLS, wake_blas
from .cell_blocks import list_block

#: triangles that one task, and at last the driver, stacks
FAN = 16


def triangle(rows: np.ndarray) -> np.ndarray:
    """R (k x k, zero rows below) of the QR decomposition of a block."""
    k = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate((r, np.zeros((k - len(r), k)))) if len(r) < k else r


def tall_triangle(table: DataFrame, col: str, k: int, fan: int = FAN) -> np.ndarray:
    """R of the whole table: R'R = C'C without squaring the condition number."""

    def leaves(batches):
        r = None
        step = max(k, BLOCK_CELLS // k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                block = list_block(pa.chunked_array([batch.column(0).slice(at, step)]), k)
                r = triangle(block if r is None else np.concatenate((r, block)))
        if r is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), list_array(r.reshape(1, -1))], names=["node", "r"]
            )

    def merge(group: pa.Table) -> pa.Table:
        stacked = list_block(group.column("r"), k * k).reshape(-1, k)
        return pa.table({"node": group.column("node").slice(0, 1), "r": list_array(triangle(stacked).reshape(1, -1))})

    level = table.select(col).mapInArrow(leaves, "node BIGINT, r ARRAY<DOUBLE>")
    parts = table.rdd.getNumPartitions()
    while parts > fan:
        level = level.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInArrow(merge, "node BIGINT, r ARRAY<DOUBLE>")
        parts = -(-parts // fan)
    found = level.orderBy("node").collect()
    return triangle(np.concatenate([np.reshape(x["r"], (k, k)) for x in found])) if found else np.zeros((k, k))


def times(table: DataFrame, col: str, matrix: np.ndarray, out: str) -> DataFrame:
    """``col_id, out``: the table's lists times a small matrix."""
    k = matrix.shape[0]

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(list_block(pa.chunked_array([batch.column(1)]), k) @ matrix)], names=["col_id", out])

    return table.select("col_id", col).mapInArrow(task, f"col_id INT, {out} ARRAY<DOUBLE>")


def orthonormal_map(table: DataFrame, col: str, k: int) -> np.ndarray:
    """k x m matrix M such that C M is an orthonormal basis of C's column space.

    Directions that rounding alone has made are left out.  A second reduction takes
    away what a badly conditioned C has left between the columns.
    """
    wake_blas()
    first = tall_triangle(table, col, k)
    _, s, vt = np.linalg.svd(first)
    keep = s > s.max(initial=0.0) * k * np.finfo(float).eps * 8
    m = vt[keep].T / s[keep]
    if not keep.any():
        return m
    again = tall_triangle(times(table, col, m, "q"), "q", m.shape[1])
    return m @ np.linalg.inv(again)
