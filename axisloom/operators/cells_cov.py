"""Covariance of wide sparse matrices from their cells.

Rows are dealt to bundles of bounded size.  A bundle cuts its columns into tiles and multiplies
tile by tile, only where some row has cells in both; what it gives on is the non-zero
part of each product.  Products of a tile pair are added up in one T x T block that
walks over sorted pieces.  No pair of cells is ever a row, and zeros are never visited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import join_lookup
from ..session import stored
from .cells import column_sums_cells

TILE = 256
#: cells of a bundle on average
BUNDLE_CELLS = 1 << 18
#: rows of a bundle that are laid out densely at once
DENSE_ROWS = 2048


def _products(tile: int):
    """Products of one bundle: ``ti, tj, at, value`` with ti <= tj and at = i * tile + j inside the tiles."""

    def run(cells: pa.Table) -> pa.Table:
        row = np.unique(cells.column("row_id").to_numpy(), return_inverse=True)[1]
        col, value = cells.column("col_id").to_numpy().astype(np.int64), cells.column("value").to_numpy()
        out = {"ti": [], "tj": [], "at": [], "value": []}
        order = np.lexsort((row, col // tile))
        row, col, value = row[order], col[order], value[order]
        tiles, first = np.unique(col // tile, return_index=True)
        ends = np.append(first[1:], len(col))
        members = [np.unique(row[a:b]) for a, b in zip(first, ends)]
        for x, (a, b) in enumerate(zip(first.tolist(), ends.tolist())):
            for y in range(x, len(tiles)):
                shared = members[x] if x == y else np.intersect1d(members[x], members[y], assume_unique=True)
                if not len(shared):
                    continue
                c, d = int(first[y]), int(ends[y])
                total = np.zeros((tile, tile))
                for s in range(0, len(shared), DENSE_ROWS):
                    some = shared[s : s + DENSE_ROWS]
                    total += _dense(row[a:b], col[a:b] % tile, value[a:b], some, tile).T @ _dense(row[c:d], col[c:d] % tile, value[c:d], some, tile)
                at = np.flatnonzero(total)
                out["ti"].append(int(tiles[x]))
                out["tj"].append(int(tiles[y]))
                out["at"].append(at.astype(np.int32))
                out["value"].append(total.ravel()[at])
        return pa.table(
            {
                "ti": pa.array(out["ti"], pa.int32()), "tj": pa.array(out["tj"], pa.int32()),
                "at": pa.array(out["at"], pa.list_(pa.int32())), "value": pa.array(out["value"], pa.list_(pa.float64())),
            }
        )

    return run


def _dense(row, col, value, rows, tile) -> np.ndarray:
    """The cells of some rows (sorted) of one tile as a dense block."""
    at = np.searchsorted(rows, row)
    at[at == len(rows)] = 0
    mine = rows[at] == row
    block = np.zeros((len(rows), tile))
    block[at[mine], col[mine]] = value[mine]
    return block


def _added(tile: int):
    """Sorted pieces of tile pairs -> one row per pair."""

    def block(key, total):
        at = np.flatnonzero(total)
        return pa.record_batch(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[at]], pa.list_(pa.float64()))],
            names=["ti", "tj", "at", "value"],
        )

    def run(batches):
        key, total = None, np.zeros(tile * tile)
        for batch in batches:
            for ti, tj, at, value in zip(batch.column("ti").to_pylist(), batch.column("tj").to_pylist(), batch.column("at"), batch.column("value")):
                if key != (ti, tj):
                    if key is not None:
                        yield block(key, total)
                    key, total = (ti, tj), np.zeros(tile * tile)
                total[at.values.to_numpy()] += value.values.to_numpy()
        if key is not None:
            yield block(key, total)

    return run


def products_cells(cells: DataFrame, tile: int = TILE, bundle_cells: int = BUNDLE_CELLS) -> DataFrame:
    """``i, j, s`` with i <= j: sums of products of two columns, where they are not zero.

    ``cells``: ``row_id, col_id, value``, each cell at most once; NULL values and zeros are left out.
    """
    kept = cells.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), F.col("value").cast("double").alias("value"))
    kept, _ = stored(kept.filter("value IS NOT NULL AND value <> 0"), "cells")
    n = max(1, -(-kept.count() // bundle_cells))
    bundled = kept.withColumn("bundle", F.pmod(F.xxhash64("row_id"), F.lit(n)))
    pieces = bundled.groupBy("bundle").applyInArrow(_products(tile), "ti INT, tj INT, at ARRAY<INT>, value ARRAY<DOUBLE>")
    sorted_ = pieces.repartition("ti", "tj").sortWithinPartitions("ti", "tj")
    added = sorted_.mapInArrow(_added(tile), "ti INT, tj INT, at ARRAY<INT>, value ARRAY<DOUBLE>")
    each = added.select("ti", "tj", F.explode(F.arrays_zip("at", "value")).alias("x"))
    place = lambda t, inner: (F.col(t) * tile + inner).cast("int")
    rows = each.select(place("ti", F.floor(F.col("x.at") / tile)).alias("i"), place("tj", F.col("x.at") % tile).alias("j"), F.col("x.value").alias("s"))
    return rows.filter("i <= j")


def covariance_cells(cells: DataFrame, n_rows: int, n_cols: int | None = None, tile: int = TILE, bundle_cells: int = BUNDLE_CELLS) -> DataFrame:
    """``i, j, cov`` with i <= j: population covariances of a sparse matrix of ``n_rows`` rows.

    Cells that are not stored are zeros.  With ``n_cols`` all pairs of the columns 0 to
    n_cols - 1 are given (their number is the size of the result); without it only pairs that some row has
    together, the others being - mean_i mean_j.
    """
    n = float(n_rows)
    products = products_cells(cells, tile, bundle_cells)
    if n_cols is not None:
        every = F.explode(F.sequence(F.col("i"), F.lit(n_cols - 1))).alias("j")
        pairs = cells.sparkSession.range(n_cols).select(F.col("id").cast("int").alias("i")).select("i", every)
        products = pairs.join(products, ["i", "j"], "left")
    means, _ = stored(column_sums_cells(cells).select(F.col("col_id").cast("int").alias("col_id"), (F.col("s") / n).alias("m")), "means")
    size = means.count()
    for side in ("i", "j"):
        named = means.select(F.col("col_id").alias(side), F.col("m").alias(f"m{side}"))
        products = join_lookup(products, named, [side], 32, size, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return products.select("i", "j", (zero("s") / n - zero("mi") * zero("mj")).alias("cov"))
