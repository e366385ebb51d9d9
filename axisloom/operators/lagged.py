"""Covariances between all pairs of series, optionally summed over time lags.

Pairs are never written out as rows.  Series are cut into column tiles and time
into buckets; a task multiplies two tiles of one bucket as matrices and adds the
result to one accumulator per tile pair.  A bucket carries the last few times of
its predecessor, so that lagged partners meet without a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import densify
from ..plans.blocks import dense_block, list_array
from ..plans.budget import BLOCK_CELLS
from ..plans.joins import join_lookup
from ..session import stored

TILE = 512
#: doubles of a task's sums, over all lags: longer windows get smaller tiles
SUMS = 20 * TILE * TILE
#: from this window on all lags come from transforms of a bucket (overlap-save) in place of a product per lag
FFT_WINDOW = 24


def _tile_rows(cells: DataFrame, tile: int) -> DataFrame:
    """``t, tile, y``: the values of one tile at one time, NULL where absent."""
    entry = F.struct((F.col("series") % tile).cast("int").alias("c"), F.col("value").alias("v"))
    rows = (
        cells.withColumn("tile", (F.col("series") / tile).cast("int"))
        .groupBy("t", "tile")
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
    )
    return rows.select("t", "tile", densify("e", tile, "NULL").alias("y"))


def _pair_rows(rows: DataFrame, n_tiles: int, window: int, bucket: int, upper: bool = False) -> DataFrame:
    """Sends each tile row to the tile pairs and buckets that need it.

    ``side``: 1 = left tile, 2 = right tile, 3 = both (a tile paired with itself).
    Left rows stay in their own bucket; right rows are also sent to the next
    bucket when the window reaches into it.
    """
    own = F.floor(F.col("t") / bucket)
    after = F.floor((F.col("t") + window) / bucket)
    own_only = F.array(own)
    reach = F.array_distinct(F.array(own, after))
    if n_tiles == 1:
        pair = rows.select("t", "y", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(3).alias("side"))
    else:
        # a symmetric product needs each pair of tiles once
        first = F.col("tile") if upper else F.lit(0)
        last = F.col("tile") if upper else F.lit(n_tiles - 1)
        left = F.transform(
            F.sequence(first, F.lit(n_tiles - 1)),
            lambda b: F.struct(
                F.col("tile").alias("bi"),
                b.alias("bj"),
                F.when(b == F.col("tile"), 3).otherwise(1).alias("side"),
            ),
        )
        right = F.transform(
            F.filter(F.sequence(F.lit(0), last), lambda b: b != F.col("tile")),
            lambda b: F.struct(b.alias("bi"), F.col("tile").alias("bj"), F.lit(2).alias("side")),
        )
        pair = rows.select("t", "y", F.inline(F.concat(left, right)))
    target = F.when(F.col("side") == 1, own_only).otherwise(reach)
    return pair.select("bi", "bj", F.explode(target).alias("bucket"), "t", "side", "y")


def _accumulator(window: int, bucket: int, tile: int):
    """Task: streams sorted (bi, bj, bucket, t) rows, yields sums per tile pair and lag."""

    def blocks(batches):
        key, held = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                here = tuple(int(v) for v in keys[lo])
                if key is not None and here != key:
                    yield key, held
                    held = []
                key = here
                part = batch.slice(lo, hi - lo)
                y = dense_block(part.column(5), tile)
                held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), y))
        if key is not None:
            yield key, held

    transforms = window >= FFT_WINDOW
    size = 1 << int(np.ceil(np.log2(bucket + window)))

    def add_transformed(acc, at, ta, a, tb, b):
        """Every lag at once: correlations of the bucket with itself and the window before it.

        With the right side shifted by the window, lag l is shift window - l, and shifts
        up to the window never reach round the end of the transform.
        """
        left, right = np.zeros((2, a.shape[1], size)), np.zeros((2, b.shape[1], size))
        seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
        left[0][:, ta - at], left[1][:, ta - at] = seen_a.T, np.where(seen_a, a, 0.0).T
        right[0][:, tb - at + window], right[1][:, tb - at + window] = seen_b.T, np.where(seen_b, b, 0.0).T
        fa, fb = np.conj(np.fft.rfft(left)), np.fft.rfft(right)
        for i in range(a.shape[1]):
            for at_sum, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):  # n, sum a, sum b, sum ab
                found = np.fft.irfft(fa[x, i] * fb[y], size)[:, window::-1]
                acc[:, at_sum, i] += (np.rint(found) if at_sum == 0 else found).T
        return acc

    def add(acc, key, held):
        t, side, y = (np.concatenate([h[i] for h in held]) for i in range(3))
        is_left = ((side & 1) == 1) & (np.floor_divide(t, bucket) == key[2])
        is_right = (side & 2) == 2
        ta, a = t[is_left], y[is_left]
        tb, b = t[is_right], y[is_right]
        if not len(ta) or not len(tb):
            return acc
        if acc is None:
            acc = np.zeros((window + 1, 4, y.shape[1], y.shape[1]))
        if transforms:
            return add_transformed(acc, key[2] * bucket, ta, a, tb, b)
        # missing cells count neither as values nor as observations
        seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
        a, b = np.where(seen_a, a, 0.0), np.where(seen_b, b, 0.0)
        for lag in range(window + 1):
            at = np.searchsorted(tb, ta - lag)
            hit = at < len(tb)
            hit[hit] = tb[at[hit]] == (ta - lag)[hit]
            za, zb = a[hit], b[at[hit]]
            ma, mb = seen_a[hit].astype(float), seen_b[at[hit]].astype(float)
            acc[lag] += np.stack([ma.T @ mb, za.T @ mb, ma.T @ zb, za.T @ zb])
        return acc

    def flush(pair, acc):
        width = acc.shape[2]
        for lag in range(window + 1):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(width, lag, np.int32)),
                    pa.array((pair[0] * tile + np.arange(width)).astype(np.int32)),
                    pa.array(np.full(width, pair[1], np.int32)),
                    *[list_array(sums) for sums in acc[lag]],
                ],
                names=["lag", "i", "bj", "n", "sa", "sb", "sab"],
            )

    def task(batches):
        pair, acc = None, None
        for key, held in blocks(batches):
            if pair is not None and key[:2] != pair and acc is not None:
                yield from flush(pair, acc)
                acc = None
            pair = key[:2]
            acc = add(acc, key, held)
        if acc is not None:
            yield from flush(pair, acc)

    return task


SUMS_SCHEMA = (
    "lag INT, i INT, bj INT, n ARRAY<DOUBLE>, sa ARRAY<DOUBLE>, sb ARRAY<DOUBLE>, sab ARRAY<DOUBLE>"
)


def _pair_sums(
    rows: DataFrame, n_series: int, window: int, tile: int, bucket: int | None, upper: bool = False
) -> DataFrame:
    """``lag, i, j`` with n, sum a, sum b, sum ab over the times both are observed."""
    n_tiles = -(-n_series // tile)
    if bucket is None:
        # a transform of four windows or more wastes at most a quarter on the overlap
        long = (1 << max(10, int(np.ceil(np.log2(4 * window))))) - window if window >= FFT_WINDOW else 0
        bucket = long or max(window, BLOCK_CELLS // tile, 1)
    if bucket < window:
        raise ValueError("a bucket must be at least as long as the window")
    pairs = _pair_rows(rows, n_tiles, window, bucket, upper)
    keys = ["bi", "bj", "bucket"]
    partial = (
        pairs.select(
            F.col("bi").cast("int"), F.col("bj").cast("int"), F.col("bucket").cast("bigint"),
            F.col("t").cast("bigint"), F.col("side").cast("int"), "y",
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys, "t")
        .mapInArrow(_accumulator(window, bucket, tile), SUMS_SCHEMA)
    )
    long = partial.select(
        "lag", "i", "bj", F.posexplode(F.arrays_zip("n", "sa", "sb", "sab")).alias("p", "s")
    ).select("lag", "i", (F.col("bj") * tile + F.col("p")).alias("j"), "s.*")
    sums = long.groupBy("lag", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
    return sums.filter((F.col("i") < n_series) & (F.col("j") < n_series))


def _covariance(ddof: int):
    # NULL where fewer than ddof + 1 common times exist
    n = F.col("n")
    return F.when(n > ddof, (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - ddof))


def lagged_covariance(
    cells: DataFrame,
    window: int,
    n_series: int,
    ddof: int = 1,
    tile: int = TILE,
    bucket: int | None = None,
) -> DataFrame:
    """Sum over lags -w..w of the sample covariance of two series over their overlap.

    Input ``series INT (0..n_series-1), t, value`` with one value per (series,
    t); times may be missing.  Output ``s1, s2, value``.  Only lags >= 0 are
    computed: the covariance of (i, j) at lag -l is that of (j, i) at lag l.

    Long windows get smaller tiles, so a task's sums need the same memory whatever the
    window, and all lags of a bucket come from one transform per series.
    """
    # values near their series' level keep the cross sums small; covariance does not change
    level = cells.groupBy("series").agg(F.avg("value").alias("level"))
    joined = join_lookup(cells, level, ["series"], n_rows=n_series)
    centered = joined.select("series", "t", (F.col("value") - F.col("level")).alias("value"))
    tile = min(tile, n_series, max(1, int(np.sqrt(SUMS / (4 * (window + 1))))))
    rows = _tile_rows(centered, tile)
    sums = _pair_sums(rows, n_series, window, tile, bucket).withColumn("cov", _covariance(ddof))
    both = sums.select(
        "cov",
        F.explode(
            F.when(F.col("lag") == 0, F.array(F.struct("i", "j"))).otherwise(
                F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
            )
        ).alias("p"),
    )
    return both.groupBy(F.col("p.i").alias("s1"), F.col("p.j").alias("s2")).agg(F.sum("cov").alias("value"))


def fill_gaps(cells: DataFrame, n_series: int, fill: float = 0.0) -> DataFrame:
    """Series on a regular grid between the first and the last time, gaps filled.

    Each observed time gives its row; absent times come from a distributed
    range.  Every row has one value per series, so no group is larger than that.
    """
    lo, hi = cells.agg(F.min("t"), F.max("t")).first()
    grid = cells.sparkSession.range(lo, hi + 1).select(F.col("id").alias("t"))
    entry = F.struct(F.col("series").alias("c"), F.col("value").alias("v"))
    rows = cells.groupBy("t").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    rows = grid.join(rows, "t", "left").withColumn(
        "e", F.coalesce("e", F.expr("cast(array() AS array<struct<c:int,v:double>>)"))
    )
    return rows.select(
        "t", F.posexplode(densify("e", n_series, repr(float(fill)) + "D")).alias("series", "value")
    )


def scatter_pairs(df: DataFrame, d: int, ddof: int = 0, tile: int = TILE) -> DataFrame:
    """Covariance of wide dense rows by column tiles; ``i, j, value``."""
    from ..functions import literal_array
    from ..plans.blocks import checked_rows
    from ..plans.moments import column_stats

    stats = column_stats(df, d)
    if np.any(stats.count != stats.n_rows):
        raise ValueError("NULL, NaN or infinite cells: use the fit for missing values")
    origin = literal_array(stats.mean)
    near = df.select(
        F.monotonically_increasing_id().alias("t"),
        F.zip_with(checked_rows("y", d), origin, lambda a, m: a - m).alias("y"),
    )
    # written once: a task that runs again must not number its rows anew
    near, _ = stored(near, "numbered-rows")
    tile = min(tile, d)
    n_tiles = -(-d // tile)
    starts = F.sequence(F.lit(0), F.lit(n_tiles - 1))
    blank = F.expr(f"array_repeat(cast(NULL AS double), {n_tiles * tile - d})")
    rows = near.select("t", F.concat("y", blank).alias("y"), F.explode(starts).alias("tile")).select(
        "t", "tile", F.slice("y", F.col("tile") * tile + 1, F.lit(tile)).alias("y")
    )
    half = _pair_sums(rows, d, 0, tile, None, upper=True).select("i", "j", _covariance(ddof).alias("value"))
    # pairs of different tiles were computed once and hold both ways
    apart = F.floor(F.col("i") / tile) != F.floor(F.col("j") / tile)
    return half.unionAll(half.filter(apart).select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
