"""Probabilistic PCA for matrices with missing cells.

For a fixed set of missing columns a row's score is one linear map of its observed
values, the same for all rows with that pattern.  Sums of products per pattern are
therefore all that the rounds need: with few patterns (complete data has one) the
data is read once.  With many patterns every round is a pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.blocks import dense_block, flat_sum, iter_blocks, list_array, width
from ..plans.budget import BLOCK_CELLS
from ..plans.moments import column_stats, score_square
from ..session import drop_stored, stored
from .model import FactorModel, Start, StopRule, start_values
from .rotate import ordered_axes, orthonormal
from .rows import clip_infinite, keep_observed_columns

NOISE_TERMS = ("exact", "reference")
ROUNDING = 1e-14
#: patterns are used up to so many, and so many numbers in their products
MAX_PATTERNS, MAX_PATTERN_CELLS = 256, 1 << 22
#: beyond so many numbers the residual takes a pass of its own
MAX_MASKED_MOMENTS = 1 << 23


# --- few patterns ---------------------------------------------------------------


def pattern_column(d: int):
    """Which cells are missing, as a string of 0 and 1."""
    return F.array_join(F.transform("y", lambda v: F.when(v.isNull() | F.isnan(v), "1").otherwise("0")), "")


def few_patterns(df: DataFrame, d: int) -> np.ndarray | None:
    """The distinct patterns as rows of booleans, or None when there are too many."""
    most = min(MAX_PATTERNS, MAX_PATTERN_CELLS // (d * d))
    if most < 1:
        return None
    found = df.select(pattern_column(d).alias("p")).distinct().limit(most + 1).collect()
    if len(found) > most:
        return None
    return np.array([[c == "1" for c in r.p] for r in sorted(found)], dtype=bool).reshape(len(found), d)


@dataclass
class Patterns:
    """Sums per pattern and the maps from observed values to scores and filled rows.

    ``g[p]`` is the sum of z z' with missing cells 0, ``s[p]`` the sum of z.  With z such
    a row, its score is z ``a[p]`` and its filled row z ``f[p]``.
    """

    missing: np.ndarray  # P x d
    n: np.ndarray
    s: np.ndarray
    g: np.ndarray
    a: np.ndarray | None = None
    f: np.ndarray | None = None

    @classmethod
    def of_rows(cls, df: DataFrame, missing: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> "Patterns":
        n_patterns, d = missing.shape
        numbers = {m.tobytes(): i for i, m in enumerate(missing)}

        def accumulate(batches):
            out = {"n": np.zeros(n_patterns), "s": np.zeros((n_patterns, d)), "g": np.zeros((n_patterns, d, d))}
            for block in iter_blocks(batches, d):
                gaps = np.isnan(block)
                z = np.where(gaps, 0.0, (block - mean) / scale)
                kinds, which = np.unique(gaps, axis=0, return_inverse=True)
                for k, mask in enumerate(kinds):
                    part, p = z[which.ravel() == k], numbers[mask.tobytes()]
                    out["n"][p] += len(part)
                    out["s"][p] += part.sum(axis=0)
                    out["g"][p] += part.T @ part
            return out

        shapes = {"n": (n_patterns,), "s": (n_patterns, d), "g": (n_patterns, d, d)}
        r = flat_sum(df.select("y"), shapes, accumulate)
        return cls(missing, r["n"], r["s"], r["g"])

    def begin(self, first: np.ndarray) -> None:
        seen = ~self.missing[:, :, None]
        self.a = np.where(seen, first, 0.0)
        self.f = np.where(seen, np.eye(len(first)), 0.0)

    def step(self, loadings: np.ndarray, score_map: np.ndarray) -> None:
        """Missing cells from the scores so far, then new scores from the filled rows."""
        seen = np.eye(len(loadings)) * ~self.missing[:, None, :]
        self.f = seen + np.where(self.missing[:, None, :], self.a @ loadings.T, 0.0)
        self.a = self.f @ score_map

    def sums(self) -> dict[str, np.ndarray]:
        gf, ga = self.g @ self.f, self.g @ self.a
        filled = np.einsum("pij,pij->pj", self.f, gf)
        return {
            "dx": np.einsum("pij,pik->jk", self.f, ga),
            "xx": np.einsum("pij,pik->jk", self.a, ga),
            "filled2": np.array([filled[self.missing].sum()]),
        }

    def residual2(self, loadings: np.ndarray) -> float:
        """Squared reconstruction error over the observed cells."""
        ga = self.g @ self.a
        cross = np.einsum("pij,ij->", ga, loadings)
        axa = np.einsum("pij,pik->pjk", self.a, ga)
        fitted = np.einsum("dj,pjk,dk->pd", loadings, axa, loadings)[~self.missing].sum()
        z2 = float(np.einsum("pii->", self.g))
        return max(z2 - 2 * float(cross) + float(fitted), ROUNDING * z2)

    def projections(self, q: np.ndarray) -> dict[str, np.ndarray]:
        data = np.einsum("pij,pik->jk", self.f, self.g @ self.f)
        s = np.einsum("pi,pij->j", self.s, self.f)
        return {"s": s, "q": np.diag(data).copy(), "p": s @ q, "pp": q.T @ data @ q}


@dataclass
class PatternRows:
    """Rows with the final maps of their patterns."""

    df: DataFrame
    mean: np.ndarray
    scale: np.ndarray
    patterns: Patterns

    def blocks(self):
        """Function: batch -> (batch part, filled data) per bounded block."""
        mean, scale, d = self.mean, self.scale, len(self.mean)
        maps = {m.tobytes(): f for m, f in zip(self.patterns.missing, self.patterns.f)}

        def walk(batches):
            step = max(1, BLOCK_CELLS // d)
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    block = dense_block(part.column(1), d)
                    gaps = np.isnan(block)
                    z = np.where(gaps, 0.0, (block - mean) / scale)
                    kinds, which = np.unique(gaps, axis=0, return_inverse=True)
                    data = z
                    for k, mask in enumerate(kinds):
                        if mask.any():
                            rows = which.ravel() == k
                            data[rows] = z[rows] @ maps[mask.tobytes()]
                    yield part, data

        return walk

    def close(self) -> None:
        pass


# --- many patterns ----------------------------------------------------------------


@dataclass
class _State:
    """Rows plus what is needed to bring their scores up to date.

    The score of a row depends on its score of the round before.  Instead of
    writing new scores every round, a task replays the rounds since the last
    checkpoint; their parameters have model size and travel with the task.
    A checkpoint holds the rows with gaps only: complete rows need no memory.
    """

    source: DataFrame  # row_id, y
    df: DataFrame  # row_id, y (raw) and, after a checkpoint, x for rows with gaps
    mean: np.ndarray
    scale: np.ndarray
    k: int
    first: np.ndarray | None  # start map, until the first checkpoint
    rounds: list  # (loadings, score map) since the last checkpoint
    path: str | None = None  # where the checkpoint is stored

    def walk_all(self):
        """Function: batch -> (batch part, z with NaN, mask, filled data, scores) per bounded block."""
        d, k, mean, scale = len(self.mean), self.k, self.mean, self.scale
        first, rounds = self.first, list(self.rounds)

        def walk(batches):
            step = max(1, BLOCK_CELLS // max(d, k))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    z = (dense_block(part.column(1), d) - mean) / scale
                    missing = np.isnan(z)
                    data = np.where(missing, 0.0, z)
                    gaps = missing.any(axis=1)
                    if first is not None:
                        x = data @ first
                    else:
                        x = np.zeros((len(z), k))
                        x[gaps] = dense_block(part.column(2).filter(pa.array(gaps)), k)
                    if rounds:
                        # complete rows depend on the newest round only
                        seen, at_gaps, x = z[gaps], missing[gaps], x[gaps]
                        for loadings, score_map in rounds:
                            filled = np.where(at_gaps, x @ loadings.T, seen)
                            x = filled @ score_map
                        data[gaps] = filled
                        x = data @ rounds[-1][1]
                    yield part, z, missing, data, x

        return walk

    def blocks(self):
        walk = self.walk_all()

        def filled(batches):
            for part, _, _, data, _ in walk(batches):
                yield part, data

        return filled

    def advanced(self) -> "_State":
        """Writes the scores of rows with gaps to the shared folder and forgets the rounds."""
        walk = self.walk_all()
        field = T.StructField("x", T.ArrayType(T.DoubleType()))
        schema = T.StructType([self.source.schema["row_id"], self.source.schema["y"], field])

        def task(batches):
            for part, _, missing, _, x in walk(batches):
                gaps = missing.any(axis=1)
                keep = pa.array(gaps)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(keep), part.column(1).filter(keep), list_array(x[gaps])], names=["row_id", "y", "x"]
                )

        with_gap = F.exists("y", lambda v: v.isNull() | F.isnan(v))
        kept, path = stored(self.df.filter(with_gap).mapInArrow(task, schema), "scores")
        self.close()
        whole = self.source.filter(~with_gap).select("row_id", "y", F.lit(None).cast("array<double>").alias("x"))
        return _State(self.source, whole.unionAll(kept), self.mean, self.scale, self.k, None, [], path)

    def close(self) -> None:
        """Removes the stored scores; the fit's rows can no longer be read then."""
        if self.path is not None:
            drop_stored(self.df.sparkSession, self.path)
            self.path = None


class _Passes:
    """The rounds' sums from passes over the rows; same calls as ``Patterns``."""

    def __init__(self, df, mean, scale, k, checkpoint_every, n_missing):
        self.state = _State(df, df, mean, scale, k, None, [])
        self.every, self.n_missing = checkpoint_every, n_missing
        self.masked = len(mean) * k * k <= MAX_MASKED_MOMENTS

    def begin(self, first: np.ndarray) -> None:
        self.state.first = first
        self._sums = None

    def step(self, loadings, score_map) -> None:
        if self.n_missing and len(self.state.rounds) >= self.every:
            self.state = self.state.advanced()
        elif not self.n_missing:
            # without gaps a score depends on the current parameters only
            self.state.rounds = []
        self.state.rounds.append((loadings, score_map))
        self._sums = None

    def sums(self) -> dict[str, np.ndarray]:
        """One pass: moments of filled data and scores, and what the residual needs.

        The squared residual over observed cells follows from sums alone: cells that
        are missing enter through ``miss``, the masked second moments of the scores.
        """
        state, masked = self.state, self.masked
        d, k = len(state.mean), state.k
        walk = state.walk_all()
        shapes = {"dx": (d, k), "zx": (d, k), "filled2": (1,), "z2": (1,)}
        if masked:
            shapes["miss"] = (d, k * k)

        def accumulate(batches):
            s = {name: np.zeros(shape) for name, shape in shapes.items()}
            for _, z, missing, data, x in walk(batches):
                s["dx"] += data.T @ x
                observed = np.where(missing, 0.0, z)
                s["zx"] += observed.T @ x
                s["z2"] += np.sum(observed**2)
                s["filled2"] += np.sum(data[missing] ** 2)
                gaps = np.flatnonzero(missing.any(axis=1))
                step = max(1, BLOCK_CELLS // (k * k))
                for at in range(0, len(gaps) if masked else 0, step):
                    some = gaps[at : at + step]
                    pairs = (x[some, :, None] * x[some, None, :]).reshape(-1, k * k)
                    s["miss"] += missing[some].astype(float).T @ pairs
            return s

        sums = flat_sum(state.df, shapes, accumulate)
        # scores are filled data times the newest map
        newest = state.rounds[-1][1] if state.rounds else state.first
        sums["xx"] = score_square(newest, sums["dx"])
        self._sums = sums
        return sums

    def residual2(self, loadings) -> float:
        """Squared reconstruction error over the observed cells.

        The sums cancel when as many components as columns leave no residual; what
        remains then is rounding, so the result is kept above that level.
        """
        if not self.masked:
            return self._residual_pass(loadings)
        sums, k = self._sums or self.sums(), loadings.shape[1]
        fitted = np.sum(sums["xx"] * (loadings.T @ loadings))
        at_missing = np.sum(sums["miss"] * (loadings[:, :, None] * loadings[:, None, :]).reshape(-1, k * k))
        z2 = float(sums["z2"][0])
        return max(float(z2 - 2 * np.sum(loadings * sums["zx"]) + fitted - at_missing), ROUNDING * z2)

    def _residual_pass(self, loadings) -> float:
        walk = self.state.walk_all()

        def accumulate(batches):
            r, z2 = 0.0, 0.0
            for _, z, missing, _, x in walk(batches):
                r += float(np.sum(np.where(missing, 0.0, x @ loadings.T - z) ** 2))
                z2 += float(np.sum(np.where(missing, 0.0, z) ** 2))
            return {"r": np.array([r]), "z2": np.array([z2])}

        s = flat_sum(self.state.df, {"r": (1,), "z2": (1,)}, accumulate)
        return max(float(s["r"][0]), ROUNDING * float(s["z2"][0]))

    def projections(self, q) -> dict[str, np.ndarray]:
        d, k = q.shape
        walk = self.state.blocks()

        def accumulate(batches):
            s = {"s": np.zeros(d), "q": np.zeros(d), "p": np.zeros(k), "pp": np.zeros((k, k))}
            for _, data in walk(batches):
                s["s"] += data.sum(axis=0)
                s["q"] += np.einsum("ij,ij->j", data, data)
                p = data @ q
                s["p"] += p.sum(axis=0)
                s["pp"] += p.T @ p
            return s

        return flat_sum(self.state.df, {"s": (d,), "q": (d,), "p": (k,), "pp": (k, k)}, accumulate)


# --- the rounds --------------------------------------------------------------------


def missing_rounds(source, loadings, n: int, n_missing: int, stop: StopRule, noise_term: str = "exact"):
    """EM rounds on ``Patterns`` or passes until ``stop`` holds: (loadings, noise)."""
    d, k = loadings.shape
    cc = loadings.T @ loadings
    source.begin(loadings @ np.linalg.inv(cc))
    ss = source.residual2(loadings) / (n * d - n_missing)
    while True:
        sx = np.linalg.inv(np.eye(k) + cc / ss)
        before = ss
        source.step(loadings, loadings @ sx / ss)
        sums = source.sums()
        xx = sums["xx"]
        loadings = sums["dx"] @ np.linalg.pinv(xx + n * sx)
        cc = loadings.T @ loadings
        residual2 = source.residual2(loadings)
        if noise_term == "reference":
            residual2 += float(sums["filled2"][0])
        ss = (residual2 + n * np.sum(cc * sx) + n_missing * before) / (n * d)
        objective = (
            n * (d * np.log(ss) + np.trace(sx) - np.linalg.slogdet(sx)[1])
            + np.trace(xx)
            - n_missing * np.log(before)
        )
        if stop.record(float(objective)):
            return loadings, ss


@dataclass(frozen=True)
class MissingFit:
    """The model and its rows; ``close`` removes what the fit has kept for them."""

    model: FactorModel
    state: PatternRows | _State
    n_missing: int
    held: DataFrame | None = None

    def close(self) -> None:
        self.state.close()
        if self.held is not None:
            self.held.unpersist()

    def scores(self) -> DataFrame:
        """Filled z-scored rows projected on the canonical axes: ``row_id, x``."""
        axes = self.model.axes
        return self._rows("x", lambda data: data @ axes)

    def filled(self) -> DataFrame:
        """Rows in the input's units with missing cells filled: ``row_id, y``."""
        mean, scale = self.model.mean, self.model.scale
        return self._rows("y", lambda data: data * scale + mean)

    def _rows(self, name, fn) -> DataFrame:
        walk = self.state.blocks()
        schema = T.StructType(
            [self.state.df.schema["row_id"], T.StructField(name, T.ArrayType(T.DoubleType()))]
        )

        def task(batches):
            for part, data in walk(batches):
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(fn(data))], names=["row_id", name])

        return self.state.df.mapInArrow(task, schema)


def ppca_missing_fit(
    df: DataFrame,
    k: int | None = None,
    *,
    tol: float = 1e-4,
    min_obs: float = -1e3,
    max_iter: int | None = None,
    noise_term: str = "exact",
    init: Start | int | None = None,
    checkpoint_every: int = 20,
    d: int | None = None,
    persist: bool = False,
) -> MissingFit:
    """PPCA on z-scored rows; NULL and NaN cells are refilled from the model every round.

    Infinite cells become the largest finite value; columns with fewer than
    ``min_obs`` observed cells are left out; ``k`` defaults to a fifth of the
    columns.  With many patterns of missing cells scores are stored every
    ``checkpoint_every`` rounds and replayed in between.  Stops when the objective
    changes by less than ``tol`` relatively, after seven rounds at the earliest; without
    ``max_iter`` a fit that never settles never ends.  ``persist`` keeps the rows in memory
    and on local disk until the fit is closed.
    The residual counts observed cells
    only; ``noise_term="reference"`` also counts the filled values squared.
    """
    if noise_term not in NOISE_TERMS:
        raise ValueError(f"unknown noise_term {noise_term!r}; use one of {NOISE_TERMS}")
    df = df.select("row_id", "y")
    d = width(df, d)
    stats = column_stats(df, d)
    if not np.all(np.isfinite(stats.var_pop[stats.count > 0])):
        df = clip_infinite(df)
        stats = column_stats(df, d)
    df, kept = keep_observed_columns(df, min_obs, stats)
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    count, mean, scale = stats.count[kept], stats.mean[kept], stats.std_pop[kept]
    if np.any(count == 0) or np.any(~(scale > 0)):
        raise ValueError("columns without observed values or without variance; raise min_obs or drop them")
    n, d = stats.n_rows, len(kept)
    n_missing = int(n * d - count.sum())
    k = round(0.2 * d) if k is None else k
    loadings, _ = start_values(d, k, init, per_column=False, dist="normal")

    stop = StopRule(max_iter, tol, relative=True, min_rounds=6)
    patterns = few_patterns(df, d)
    if patterns is not None:
        source = Patterns.of_rows(df, patterns, mean, scale)
    else:
        source = _Passes(df, mean, scale, k, checkpoint_every, n_missing)
    loadings, ss = missing_rounds(source, loadings, n, n_missing, stop, noise_term)
    rows = PatternRows(df, mean, scale, source) if patterns is not None else source.state
    q = orthonormal(loadings)
    axes, values, var_exp = along_axes(source.projections(q), q, n)
    model = FactorModel(
        "ppca_missing", loadings, mean, np.full(d, ss), n, scale=scale, history=tuple(stop.history), axes=axes,
        eigenvalues=values, var_exp=var_exp, columns=None if len(kept) == stats.d else tuple(kept),
    )
    return MissingFit(model, rows, n_missing, df if persist else None)


def along_axes(r: dict, q: np.ndarray, n: int):
    """(axes, eigenvalues, cumulative shares) from the filled rows' projections on q."""
    total = float(np.sum(r["q"] / n - (r["s"] / n) ** 2))
    axes, values = ordered_axes(q, (r["pp"] - np.outer(r["p"], r["p"]) / n) / (n - 1))
    return axes, values, np.cumsum(values) / total
