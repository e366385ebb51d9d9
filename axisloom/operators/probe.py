"""The EM round loop and the reconstruction error it reports."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .model import StopRule
from .rows import default_sample_rate, sample_rows
from .stats import l1_errors, l1_ratio

MAX_AHEAD = 16
MAX_AHEAD_BYTES = 1 << 27


@dataclass(frozen=True)
class Round:
    score_map: np.ndarray  # the map of this round's E-step
    loadings: np.ndarray  # the loadings its M-step gave
    noise: float | np.ndarray
    objective: float


@contextmanager
def held(df: DataFrame, persist: bool):
    """The rows, persisted for the time of a fit when asked and not persisted already."""
    if not persist or df.is_cached:
        yield df
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class ErrorProbe:
    """Relative L1 error of rounds, measured on a fixed sample of rows.

    By default all rows are looked at.  A sample that was asked for, by a rate or
    as ``"by_rows"`` (it then shrinks with N to some ten thousand rows), is drawn
    once by row key and kept, so a round reads the sample and not the data.
    A round's error uses scores from its own map and its new loadings; it is None,
    and no reason to stop, when the sample has no rows.
    """

    def __init__(self, df: DataFrame, src, rate: float | str | None):
        if isinstance(rate, str) and rate != "by_rows":
            raise ValueError(f"unknown error_rate {rate!r}; use a share of the rows or 'by_rows'")
        self.rate = default_sample_rate(src.n) if rate == "by_rows" else 1.0 if rate is None else rate
        self.mean = src.mean
        self.absent = (src.n - src.stored) * self.rate
        self.sample = sample_rows(df, self.rate) if self.rate > 0 else None
        self.kept = self.sample is not None and self.rate < 1 and not df.is_cached
        if self.kept:
            self.sample = self.sample.persist(StorageLevel.MEMORY_AND_DISK)

    def ratios(self, rounds: list[Round]) -> list[float | None]:
        """One pass for all given rounds."""
        if self.sample is None:
            return [None] * len(rounds)
        fits = [(r.score_map, r.loadings) for r in rounds]
        err, norm = l1_errors(self.sample, fits, self.mean, self.absent)
        if np.isnan(norm).all():
            warnings.warn(f"no row is in the error sample (rate {self.rate}): no error, and no stop by it", stacklevel=2)
        return [l1_ratio(e, norm) for e in err]

    @staticmethod
    def most(r: Round) -> int:
        """How many rounds one pass may serve: their maps travel with the tasks."""
        return max(1, min(MAX_AHEAD, MAX_AHEAD_BYTES // (16 * r.loadings.size)))

    def close(self) -> None:
        if self.kept:
            self.sample.unpersist()
            self.kept = False


def _take(rounds: Iterator[Round], n: int) -> tuple[list[Round], Exception | None]:
    """Up to ``n`` rounds; a failure after the first is held back until it is reached."""
    taken: list[Round] = []
    try:
        for r in islice(rounds, n):
            taken.append(r)
    except (np.linalg.LinAlgError, ArithmeticError) as e:
        if not taken:
            raise
        return taken, e
    return taken, None


def run_rounds(rounds: Iterator[Round], stop: StopRule, probe: ErrorProbe, src) -> Round:
    """Runs rounds until the stop rule holds and returns the last one.

    The outcome is always that of checking after every round; what differs is
    how the errors are gathered with few passes over the data:

    * no stop by error: errors are filled in afterwards, many rounds per pass;
    * rounds without a pass of their own: computed ahead in growing batches, one
      error pass per batch, and those after the stop are dropped;
    * a pass per round and the error over all rows: the error of a round rides
      along with the pass of the next one;
    * a pass per round and a kept sample: one pass over the sample per round.
    """
    try:
        # an error is never negative
        if stop.error_tol is None or stop.error_tol < 0:
            return _fill_afterwards(rounds, stop, probe)
        if src.passes_per_call and probe.rate == 1:
            return _ride_along(rounds, stop, probe, src)
        return _look_ahead(rounds, stop, probe, src)
    finally:
        probe.close()


def _fill_afterwards(rounds, stop, probe) -> Round:
    waiting: list[Round] = []
    errors: list[float | None] = []
    for r in rounds:
        stopped = stop.record(r.objective)
        waiting.append(r)
        if stopped or len(waiting) == probe.most(r):
            errors += probe.ratios(waiting)
            waiting.clear()
        if stopped:
            stop.history[:] = [(*h[:3], e) for h, e in zip(stop.history, errors)]
            return r
    raise AssertionError("rounds never end by themselves")


def _look_ahead(rounds, stop, probe, src) -> Round:
    ahead = 1
    while True:
        batch, failure = _take(rounds, ahead)
        for r, error in zip(batch, probe.ratios(batch)):
            if stop.record(r.objective, error):
                return r
        if failure:
            raise failure
        if not src.passes_per_call:
            ahead = min(2 * ahead, probe.most(batch[-1]))


def _ride_along(rounds, stop, probe, src) -> Round:
    r = next(rounds)
    while not stop.settled(r.objective):
        src.watch(r.score_map, r.loadings)
        try:
            following = next(rounds)
        except (np.linalg.LinAlgError, ArithmeticError):
            # the round ahead may never have been needed
            if stop.record(r.objective, probe.ratios([r])[0]):
                return r
            raise
        if stop.record(r.objective, l1_ratio(*src.watched)):
            return r
        r = following
    stop.record(r.objective, probe.ratios([r])[0])
    return r
