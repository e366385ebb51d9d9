"""Quality rules: base limits, and an isolation forest over rule statistics.

Random splits isolate odd rows early: the mean path length over many trees is an
anomaly score.  Every document that passes the base rules is dealt to one tree or more,
and all trees grow by a level per pass over the rows.  The threshold is chosen on all
labelled rows; tasks walk all rows through flat arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import drop_stored, stored
from .quality import HELD_OUT, remainder
from .statistics import COUNTS, FEATURES, MORE, document_counts, feature_batch, features

#: trees, and rows that each of them learns from at least, if there are so many
TREES, SAMPLE = 200, 256
#: statistics whose odd values rules look at; lengths are left out, long texts are not odd
RULES = ("word_len", "symbols", "dup_lines", "repeats", "upper", "bars", "bangs", "short", "stops", "long", "words_per_line")
#: at most this share of the labelled good rows may fall beyond the threshold
MAX_GOOD_LOST = 0.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def average_path(n):
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    more = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, more, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Flat complete trees: a row per tree, a column per node; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray  # path length at a leaf
    depth: int
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-path / normal): 0.5 is ordinary, towards 1 is odd."""
        if not len(self.feature):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                below = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= cut[node])
                node = np.where(f >= 0, below, node)
            total += path[node]
        return np.exp2(-total / len(self.feature) / self.normal)


class Ranges:
    """What the nodes of a level hold: rows, and the least and largest value of each statistic."""

    def __init__(self, nodes: int, d: int):
        self.rows = np.zeros(nodes, dtype=np.int64)
        self.low, self.high = np.full((d, nodes), np.inf), np.full((d, nodes), -np.inf)

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        self.rows += np.bincount(at, minlength=len(self.rows))
        for j in range(x.shape[1]):
            np.minimum.at(self.low[j], at, x[:, j])
            np.maximum.at(self.high[j], at, x[:, j])


def uses_of(n: int, trees: int, sample: int) -> int:
    """How many trees learn from each of n rows: all rows are used, and a tree sees ``sample`` of them at least, if there are so many."""
    return min(trees, max(1, -(-trees * sample // max(n, 1))))


def trees_of(hashes: np.ndarray, trees: int, uses: int) -> np.ndarray:
    """uses x rows: different trees for each row, a + j * b with b prime to the number of trees."""
    units = np.array([b for b in range(trees) if np.gcd(b, trees) == 1])
    first, step = hashes % trees, units[hashes // trees % len(units)]
    return (first + np.arange(uses)[:, None] * step) % trees


def add_level(held: Ranges, forest: Forest, level: int, x: np.ndarray, tree: np.ndarray) -> None:
    """Adds rows to the nodes of a level that they reach in one tree each."""
    first = (1 << level) - 1
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(level):
        f = forest.feature[tree, node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= forest.cut[tree, node]), node)
    here = node >= first
    held.add((tree * (first + 1) + node - first)[here], x[here])


def grow(n: int, trees: int, sample: int, seed: int, ranges) -> Forest:
    """A forest grown level by level; ``ranges(forest, level)`` tells what the nodes of a level hold.

    A node with a varying statistic is split at a random place of a random one of them.  Trees
    end at the depth that ``sample`` rows need; the rows in a leaf give the rest of its path.
    """
    depth = int(np.ceil(np.log2(max(min(sample, n), 2))))
    nodes = (1 << (depth + 1)) - 1
    per_tree = n * uses_of(n, trees, sample) / trees
    if not n:
        trees = 0
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    forest = Forest(feature, cut, path, depth, float(average_path(max(per_tree, 2))))
    rng = np.random.default_rng(seed)
    for level in range(depth + 1 if trees else 0):
        width = 1 << level
        here = slice(width - 1, 2 * width - 1)
        which, where = rng.random((2, trees * width))
        held = ranges(forest, level)
        path[:, here] = np.where(held.rows > 0, level + average_path(held.rows), 0).reshape(trees, width)
        varies = held.high > held.low
        if level == depth or not varies.any():
            break
        # the chosen one of the statistics that vary
        chosen = ((varies.cumsum(axis=0) > (which * varies.sum(axis=0)).astype(np.int64)) & varies).argmax(axis=0)
        at = np.flatnonzero(varies.any(axis=0))
        f = chosen[at]
        low, high = held.low[f, at], held.high[f, at]
        between = np.minimum(low + where[at] * (high - low), high)
        tree, node = at // width, at % width + width - 1
        feature[tree, node], cut[tree, node] = f, np.where(between > low, between, high)
        path[tree, node] = 0
    return forest


def fit_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 0, hashes: np.ndarray | None = None) -> Forest:
    """The forest of rows in memory; ``hashes`` deal them to the trees."""
    n, d = x.shape
    if hashes is None:
        hashes = np.random.default_rng(seed).integers(0, 1 << 62, n)

    def ranges(forest, level):
        held = Ranges(trees << level, d)
        for tree in trees_of(hashes, trees, uses_of(n, trees, sample)):
            add_level(held, forest, level, x, tree)
        return held

    return grow(n, trees, sample, seed, ranges)


def threshold(score: np.ndarray, good: np.ndarray, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The score beyond which rows are dropped.

    Of all cuts that lose at most a share of the good rows, the one with the largest gain
    of bad over good shares.  Without rows of both kinds nothing is dropped.
    """
    if not good.any() or good.all():
        return np.inf
    cuts = np.unique(score)
    lost_good = 1 - np.searchsorted(np.sort(score[good]), cuts, side="right") / good.sum()
    lost_bad = 1 - np.searchsorted(np.sort(score[~good]), cuts, side="right") / (~good).sum()
    gain = np.where(lost_good <= max_good_lost, lost_bad - lost_good, -1)
    best = int(gain.argmax())
    return float(cuts[best]) if gain[best] > 0 else np.inf


COLUMNS = [FEATURES.index(r) for r in RULES]


def rule_verdicts(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly``.

    A null text is empty, and an empty text fails the base rules.  Without labels, or
    with labels of one kind, the base rules alone decide.  The forest is fitted on all
    documents that pass the base rules, the threshold on all of them that have a label
    outside the held-out fold.  Equal texts get equal verdicts.
    """
    counts, path = stored(document_counts(docs), "counts")
    scored, _ = stored(scores(counts, fit_rules(counts, trees, sample)), "scores")
    drop_stored(docs.sparkSession, path)
    limit = fit_threshold(scored, labels)
    kept = ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")


def base_failed(c):
    """Of numpy arrays or of columns, by name."""
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def fit_rules(counts: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """The forest of all rows that pass the base rules.

    A pass over the rows per level of the trees: tasks add up what the nodes hold, one row per
    node and task, and the driver gets one row per node.
    """
    facts = (*COUNTS, *MORE)
    passed = counts.filter(~base_failed({x: F.col(x) for x in COUNTS}))
    n, d = passed.count(), len(COLUMNS)
    hashed = passed.select(*facts, F.xxhash64("doc_id", *facts).alias("_hash"))
    lows, highs = [f"low{j}" for j in range(d)], [f"high{j}" for j in range(d)]
    names = ["node", "n", *lows, *highs]
    schema = ", ".join(f"{x} {'BIGINT' if x in ('node', 'n') else 'DOUBLE'}" for x in names)
    uses = uses_of(n, trees, sample)

    def ranges(forest: Forest, level: int) -> Ranges:
        def run(batches):
            held = Ranges(trees << level, d)
            for batch in batches:
                x = feature_batch(batch)[:, COLUMNS]
                for tree in trees_of(batch.column("_hash").to_numpy(), trees, uses):
                    add_level(held, forest, level, x, tree)
            at = np.flatnonzero(held.rows)
            yield pa.record_batch([pa.array(v) for v in (at, held.rows[at], *held.low[:, at], *held.high[:, at])], names=names)

        sums = [F.sum("n").alias("n"), *(F.min(x).alias(x) for x in lows), *(F.max(x).alias(x) for x in highs)]
        found = hashed.mapInArrow(run, schema).groupBy("node").agg(*sums).toArrow()
        held, at = Ranges(trees << level, d), found.column("node").to_numpy()
        held.rows[at] = found.column("n").to_numpy()
        for j in range(d):
            held.low[j, at], held.high[j, at] = (found.column(x).to_numpy() for x in (lows[j], highs[j]))
        return held

    return grow(n, trees, sample, 0, ranges)


def fit_threshold(scored: DataFrame, labels: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """What ``threshold`` gives for all labelled rows that pass the base rules, in two levels.

    Scores are dealt by ranges; a range counts on from the sums of those before it.
    """
    known = labels.filter(remainder(F.col("doc_id")) != HELD_OUT).filter(F.col("quality").isNotNull())
    good = (F.col("quality").cast("int") == 1).cast("bigint")
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    counted = scored.filter(~F.col("base_failed")).select("doc_id", "anomaly").join(known, "doc_id").groupBy("anomaly").agg(*sums)
    dealt, path = stored(counted.repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()), "score-counts")
    parts = dealt.groupBy("part").agg(*sums, F.min("anomaly").alias("least"))
    total = parts.agg(*sums).first()
    limit = np.inf
    if total.good and total.bad:
        before = Window.orderBy("least")
        base = parts.select("part", *((F.sum(x).over(before) - F.col(x)).alias(f"{x}_before") for x in ("good", "bad")))
        within = Window.partitionBy("part").orderBy("anomaly")
        up_to = dealt.select("part", "anomaly", *(F.sum(x).over(within).alias(x) for x in ("good", "bad"))).join(F.broadcast(base), "part")
        lost = [1 - (F.col(x) + F.col(f"{x}_before")) / F.lit(total[x]) for x in ("good", "bad")]
        gains = up_to.select("anomaly", F.when(lost[0] <= max_good_lost, lost[1] - lost[0]).otherwise(-1).alias("gain"))
        best = gains.orderBy(F.desc("gain"), "anomaly").first()
        limit = best.anomaly if best.gain > 0 else np.inf
    drop_stored(scored.sparkSession, path)
    return float(limit)


def scores(counts: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, the exact counts, ``base_failed`` and ``anomaly`` of every row."""

    def run(batches):
        for batch in batches:
            failed = base_failed({x: batch.column(x).to_numpy(zero_copy_only=False) for x in COUNTS})
            odd = forest.score(feature_batch(batch)[:, COLUMNS])
            yield pa.record_batch(
                [batch.column("doc_id"), *(batch.column(x) for x in COUNTS), pa.array(failed), pa.array(odd)],
                names=["doc_id", *COUNTS, "base_failed", "anomaly"],
            )

    return counts.mapInArrow(run, f"doc_id BIGINT, {', '.join(f'{x} BIGINT' for x in COUNTS)}, base_failed BOOLEAN, anomaly DOUBLE")
