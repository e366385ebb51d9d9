"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are counted once by Spark tasks and stored as a
narrow table.  The trees are fitted on a bounded sample of labelled rows and
flattened into arrays; tasks walk all rows through all trees at once with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import drop_stored, stored
from .statistics import COUNTS, MORE, document_counts, feature_batch, features

#: at most so many labelled rows are used for fitting, those of smallest id hash
MAX_TRAIN_ROWS = 20_000
#: crc32(doc_id as text) mod FOLDS = HELD_OUT is never learnt from
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, BINS, RATE, MIN_LEAF, L2 = 120, 4, 64, 0.1, 20, 1.0


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth.

    ``feature`` and ``cut`` have a row per tree and a column per inner node (node i
    has children 2i + 1 and 2i + 2); values above the cut go right.  ``leaf`` has a
    column per leaf.  A node that was not split has cut +inf.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.size - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE, min_leaf=MIN_LEAF, l2=L2
) -> Trees:
    """Second-order boosting of the logistic loss on binned columns.

    No rows give score 0.5 everywhere, rows of one class (nearly) that class.
    """
    n, d = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 0)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)])
    flat = binned + np.arange(d) * bins  # one histogram for all columns
    margin = np.full(n, base)
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)  # place within the level
        for level in range(depth):
            k = 1 << level
            cell = (node[:, None] * (d * bins) + flat).ravel()
            shape = (k, d, bins)
            hist = [
                np.bincount(cell, weights=np.repeat(w, d), minlength=k * d * bins).reshape(shape).cumsum(axis=2)
                for w in (g, h, np.ones(n))
            ]
            total = [a[:, :1, -1:] for a in hist]
            left, right = hist, [t - a for t, a in zip(total, hist)]
            gain = sum(a[0] ** 2 / (a[1] + l2) for a in (left, right)) - total[0] ** 2 / (total[1] + l2)
            gain[(left[2] < min_leaf) | (right[2] < min_leaf)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            f, b = np.divmod(best, bins)
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            first = k - 1
            feature[first : first + k] = np.where(good, f, 0)
            cut[first : first + k] = [cuts[fi][bi] if ok and bi < len(cuts[fi]) else np.inf for fi, bi, ok in zip(f, b, good)]
            goes_right = x[np.arange(n), feature[first + node]] > cut[first + node]
            node = 2 * node + goes_right
        sums = [np.bincount(node, weights=w, minlength=inner + 1) for w in (g, h)]
        leaf = -rate * sums[0] / (sums[1] + l2)
        margin += leaf[node]
        out_f.append(feature)
        out_c.append(cut)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_c), np.array(out_l), base)


def remainder(doc_id):
    """crc32(doc_id as text) mod FOLDS; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


#: labelled rows beyond ``max_rows`` that the first, rough choice takes along
SPARE = 1.05


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, counted):
    """(ids, counts, labels) of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows of smallest id hash are taken, so the sample is the same on every run.
    ``counted(some)`` gives the counts of the rows of ``docs`` whose id is in ``some``.
    Ids are counted and cut at a hash first: what is counted, sorted by one task and
    brought to the driver is bounded by ``max_rows``, whatever the number of partitions.
    """
    known = labels.filter(remainder(F.col("doc_id")) != HELD_OUT).filter(F.col(label).isNotNull())
    known = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(known, "doc_id").select("doc_id", F.xxhash64("doc_id").alias("_hash"), "_label")
    ids, path = stored(ids, "labelled-ids")
    n = ids.count()
    cut, share = (1 << 63) - 1, SPARE * max_rows / max(n, 1)
    while n > max_rows and share < 1:
        cut = int(-(1 << 63) + share * (1 << 64))
        if ids.filter(F.col("_hash") <= cut).count() >= max_rows:
            break
        share, cut = share * 2, (1 << 63) - 1
    some = F.broadcast(ids.filter(F.col("_hash") <= cut).select("doc_id").distinct())  # about max_rows ids at most
    rows = counted(some).join(F.broadcast(known.join(some, "doc_id", "left_semi")), "doc_id").withColumn("_hash", F.xxhash64("doc_id"))
    one = rows.repartition(1).sortWithinPartitions("_hash", "doc_id", *COUNTS, *MORE, "_label")
    rows = one.limit(max_rows).toPandas()
    drop_stored(docs.sparkSession, path)
    return rows["doc_id"].to_numpy(), {c: rows[c].to_numpy() for c in (*COUNTS, *MORE)}, rows["_label"].to_numpy()


def of_counts(counts: DataFrame):
    """``counted`` for statistics that are stored already."""
    return lambda some: counts.join(some, "doc_id", "left_semi")


def of_texts(docs: DataFrame):
    """``counted`` for texts: only those of the sample are counted."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return lambda some: document_counts(plain.join(some, "doc_id", "left_semi"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int, counted) -> Trees:
    _, found, y = labelled_sample(docs, labels, "quality", max_rows, counted)
    return fit_trees(features(found), y.astype(np.float64))


def score_counts(counts: DataFrame, trees: Trees) -> DataFrame:
    def run(batches):
        for batch in batches:
            score = trees.score(feature_batch(batch))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return counts.mapInArrow(run, "doc_id BIGINT, score DOUBLE, predicted INT")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document.

    Nulls and empty texts are scored like any text without words.  Equal texts
    get equal scores; a null id is never held out.  Without labels every score is
    0.5.  Labels, lang, source and doc_id are no inputs.
    """
    counts, _ = stored(document_counts(docs), "counts")
    scored = score_counts(counts, train(counts, labels, max_rows, of_counts(counts)))
    held = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The documents predicted to be good, all columns as they were."""
    trees = train(docs, labels, max_rows, of_texts(docs))

    def run(batches):
        from .statistics import text_counts
        from .words import slices

        for batch in batches:
            keep = [
                trees.score(features(text_counts(data, offsets))) >= 0.5
                for _, _, data, offsets in slices(batch.column("text"))
            ]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
