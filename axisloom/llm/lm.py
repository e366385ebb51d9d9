"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Count tables are partitioned by hash; the n-grams of the documents meet them there
(``lookup``), and scores are summed per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lookup import with_counts
from .words import SPACE, Words, mix, slices, window_hashes

ORDER = 2
ALPHA = 0.4
#: n-grams of two and more words seen less often are left out of the tables
MIN_COUNT = 2
#: stands for the number of words of the corpus
ALL_WORDS = np.uint64(0)


def _grams_of(column: pa.ChunkedArray, order: int):
    """Per slice: (first document, words per document, [(hashes, starts)] by length, documents of words)."""
    for a, b, data, offsets in slices(column):
        words = Words(data, offsets, SPACE)
        by = [(mix(words.hash + np.uint64(1)), np.arange(len(words)))]
        by += [window_hashes(words.hash, words.doc, n) for n in range(2, order + 1)]
        yield a, words.count, by, words.doc


def backoff_scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT
) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score, score`` per document.

    A word scores count(context + word) / count(context) for the longest context (up to
    ``order - 1`` words of the document) whose n-gram stands at least ``min_count`` times
    in the corpus, times ``alpha`` for each word the context was cut by; without
    context it is count(word) / all words.  ``log_score`` sums the logarithms, ``score`` is
    their mean.  Texts without words (or null) have log_score 0 and score null.
    Words are runs without white space, unchanged.  Every row counts, copies too.
    """

    def grams(docs: pa.Table):
        found, n_words = [], 0
        for _, count, by, _ in _grams_of(docs.column("text"), order):
            n_words += int(count.sum())
            found += [h for h, _ in by]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64),) * 2
        if n_words:
            hashes = np.concatenate(([ALL_WORDS], hashes))
            counts = np.concatenate(([n_words], counts))
        return hashes, counts

    def use(docs: pa.Table, hashes: np.ndarray, totals: np.ndarray) -> pa.Table:
        n_words, backed, log_score = [], [], []
        with np.errstate(divide="ignore"):
            logs = np.log(totals)
        for _, count, by, doc in _grams_of(docs.column("text"), order):
            single = np.searchsorted(hashes, by[0][0])
            if len(doc):
                value = logs[single] - logs[0]
            else:
                value = np.empty(0)
            length = np.ones(len(doc), dtype=np.int64)
            below = single  # entry of the context: the n-gram one shorter, a word earlier
            below_starts = by[0][1]
            for n in range(2, order + 1):
                h, starts = by[n - 1]
                entry = np.searchsorted(hashes, h)
                context = below[np.searchsorted(below_starts, starts)]
                good = totals[entry] >= min_count
                at = starts[good] + n - 1
                value[at] = logs[entry[good]] - logs[context[good]]
                length[at] = n
                below, below_starts = entry, starts
            # the longest context that the document has at each word
            first = np.cumsum(count) - count
            most = np.minimum(np.arange(len(doc)) - first[doc] + 1, order)
            value += (most - length) * np.log(alpha)
            n = len(count)
            n_words.append(count)
            backed.append(np.bincount(doc[length < most], minlength=n))
            log_score.append(np.bincount(doc, weights=value, minlength=n))
        words = np.concatenate(n_words)
        total = np.concatenate(log_score)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / words
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(words, pa.int64()),
                "n_backed_off": pa.array(np.concatenate(backed), pa.int64()),
                "log_score": pa.array(total),
                "score": pa.array(mean, mask=words == 0),
            }
        )

    schema = "doc_id BIGINT, n_words BIGINT, n_backed_off BIGINT, log_score DOUBLE, score DOUBLE"
    return with_counts(docs, grams, use, schema, grams_per_byte=0.1 * order)
