"""Words of documents that lie in verbatim benchmark passages.

Every slice of documents is turned into a suffix array over its words, and every
test suffix (the windows of the benchmark items) is looked up in it by binary
search.  The array is sparse: only places from which a run of benchmark words
goes on for at least a window can hold a match, and all others are left out
before sorting, so that almost nothing is sorted in clean text.  Suffixes are
ordered by prefix doubling, words first, then pairs, fours and eights of words,
so the order is that of word numbers and not of hashes.

The benchmark travels with the tasks.  It is measured first; beyond
``max_part_bytes`` it is cut by item into parts of that size, each with a pass
over the documents of its own.
"""

from __future__ import annotations

from dataclasses import dataclass


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import NON_ALNUM, Words, covered, slices, text_bytes

WINDOW = 10
MAX_PART_BYTES = 16 << 20


@dataclass(frozen=True)
class TestSet:
    """Windows of items as sequences of word numbers; 0 stands for all other words."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    windows: dict  # length -> (n, length) array of distinct windows, sorted
    window_items: dict  # length -> list of (uses, 2) arrays: item and offset in it, for each window
    items: list  # item ids, None for items without one
    filter: np.ndarray  # which low bits of word hashes occur at all

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


FILTER_BITS = 20


def test_set(item_ids: list, texts: list, window: int = WINDOW) -> TestSet:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = Words(data, offsets, NON_ALNUM, lower=True)
    vocabulary, numbers = np.unique(words.hash, return_inverse=True)
    numbers = numbers.astype(np.int64) + 1
    found: dict[int, dict[tuple, set]] = {}
    for item, (first, count) in enumerate(zip(words.first.tolist(), words.count.tolist())):
        length = min(window, count)
        for at in range(first, first + count - length + 1) if length else ():
            found.setdefault(length, {}).setdefault(tuple(numbers[at : at + length].tolist()), []).append((item, at - first))
    windows, owners = {}, {}
    for length, by in found.items():
        ordered = sorted(by)
        windows[length] = np.array(ordered, dtype=np.int64).reshape(len(ordered), length)
        owners[length] = [np.array(sorted(by[w]), dtype=np.int64).reshape(-1, 2) for w in ordered]
    low = np.zeros(1 << FILTER_BITS, dtype=bool)
    low[(vocabulary & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return TestSet(vocabulary, windows, owners, list(item_ids), low)


def word_numbers(tests: TestSet, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), dtype=np.int64)
    if len(tests.vocabulary):
        maybe = np.flatnonzero(tests.filter[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(tests.vocabulary, hashes[maybe])
        at[at == len(tests.vocabulary)] = 0
        same = tests.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
    return out


def _rank_pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of (high, low) in order; both below 2^31."""
    return np.unique(high << np.int64(32) | low, return_inverse=True)[1].astype(np.int64)


def suffix_array(numbers: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their first ``depth`` words, by prefix doubling.

    Ranks are kept for all positions reachable from a place; ``numbers`` must go on
    for ``depth`` entries behind the last place.
    """
    reach = np.unique((places[:, None] + np.arange(depth)).ravel()) if len(places) else places
    rank = np.zeros(int(reach[-1]) + 2 if len(reach) else 1, dtype=np.int64)
    rank[reach] = numbers[reach]
    step = 1
    while step * 2 <= depth:
        after = np.minimum(reach + step, len(rank) - 1)
        rank[reach] = _rank_pairs(rank[reach], rank[after])
        step *= 2
    if step < depth:
        rest = _rank_pairs(rank[places], rank[places + depth - step])
        return places[np.argsort(rest, kind="stable")]
    return places[np.argsort(rank[places], kind="stable")]


def matches(tests: TestSet, numbers: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(window number, place, length) of every place where a test window stands."""
    out = []
    n = len(numbers)
    # how many benchmark words follow each place within its document, itself included
    stop = np.ones(n + 1, dtype=bool)
    stop[:n] = numbers == 0
    stop_at = np.flatnonzero(stop)
    run_end = stop_at[np.searchsorted(stop_at, np.arange(n))]
    run_end = np.minimum(run_end, np.searchsorted(doc, doc, side="right"))
    run = run_end - np.arange(n)
    for length, windows in tests.windows.items():
        places = np.flatnonzero(run >= length)
        if not len(places):
            continue
        ordered = suffix_array(numbers, places, length)
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(ordered), np.int64)
        # a window's suffixes are a range of the array: narrowed by binary search, word by word
        for k in range(length):
            column = numbers[ordered + k]
            key = windows[:, k]
            low, high = _narrow(column, key, low, high)
        for w in np.flatnonzero(high > low).tolist():
            at = ordered[low[w] : high[w]]
            out.append((np.full(len(at), w), at, length))
    return out


def _narrow(column, key, low, high):
    """Per key the part of ``column[low:high]`` (ascending there) that equals it."""
    ends = []
    for side in ("left", "right"):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            value = column[np.minimum(mid, len(column) - 1)]
            right = open_ & ((value < key) if side == "left" else (value <= key))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        ends.append(a)
    return ends[0], np.maximum(ends[0], ends[1])


def longest(tests: TestSet, found: list, doc: np.ndarray, first: np.ndarray) -> dict[int, list[dict]]:
    """Per document its longest verbatim match with each item: item, start, item_start, size in words.

    A window at place p that stands at offset o of an item lies on the diagonal p - o;
    neighbours on one diagonal are one match.  Of equally long ones the first counts.
    """
    parts = []
    for w, at, length in found:
        uses = tests.window_items[length][int(w[0])]
        parts.append((np.repeat(uses[:, 0], len(at)), np.tile(at, len(uses)), np.repeat(uses[:, 1], len(at)), np.full(len(at) * len(uses), length)))
    if not parts:
        return {}
    item, place, offset, size = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, place - offset, item, doc[place]))
    item, place, offset, size = item[order], place[order], offset[order], size[order]
    on = doc[place]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (on[1:] != on[:-1]) | (place[1:] != place[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    steps = np.diff(np.append(begin, len(item)))
    item, place, offset, size, on = item[begin], place[begin], offset[begin], size[begin] + steps - 1, on[begin]
    best = np.lexsort((place, -size, item, on))
    one = np.ones(len(best), dtype=bool)
    one[1:] = (item[best][1:] != item[best][:-1]) | (on[best][1:] != on[best][:-1])
    out: dict[int, list[dict]] = {}
    for i in best[one].tolist():
        d = int(on[i])
        out.setdefault(d, []).append({"item": int(item[i]), "start": int(place[i] - first[d]), "item_start": int(offset[i]), "size": int(size[i])})
    return out


#: a document's matches in task tables
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("size", pa.int32())]))
_REPORT = "_row BIGINT, _hash BIGINT, n_words BIGINT, hits ARRAY<STRUCT<start: INT, end: INT>>, "
_NAMED = _REPORT + "matches ARRAY<STRUCT<item: STRING, start: INT, item_start: INT, size: INT>>"


def _report(tests: TestSet):
    names = tests.items

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                numbers = word_numbers(tests, words.hash)
                found = matches(tests, numbers, words.doc) if tests.windows else []
                top = longest(tests, found, words.doc, words.first)
                spans = [[] for _ in range(b - a)]
                if found:
                    starts = np.concatenate([at for _, at, _ in found])
                    hit = covered(len(words), starts, np.concatenate([at + length for _, at, length in found]))
                    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                        # a run may go on from one document into the next
                        while s < e:
                            d = int(words.doc[s])
                            stop = min(e, int(words.first[d] + words.count[d]))
                            spans[d].append({"start": s - int(words.first[d]), "end": stop - int(words.first[d])})
                            s = stop
                named = [[{**m, "item": names[m["item"]]} for m in top.get(d, ())] for d in range(b - a)]
                yield pa.record_batch(
                    [
                        batch.column("_row").slice(a, b - a),
                        batch.column("_hash").slice(a, b - a),
                        pa.array(words.count, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(named, _MATCHES),
                    ],
                    names=["_row", "_hash", "n_words", "hits", "matches"],
                )

    return run


def _tests_of_part(benchmark: DataFrame, parts: int, part: int, window: int) -> TestSet:
    rows = (
        benchmark.select(F.col("item_id").cast("string").alias("id"), "text")
        .filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        .filter("text IS NOT NULL")
        .collect()  # measured before: at most about max_part_bytes
    )
    rows.sort(key=lambda r: (r[0] or "", r[1]))
    return test_set([r[0] for r in rows], [r[1] for r in rows], window)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_part_bytes: int = MAX_PART_BYTES,
) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items (sorted strings), hits, matches, longest, contaminated``.

    ``hits`` are maximal hit word ranges [start, end).  ``matches`` has the longest verbatim
    match with each item: ``item, start`` (word of the document), ``item_start`` (word of the
    item) and ``size``, sorted by item; ``longest`` is the size of the longest.
    A null text has no words; an item without words matches nothing; one without an id
    hits words and has a match without a name, but is none of ``items``; of items that share an id
    each has a match; items that share a window are all reported; an empty benchmark leaves every
    document clean.  Equal rows are reported each on its own.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // max_part_bytes))
    named = docs.select(F.col("doc_id").alias("_row"), F.xxhash64("text").alias("_hash"), "text")
    passes = [named.mapInArrow(_report(_tests_of_part(benchmark, parts, part, window)), _NAMED) for part in range(parts)]
    found = passes[0] if parts == 1 else _merge(passes)
    found = found.withColumn("matches", F.array_sort("matches")).withColumn(
        "items", F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item"]))))
    )
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["end"] - h["start"])
    return found.select(
        F.col("_row").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        "hits",
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["size"])), F.lit(0)).cast("bigint").alias("longest"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _merge(passes: list[DataFrame]) -> DataFrame:
    """Passes over the same documents with different parts of the benchmark, joined by document."""
    union = passes[0]
    for p in passes[1:]:
        union = union.unionAll(p)
    n = len(passes)
    by = union.groupBy("_row", "_hash").agg(
        F.max("n_words").alias("n_words"),
        # equal rows come n times each per pass: their number survives as copies
        (F.count("*") / n).cast("int").alias("_copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("matches"))).alias("matches"),
    )
    # ranges of different parts may overlap or touch: joined in order of their starts
    joined = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda kept, h: F.when(
            (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)).getField("end") >= h["start"]),
            F.concat(
                F.slice(kept, F.lit(1), F.size(kept) - 1),
                F.array(F.struct(
                    F.try_element_at(kept, F.lit(-1)).getField("start").alias("start"),
                    F.greatest(F.try_element_at(kept, F.lit(-1)).getField("end"), h["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(kept, F.array(h))),
    )
    return by.withColumn("hits", joined).withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("_c", "_copies")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, all columns as they were; every row is judged on its own.

    Removal needs no name: items without an id count too.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // MAX_PART_BYTES))
    kept = docs
    for part in range(parts):
        kept = kept.mapInArrow(_keep_clean(_tests_of_part(benchmark, parts, part, window)), docs.schema)
    return kept


def _keep_clean(tests: TestSet):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                clean = np.ones(b - a, dtype=bool)
                if tests.windows:
                    for _, at, _ in matches(tests, word_numbers(tests, words.hash), words.doc):
                        clean[words.doc[at]] = False
                keep.append(clean)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run
