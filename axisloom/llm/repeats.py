"""Substring dedup: words covered by a 50-word window that an earlier document has too.

Prefix-partitioned suffix trees, cut to what can repeat:

1. Every window is filed under its lightest 8-word gram (the gram of smallest hash), the
   prefix of a suffix that starts inside the window.  Equal windows have equal
   prefixes, and a run of neighbouring windows shares one.
2. A prefix that only one document has holds no repeat: its suffixes are dropped.
   Documents without any other prefix are done.
3. Runs of windows under a kept prefix become *contexts* (the words that their windows
   span).  Equal contexts of any number of documents become one, with the smallest id.
4. Contexts are split by prefix into groups.  Tasks build the upper part of each group's
   suffix tree, level by level (1, 2, 4, ... words, then the window size): suffixes of
   one class at the last level hang below one deep node, and its smallest
   document is the first owner.  A prefix with more than ``MAX_GROUP`` contexts gets
   longer prefixes, whole windows: their smallest documents are aggregated by digest.
5. Each document joins its contexts' owners: windows with an earlier owner go.

Words are compared as such in the groups, by 128-bit digest of the words elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .words import SPACE, Words, covered, distinct_per_doc, slices, window_hashes

WINDOW = 50
GRAM = 8
#: contexts of one prefix that a task may take together (as many as it holds at once anyway, see ``_owners``)
MAX_GROUP = 4096


def lightest(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The lightest gram hash of every window, and the windows' starts."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, at = window_hashes(words.hash, words.doc, gram)
    low = np.full(len(words), np.iinfo(np.uint64).max, dtype=np.uint64)
    low[at] = hashes
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        rest = span - size
        low = np.minimum(low[:-rest], low[rest:])
    starts = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    return low[starts], starts


def _runs(key: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of neighbouring windows with one key, as indices."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(key))


def _prefixes(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, SPACE)
                key, starts = lightest(words, window, gram)
                doc = words.doc[starts]
                first, _ = _runs(key, starts, doc)
                d, k = distinct_per_doc(doc[first], key[first])
                yield pa.record_batch(
                    [pa.array(k.view(np.int64)), batch.column("doc_id").slice(a, b - a).take(pa.array(d)), batch.column("h").slice(a, b - a).take(pa.array(d))],
                    names=["prefix", "doc_id", "h"],
                )

    return run


def _kept_sha(words: Words, d: int, keep: np.ndarray | None = None) -> str:
    lo, hi = int(words.first[d]), int(words.first[d] + words.count[d])
    raw = words.data[words.start[lo] : words.end[hi - 1]].tobytes().split() if hi > lo else []
    if keep is not None:
        raw = [w for w, k in zip(raw, keep.tolist()) if k]
    return hashlib.sha256(b" ".join(raw)).hexdigest()


def _screen(batches):
    """Documents without kept prefixes are finished here; the others keep their text."""
    for batch in batches:
        wanted = batch.column("prefixes")
        for a, b, data, offsets in slices(batch.column("text")):
            words = Words(data, offsets, SPACE)
            some = wanted.slice(a, b - a)
            open_ = some.is_valid().to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("h").slice(a, b - a),
                    pa.array(words.count, pa.int64()),
                    pa.array([None if open_[d] else _kept_sha(words, d) for d in range(b - a)], pa.string()),
                    pa.array(batch.column("text").slice(a, b - a).to_pylist(), pa.string(), mask=~open_),
                    some,
                ],
                names=["doc_id", "h", "n_words", "kept_sha256", "text", "prefixes"],
            )


def _context_arrays(batch: pa.RecordBatch, window: int, gram: int):
    """Contexts of open documents: per slice (first row, words, document, prefix, first window, windows)."""
    wanted = batch.column("prefixes")
    for a, b, data, offsets in slices(batch.column("text")):
        words = Words(data, offsets, SPACE)
        key, starts = lightest(words, window, gram)
        doc = words.doc[starts]
        part = wanted.slice(a, b - a)
        known = np.asarray(part.flatten()).astype(np.int64).view(np.uint64)
        lengths = np.asarray(part.value_lengths().fill_null(0))
        owner = np.repeat(np.arange(b - a), lengths)
        # which (document, prefix) are wanted: both sides as sorted pairs
        pairs = np.sort(_pair(owner, known))
        mine = _pair(doc, key)
        at = np.searchsorted(pairs, mine)
        at[at == len(pairs)] = 0
        good = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
        key, starts, doc = key[good], starts[good], doc[good]
        first, end = _runs(key, starts, doc)
        yield a, words, doc[first], key[first], starts[first], end - first


def _pair(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), dtype=[("d", np.int64), ("k", np.uint64)])
    out["d"], out["k"] = doc, key
    return out


def _context_bytes(words: Words, start: int, n: int) -> bytes:
    return b" ".join(words.data[words.start[start] : words.end[start + n - 1]].tobytes().split())


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _contexts(window: int, gram: int):
    """(prefix, context, doc_id): the smallest document of each distinct context of a slice."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, words, doc, key, start, n in _context_arrays(batch, window, gram):
                least: dict[tuple[int, bytes], int] = {}
                for d, k, s, m in zip(doc.tolist(), key.view(np.int64).tolist(), start.tolist(), n.tolist()):
                    at = (k, _context_bytes(words, s, m + window - 1))
                    i = ids[a + d]
                    if at not in least or i < least[at]:
                        least[at] = i
                yield pa.record_batch(
                    [pa.array([k for k, _ in least], pa.int64()), pa.array([c.decode() for _, c in least], pa.string()), pa.array(list(least.values()), pa.int64())],
                    names=["prefix", "context", "doc_id"],
                )

    return run


def _places(window: int, gram: int):
    """(doc_id, h, context digest, first window, windows) of every context of every open document."""

    def run(batches):
        for batch in batches:
            for a, words, doc, _, start, n in _context_arrays(batch, window, gram):
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(doc + a)),
                        batch.column("h").take(pa.array(doc + a)),
                        pa.array([_digest(_context_bytes(words, s, m + window - 1)) for s, m in zip(start.tolist(), n.tolist())], pa.binary()),
                        pa.array(start - words.first[doc], pa.int64()),
                    ],
                    names=["doc_id", "h", "context", "start"],
                )

    return run


def deep_nodes(numbers: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The class of every suffix among those equal in their first ``depth`` words.

    Levels of the suffix tree by doubling: classes of 2n words are pairs of classes of n.
    ``numbers`` is exact (a number per word) and goes on for ``depth`` behind each suffix.
    """
    rank, step = numbers.astype(np.int64), 1
    while step * 2 <= depth:
        pair = rank[:-step] << np.int64(32) | rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    if step == depth:
        return rank[suffixes]
    pair = rank[suffixes] << np.int64(32) | rank[suffixes + depth - step]
    return np.unique(pair, return_inverse=True)[1]


def _group_windows(contexts: list[str], window: int):
    """(deep node of every window, context of every window, windows per context)."""
    raw = "\n".join(contexts).encode()
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(c.encode()) for c in contexts])
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    offsets[-1] -= 1
    words = Words(data, offsets, SPACE)
    vocabulary: dict[bytes, int] = {}
    numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in raw.split()), np.int64, len(words))
    n = words.count - window + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    suffixes = np.repeat(words.first, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return deep_nodes(numbers, suffixes, window), owner, n


def _owners(window: int):
    """Groups of contexts, sorted by prefix, to (context digest, first owner of each window)."""

    def solve(contexts: list[str], docs: list[int]):
        node, owner, n = _group_windows(contexts, window)
        first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, np.asarray(docs, np.int64)[owner])
        flat = first[node]
        return pa.record_batch(
            [
                pa.array([_digest(c.encode()) for c in contexts], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat)),
            ],
            names=["context", "owners"],
        )

    def run(batches):
        waiting, docs, last = [], [], []
        for batch in batches:
            waiting += batch.column("context").to_pylist()
            docs += batch.column("doc_id").to_pylist()
            last += batch.column("prefix").to_pylist()
            if len(waiting) < 4096:
                continue
            # a group that may go on stays; groups are bounded by MAX_GROUP
            cut = len(last)
            while cut and last[cut - 1] == last[-1]:
                cut -= 1
            if cut:
                yield solve(waiting[:cut], docs[:cut])
                waiting, docs, last = waiting[cut:], docs[cut:], last[cut:]
        if waiting:
            yield solve(waiting, docs)

    return run


def _window_digests(window: int, with_place: bool):
    """Contexts of crowded prefixes to (window digest, smallest document) or (context, place, window digest)."""

    def run(batches):
        for batch in batches:
            contexts, docs = batch.column("context").to_pylist(), batch.column("doc_id").to_pylist()
            for a in range(0, len(contexts), 2048):
                some, ids = contexts[a : a + 2048], np.asarray(docs[a : a + 2048], np.int64)
                node, owner, n = _group_windows(some, window)
                _, example = np.unique(node, return_index=True)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                split = [c.split(" ") for c in some] if len(example) else []
                digests = [_digest(" ".join(split[owner[e]][place[e] : place[e] + window]).encode()) for e in example.tolist()]
                if not with_place:
                    least = np.full(len(example), np.iinfo(np.int64).max)
                    np.minimum.at(least, node, ids[owner])
                    yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(least)], names=["window", "doc_id"])
                    continue
                names = [_digest(c.encode()) for c in some]
                yield pa.record_batch(
                    [
                        pa.array(digests, pa.binary()).take(pa.array(node)),
                        pa.array(names, pa.binary()).take(pa.array(owner)),
                        pa.array(place.astype(np.int32)),
                    ],
                    names=["window", "context", "place"],
                )

    return run


def _remove(window: int):
    def run(batches):
        for batch in batches:
            spans = batch.column("spans")
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, SPACE)
                removed, shas, ranges = [], [], []
                for d in range(b - a):
                    gone = np.zeros(int(words.count[d]), dtype=bool)
                    starts = [
                        s["start"] + i
                        for s in (spans[a + d].as_py() or ())
                        for i, o in enumerate(s["owners"])
                        if o < ids[a + d]
                    ]
                    if starts:
                        at = np.asarray(starts)
                        gone = covered(len(gone), at, at + window)
                    removed.append(int(gone.sum()))
                    shas.append(_kept_sha(words, d, ~gone))
                    edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                    at = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                    ranges.append([{"start": s, "end": e} for s, e in zip(*at)])
                yield pa.record_batch(
                    [
                        *(batch.column(c).slice(a, b - a) for c in ("doc_id", "h", "n_words")),
                        pa.array(removed, pa.int64()),
                        pa.array(shas, pa.string()),
                        pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["doc_id", "h", "n_words", "n_removed", "kept_sha256", "removed"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` per row of docs (doc_id, text).

    ``removed`` are the word ranges [start, end) that go, in order and apart from each other;
    ``kept_sha256`` is that of the other words, joined by single spaces.  Windows are judged on the input.  A repeat inside one document, or between rows of one
    id, removes nothing.  A null text is empty; a row with a null id neither loses
    words nor owns any.  Documents shorter than a window lose nothing.
    """
    return _removed(docs, window, gram, max_group).drop("h")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """The documents without their repeats: every row, all columns, the text (and n_chars) cut.

    A removed word takes the white space before it along; rows that lose nothing stay as they were.
    """
    found = _removed(docs, window, gram, max_group).filter("n_removed > 0").groupBy("doc_id", "h").agg(F.first("removed").alias("removed"))
    # the row travels as one struct, so its column names can clash with nothing
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))
    joined = own.join(found, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("h")), "left")
    cut = F.col("removed").isNotNull()
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    gone = lambda i: F.exists("removed", lambda r: (i >= r["start"]) & (i < r["end"]))
    kept = F.array_join(F.filter(words, lambda w, i: ~gone(i)), "")
    row = F.col("row").withField("text", F.when(cut, kept).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(cut, F.char_length(kept).cast(kind)).otherwise(F.col("row.n_chars")))
    return joined.select(row.alias("row")).select("row.*")


def _removed(docs: DataFrame, window: int, gram: int, max_group: int) -> DataFrame:
    """What ``remove_repeats`` gives, with the hash ``h`` that names a text among the rows of its id."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = plain.filter("doc_id IS NOT NULL").mapInArrow(_prefixes(window, gram), "prefix BIGINT, doc_id BIGINT, h BIGINT")
    shared = found.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    wanted = found.join(shared.select("prefix"), "prefix").groupBy("doc_id", "h").agg(F.collect_set("prefix").alias("prefixes"))
    joined = plain.join(wanted, ["doc_id", "h"], "left")
    schema = "doc_id BIGINT, h BIGINT, n_words BIGINT, kept_sha256 STRING, text STRING, prefixes ARRAY<BIGINT>"
    screened, _ = stored(joined.mapInArrow(_screen, schema), "screened", compression="zstd")
    open_ = screened.filter("text IS NOT NULL").select("doc_id", "h", "n_words", "text", "prefixes")

    contexts = open_.mapInArrow(_contexts(window, gram), "prefix BIGINT, context STRING, doc_id BIGINT")
    contexts, _ = stored(contexts.groupBy("prefix", "context").agg(F.min("doc_id").alias("doc_id")), "contexts", compression="zstd")
    crowded = contexts.groupBy("prefix").agg(F.count("*").alias("members")).filter(F.col("members") > max_group).select("prefix")
    few = contexts.join(crowded, "prefix", "left_anti").select("prefix", "context", "doc_id")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = few.repartition(n, "prefix").sortWithinPartitions("prefix")
    owners = grouped.mapInArrow(_owners(window), "context BINARY, owners ARRAY<BIGINT>")

    many = contexts.join(crowded, "prefix", "left_semi").select("context", "doc_id")
    least = many.mapInArrow(_window_digests(window, False), "window BINARY, doc_id BIGINT").groupBy("window").agg(F.min("doc_id").alias("owner"))
    parts = many.mapInArrow(_window_digests(window, True), "window BINARY, context BINARY, place INT")
    crowd_owners = parts.join(least, "window").groupBy("context").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "owner"))), lambda x: x["owner"]).alias("owners")
    )

    places = open_.mapInArrow(_places(window, gram), "doc_id BIGINT, h BIGINT, context BINARY, start BIGINT")
    late = places.join(owners.unionAll(crowd_owners), "context").filter(F.exists("owners", lambda o: o < F.col("doc_id")))
    # a set: repeated rows bring each place once per row
    spans = late.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "owners")).alias("spans"))
    cleaned = open_.select("doc_id", "h", "n_words", "text").join(spans, ["doc_id", "h"], "left")
    ranges = "ARRAY<STRUCT<start: INT, end: INT>>"
    out = f"doc_id BIGINT, h BIGINT, n_words BIGINT, n_removed BIGINT, kept_sha256 STRING, removed {ranges}"
    rest = screened.filter("text IS NULL").select(
        "doc_id", "h", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", F.array().cast(ranges.lower()).alias("removed")
    )
    return cleaned.mapInArrow(_remove(window), out).unionAll(rest)
