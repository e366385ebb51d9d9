"""Vector codes: product quantisation in whole numbers, nearest entries found by LAESA pivots.

A vector's components become integers and are cut into parts of equal length.  Each
part position has a codebook; each round gives every part its nearest entry and moves
the entries to the floored means of their parts.

*Pivots.*  ``PIVOTS`` entries of each first codebook, far from one another, stay the
pivots of that part position.  Distances from all parts to them are computed once and
stored next to the parts.  Each round, the distances from pivots to the entries give, by
the triangle inequality, a lower bound for every (part, entry).  Entries are met in the
order of their bounds, squared distances are evaluated exactly in integers, and a part
is done as soon as the next bound exceeds the best distance found.

Distances to pivots are kept as whole 64ths, rounded down; the bound gives away more
than the rounding can cost, so pruning never changes a result.

A task adds up its own parts per (position, entry); Spark adds the tasks' sums, whose
number is that of the codebook entries.  The driver holds codebooks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
#: factor from components to integers
SCALE = 256.0
#: pivot distances are counted in such fractions
FINE = 64.0
#: parts compared at once
BLOCK = 1 << 13
#: so many label sums at most are sent to every task; more are joined by a shuffle
BROADCAST_LABELS = 1 << 16
LONGEST = (1 << 63) - 1


def clean_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, embedding, label`` of the rows that can be coded.

    Left out: null vectors, those with null, NaN or infinite components, and those that
    cannot be cut into equal parts (a length of 0 or no multiple of ``parts``).
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding"), "label")
    return rows.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & finite)


def integers(column: pa.Array, dims: int, wide: bool) -> np.ndarray:
    """(rows, dims) of floor(256 x): int64, or Python ints where squares could leave 64 bits."""
    x = np.floor(np.asarray(column.flatten()).reshape(-1, dims) * SCALE)
    return np.frompyfunc(int, 1, 1)(x) if wide else x.astype(np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def fine_root(sq: np.ndarray) -> np.ndarray:
    """Whole 64ths of the distance, as doubles; off by less than 2 and 1e-12 of itself."""
    return np.floor(np.sqrt(sq.astype(np.float64)) * FINE)


def choose_pivots(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries far from one another: first the one farthest from entry 0, then maximin; ties to lower index."""
    if not len(book):
        return book
    far = squares(book, book[0])
    chosen = [int(np.argmax(far))]
    nearest = squares(book, book[chosen[0]])
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squares(book, book[chosen[-1]]))
    return book[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray):
    """(entry, squared distance, evaluations) of each part; ties go to the lower index.

    ``to_pivots``: fine roots of the distances from the parts to the pivots, one column each.
    """
    n, k = len(parts), len(book)
    rows = np.arange(n)
    from_pivots = fine_root(squares(book[None, :, :], pivots[:, None, :]))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None], from_pivots[p]
        np.maximum(bound, np.abs(a - b) - 2.0 - 1e-12 * (a + b), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    ordered = np.take_along_axis(bound, order, axis=1)
    best = order[:, 0].copy()
    low = squares(parts, book[best])
    open_, evaluated = rows, n
    for rank in range(1, k):
        # a bound no larger than the best distance may still hide a nearer or an equal entry
        root = np.sqrt(low[open_].astype(np.float64)) * FINE
        open_ = open_[ordered[open_, rank] <= root * (1 + 1e-12) + 1]
        if not len(open_):
            break
        entry = order[open_, rank]
        sq = squares(parts[open_], book[entry])
        evaluated += len(open_)
        better = (sq < low[open_]) | ((sq == low[open_]) & (entry < best[open_]))
        at = open_[better.astype(bool)]
        best[at], low[at] = entry[better.astype(bool)], sq[better.astype(bool)]
    return best, low, evaluated


class Coder:
    """What tasks need: dimensions, pivots and the present codebooks (positions, entries, length)."""

    def __init__(self, books: np.ndarray, pivots: int, wide: bool):
        self.books, self.wide = books, wide
        self.pivots = [choose_pivots(b, pivots) for b in books]
        self.parts, self.entries, self.length = books.shape
        self.distance = np.dtype("<f8" if wide else "<i4")

    def pack(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The integer parts and their pivot distances, packed per vector."""
        x = integers(batch.column("embedding"), self.parts * self.length, self.wide)
        cut = x.reshape(len(x), self.parts, self.length)
        roots = np.stack([fine_root(squares(cut[:, j, None, :], self.pivots[j][None])) for j in range(self.parts)], axis=1)
        own = np.dtype("<f8" if self.wide else "<i4")
        raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype(own), roots.astype(self.distance))]
        return pa.record_batch([batch.column("vec_id"), batch.column("label"), *raw], names=["vec_id", "label", "parts", "roots"])

    def unpack(self, batch: pa.RecordBatch):
        own = np.dtype("<f8" if self.wide else "<i4")
        x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), own).reshape(-1, self.parts, self.length)
        x = np.frompyfunc(int, 1, 1)(x) if self.wide else x.astype(np.int64)
        roots = np.frombuffer(b"".join(batch.column("roots").to_pylist()), self.distance)
        return x, roots.astype(np.float64).reshape(len(x), self.parts, -1)

    def assign(self, x: np.ndarray, roots: np.ndarray):
        """Entries and squared distances, a column per part position."""
        entry, low = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], x.dtype)
        for j in range(self.parts):
            for a in range(0, len(x), BLOCK):
                entry[a : a + BLOCK, j], low[a : a + BLOCK, j], _ = nearest(x[a : a + BLOCK, j], roots[a : a + BLOCK, j], self.books[j], self.pivots[j])
        return entry, low


def _sums(coder: Coder):
    """One row per (position, used entry) and task: the sum of its parts and their number."""

    def run(batches):
        total = np.zeros(coder.books.shape, dtype=object if coder.wide else np.int64)
        count = np.zeros(coder.books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                x, roots = coder.unpack(batch)
                entry, _ = coder.assign(x, roots)
                for j in range(coder.parts):
                    np.add.at(total[j], entry[:, j], x[:, j])
                    count[j] += np.bincount(entry[:, j], minlength=coder.entries)
        part, at = np.nonzero(count)
        if len(part):
            yield pa.record_batch(
                [pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(count[part, at]), pa.array([[str(v) for v in total[p, e]] for p, e in zip(part, at)], pa.list_(pa.string()))],
                names=["part", "entry", "n", "total"],
            )

    return run


def _moved(packed: DataFrame, coder: Coder, wide: bool, pivots: int) -> np.ndarray:
    """The codebooks after one round: floored means, unused entries as they were."""
    sums = packed.mapInArrow(_sums(coder), "part INT, entry INT, n BIGINT, total ARRAY<STRING>")
    kind = "decimal(38,0)" if wide else "bigint"
    flat = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
    added = flat.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast(kind)).alias("value"))
    books = coder.books.copy()
    for r in added.collect():  # as many rows as the codebooks have numbers
        books[r["part"], r["entry"], r["at"]] = int(r["value"]) // int(r["n"])
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per row that can be coded.

    ``code`` has two hex digits per part, ``error`` is the squared distance over all
    parts, ``label_error`` its sum over the rows of a label (null is a label of its own).
    Codebooks start from the rows of smallest vec_id (nulls last; rows of one id in order
    of their components); fewer rows than entries give shorter codebooks.  Rows left
    out are named in ``clean_vectors``; besides, all vectors must be as long as
    that of the first row, others are left out.  Repeated rows count each.  Errors beyond
    a long are given as the largest long.  An empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    kept = clean_vectors(vectors, parts)
    spark = vectors.sparkSession
    # written by a task: the driver then reads these few rows, whatever the number of partitions
    first, _ = stored(kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries), "first-vectors")
    rows = first.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").collect()
    schema = "vec_id BIGINT, code STRING, error BIGINT, label_error BIGINT, codebooks_sha256 STRING"
    if not rows:
        return spark.createDataFrame([], schema)
    dims = len(rows[0]["embedding"])
    kept = kept.filter(F.size("embedding") == dims)
    seed = [r["embedding"] for r in rows if len(r["embedding"]) == dims]
    if len(seed) < len(rows):
        first, _ = stored(kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries), "first-vectors")
        seed = [r["embedding"] for r in first.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").collect()]
    top = kept.agg(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v))))).first()[0]
    length = dims // parts
    # 4-byte pivot distances and parts, 8-byte squares and sums: all safe below this size
    wide = (top * SCALE + 1) * np.sqrt(length) * 2 * FINE >= 2.0**31
    books = integers(pa.array(seed, pa.list_(pa.float64())), dims, wide)
    books = books.reshape(len(seed), parts, length).transpose(1, 0, 2).copy()
    start = Coder(books, pivots, wide)
    pack = lambda batches: (start.pack(b) for b in batches if b.num_rows)
    label = dict(kept.dtypes)["label"]
    packed, _ = stored(kept.mapInArrow(pack, f"vec_id BIGINT, label {label}, parts BINARY, roots BINARY"), "packed-vectors")
    coder = start
    for _ in range(rounds):
        books = _moved(packed, coder, wide, pivots)
        coder = _with_books(start, books)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                entry, low = coder.assign(*coder.unpack(batch))
                error = [min(int(v), LONGEST) for v in low.sum(axis=1)]
                codes = [bytes(r).hex() for r in entry.astype(np.uint8)]
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded, _ = stored(packed.mapInArrow(code, f"vec_id BIGINT, label {label}, code STRING, error BIGINT"), "vector-codes")
    # the sum in decimals: no overflow however many rows a label has
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")
    sums, _ = stored(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, coded["label"].eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _with_books(start: Coder, books: np.ndarray) -> Coder:
    """The coder with other codebooks and the same pivots."""
    out = object.__new__(Coder)
    out.__dict__.update(start.__dict__)
    out.books = books
    return out
