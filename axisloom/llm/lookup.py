"""Corpus-wide counts of 64-bit n-gram hashes, looked up for whole batches of documents.

Documents are dealt to batches of a bounded size.  A batch asks for the counts of
its distinct n-grams: their sorted hashes travel in packed runs, one per hash range
("bucket"), with the batch's own counts.  A bucket adds up what all batches have of
an n-gram and sends the totals back in the order asked, without the hashes.  The
batch meets its answers next to its documents.

An n-gram of a batch is one number in one shuffle each way, however often it occurs
in the batch, and no n-gram, however common, has more entries than there are batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH_BYTES = 8 << 20
#: n-grams a bucket should hold over all batches
BUCKET_GRAMS = 3 << 19
#: small inputs are still dealt to so many batches, of a megabyte at least
LEAST_BATCHES = 16


def _edges(buckets: int) -> np.ndarray:
    return (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - int(buckets).bit_length() + 1)) if buckets > 1 else np.empty(0, np.uint64)


def with_counts(
    docs: DataFrame,
    grams: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    use: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
    schema: str,
    grams_per_byte: float,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``use(documents, hashes, totals)`` over batches of ``docs`` (doc_id, text).

    ``grams(documents)`` gives a batch's distinct hashes, sorted, and what each adds to
    its total.  ``totals`` fit ``hashes``.  ``grams_per_byte`` only sizes the buckets.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = int(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-size // batch_bytes), min(LEAST_BATCHES, size >> 20))
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1.0, size * grams_per_byte / BUCKET_GRAMS)))))
    # equal rows may share a batch; different ones are spread whatever their id
    dealt = plain.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def ask(docs: pa.Table) -> pa.Table:
        hashes, counts = grams(docs)
        at = np.concatenate(([0], np.searchsorted(hashes, _edges(buckets)), [len(hashes)]))
        some = np.flatnonzero(np.diff(at))
        cut = lambda x, kind: pa.array([x[at[b] : at[b + 1]].astype(kind).tobytes() for b in some], pa.binary())
        batch = docs.column("batch")[0].as_py()
        return pa.table(
            {
                "batch": pa.array(np.full(len(some), batch, np.int32)),
                "bucket": pa.array(some.astype(np.int32)),
                "hashes": cut(hashes, "<u8"),
                "counts": cut(counts, "<u4"),
            }
        )

    def answer(asked: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), "<u8") for x in asked.column("hashes")]
        counts = [np.frombuffer(x.as_py(), "<u4") for x in asked.column("counts")]
        at = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
        joined = np.concatenate(hashes)
        order = np.argsort(joined, kind="stable")
        ordered = joined[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), first)
        totals = np.empty(len(joined), dtype=np.uint64)
        totals[order] = np.repeat(total, np.diff(np.append(first, len(joined))))
        wide = "<u8" if len(total) and total.max() >= 1 << 32 else "<u4"
        packed = [totals[a:b].astype(wide).tobytes() for a, b in zip(at, at[1:])]
        return pa.table(
            {
                "batch": asked.column("batch"),
                "bucket": asked.column("bucket"),
                "wide": pa.array(np.full(len(packed), wide == "<u8")),
                "totals": pa.array(packed, pa.binary()),
            }
        )

    def meet(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, _ = grams(docs)
        rows = sorted(answers.select(["bucket", "wide", "totals"]).to_pylist(), key=lambda r: r["bucket"])
        totals = [np.frombuffer(r["totals"], "<u8" if r["wide"] else "<u4").astype(np.int64) for r in rows]
        return use(docs, hashes, np.concatenate(totals) if totals else np.empty(0, np.int64))

    asked = dealt.groupBy("batch").applyInArrow(ask, "batch INT, bucket INT, hashes BINARY, counts BINARY")
    answers = asked.groupBy("bucket").applyInArrow(answer, "batch INT, bucket INT, wide BOOLEAN, totals BINARY")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(meet, schema)
