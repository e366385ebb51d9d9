"""Countable facts about each document's text, for quality rules and classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import SPACE, Words, covered, mix, range_hashes, slices, window_hashes

#: exact counts, as LONG columns
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = (
    "n_bytes", "n_chars", "n_lines", "n_digits", "n_upper", "n_lower", "n_wide", "n_stops", "n_commas",
    "n_bars", "n_bangs", "n_other_punct", "n_distinct", "n_short", "n_long", "max_word", "n_rare_len",
)


def _flags(chars) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[b if isinstance(b, int) else ord(b) for b in chars]] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_NEWLINE = np.uint8(0x0A)
_CLASSES = {
    "n_digits": _flags(range(0x30, 0x3A)),
    "n_upper": _flags(range(0x41, 0x5B)),
    "n_lower": _flags(range(0x61, 0x7B)),
    "n_wide": _flags(range(0xC0, 0x100)),
    "n_stops": _flags("."),
    "n_commas": _flags(","),
    "n_bars": _flags("|"),
    "n_bangs": _flags("!?"),
    "n_other_punct": _flags("\"'()/:;=@[]\\^_`{}~+-"),
}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flagged bytes lie in each document."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offsets))


def _grouped(doc: np.ndarray, hashes: np.ndarray):
    """(order, first of each group in that order, size of each group) by document and hash."""
    key = mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(key)))


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for a run of documents, each an int64 array."""
    n = len(offsets) - 1
    words = Words(data, offsets, SPACE)
    out: dict[str, np.ndarray] = {"n_words": words.count}
    lead = (data & 0xC0) != 0x80  # first bytes of characters
    out["word_chars"] = _per_doc(lead & ~SPACE[data], offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[data], offsets)
    out["n_dup_lines"], out["n_lines"] = _lines(data, offsets, words)
    out["n_repeat_words"] = _repeats(words, n)
    out["n_bytes"] = np.diff(offsets)
    out["n_chars"] = _per_doc(lead, offsets)
    for name, flags in _CLASSES.items():
        out[name] = _per_doc(flags[data], offsets)
    size = words.end - words.start
    count = lambda which: np.bincount(words.doc[which], minlength=n)
    out["n_short"], out["n_long"] = count(size <= 3), count(size > 12)
    out["n_rare_len"] = count(size > 25)
    out["max_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["max_word"], words.doc, size)
    order, first, _ = _grouped(words.doc, words.hash)
    out["n_distinct"] = np.bincount(words.doc[order[first]], minlength=n)
    return out


def _lines(data, offsets, words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier one, and all lines with a word, per document."""
    n, size = len(offsets) - 1, len(data)
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < size]
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # a line ends before its break, or where its document ends
    ends = np.append(starts[1:], size)
    ends = ends - (data[ends - 1] == _NEWLINE)
    with_word = np.searchsorted(words.start, starts) < np.searchsorted(words.start, ends)
    starts, ends = starts[with_word], ends[with_word]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    values = mix(data.astype(np.uint64) + np.uint64(7))
    order, first, _ = _grouped(doc, range_hashes(values, starts, ends))
    total = np.bincount(doc, minlength=n)
    return total - np.bincount(doc[order[first]], minlength=n), total


def _repeats(words: Words, n: int) -> np.ndarray:
    """Words in 3-word windows that stand twice or more in their document."""
    hashes, starts = window_hashes(words.hash, words.doc, 3)
    if not len(hashes):
        return np.zeros(n, np.int64)
    order, first, size = _grouped(words.doc[starts], hashes)
    again = starts[order[np.repeat(size > 1, size)]]
    return np.bincount(words.doc[covered(len(words), again, again + 3)], minlength=n)


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one LONG column per count, for whole texts; a null text counts as empty."""
    names = (*COUNTS, *MORE)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                counts = text_counts(data, offsets)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(counts[x].astype(np.int64)) for x in names)],
                    names=["doc_id", *names],
                )

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return plain.mapInArrow(run, ", ".join(f"{x} BIGINT" for x in ("doc_id", *names)))


#: ratios that a model sees: each is defined for empty texts too
FEATURES = (
    "log_words", "word_len", "symbols", "dup_lines", "repeats", "words_per_line", "digits", "upper", "wide",
    "stops", "commas", "bars", "bangs", "punct", "distinct", "short", "long", "max_word", "spaces", "bytes_per_char",
    "rare_len",
)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """n x len(FEATURES) doubles from the counts."""
    x = {k: np.asarray(v, dtype=np.float64) for k, v in c.items()}
    words, chars, lines = (np.maximum(x[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    columns = {
        "log_words": np.log1p(x["n_words"]),
        "word_len": x["word_chars"] / words,
        "symbols": x["n_symbols"] / words,
        "dup_lines": x["n_dup_lines"] / lines,
        "repeats": x["n_repeat_words"] / words,
        "words_per_line": np.log1p(x["n_words"] / lines),
        "digits": x["n_digits"] / chars,
        "upper": x["n_upper"] / np.maximum(x["n_upper"] + x["n_lower"], 1),
        "wide": x["n_wide"] / chars,
        "stops": x["n_stops"] / words,
        "commas": x["n_commas"] / words,
        "bars": x["n_bars"] / words,
        "bangs": x["n_bangs"] / words,
        "punct": x["n_other_punct"] / chars,
        "distinct": x["n_distinct"] / words,
        "short": x["n_short"] / words,
        "long": x["n_long"] / words,
        "max_word": np.log1p(x["max_word"]),
        "spaces": 1 - x["word_chars"] / chars,
        "bytes_per_char": x["n_bytes"] / chars,
        "rare_len": x["n_rare_len"] / words,
    }
    return np.column_stack([columns[k] for k in FEATURES])


def feature_batch(batch: pa.RecordBatch) -> np.ndarray:
    return features({x: batch.column(x).to_numpy(zero_copy_only=False) for x in (*COUNTS, *MORE)})
