"""Spelling variants: words that differ by one code point, found with permuterm rotations.

1. Tasks take the runs of letters of whole texts, delete one code point where the
   checksum of document and run says so, and count what results; Spark adds up.
2. Every word is marked with a terminator and turned through all its rotations.  Turned so
   that position i comes last, a word is a prefix (all but that code point) and the code
   point: words with one prefix differ in that position only.  A word without the code
   point, turned to the same place, *is* the prefix.  So replacements and indels of a
   position are one stretch of the rotations in sorted order.
3. Rotations are dealt by prefix, sorted, and scanned stretch by stretch.  A stretch has
   one word per letter at most, whatever the corpus; each member is given the number of
   its partners there and the most frequent one.  An indel in a run of equal letters can
   be made at any of them: only the first one counts.
4. Members' findings are added up per word; forms are followed to their roots by pointer
   doubling (each step at least doubles the count, so chains are short).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import drop_stored, stored
from .words import Words, slices

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: one run in so many (by checksum) loses a code point
DAMAGE = 97
#: the most frequent near word is a form from this multiple of a word's own count
FORM_FACTOR = 2
END = "$"
#: bytes of text cut into runs at once, and distinct words a task adds up before it passes them on
SLICE, HELD = 1 << 21, 400_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: lead byte of U+00C0 to U+00FF, which also leads nothing else
_WIDE = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters A-Z, a-z, U+00C0 to U+00FF."""
    wide = data == _WIDE
    inside = _LETTER[data] | wide
    inside[1:] |= wide[:-1]
    return inside


def run_checksums(words: Words, leads: list[bytes]) -> np.ndarray:
    """crc32 of (the document's lead + run) for every run, byte column by byte column."""
    size = words.end - words.start
    order = np.argsort(-size, kind="stable")
    start, size = words.start[order], size[order]
    begun = np.array([zlib.crc32(x) for x in leads], np.uint32) ^ np.uint32(0xFFFFFFFF)
    state = begun[words.doc[order]]
    short = np.searchsorted(-size, -64)  # longer runs stand before it
    alive = np.searchsorted(-size, -np.arange(1, 65), side="right")
    for j in range(64):
        if alive[j] <= short:
            break
        some = slice(short, alive[j])
        state[some] = _CRC[(state[some] ^ words.data[start[some] + j]) & np.uint32(255)] ^ (state[some] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for at in order[:short].tolist():
        out[at] = zlib.crc32(words.data[words.start[at] : words.end[at]].tobytes(), zlib.crc32(leads[words.doc[at]]))
    return out


def _words_of(data: np.ndarray, offsets: np.ndarray, leads: list[bytes], least: int, damage: int) -> pa.Array:
    """The runs of some documents as they count: lower case, some with a code point deleted."""
    words = Words(data, offsets, letters, lower=True)
    marks = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(words.data != _WIDE, out=marks[1:])
    length = marks[words.end] - marks[words.start]  # in code points
    hit = run_checksums(words, leads)
    struck = (hit % damage == 0) & (length > least)
    sizes = (words.end - words.start).astype(np.int64)
    text = words.data[np.repeat(words.start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())] if len(sizes) else words.data[:0]
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(text))])
    plain = runs.filter(pa.array((hit % damage != 0) & (length >= least)))
    cut = []
    for run, h in zip(runs.filter(pa.array(struck)).to_pylist(), hit[struck].tolist()):
        at = h % len(run)
        cut.append(run[:at] + run[at + 1 :])
    return pa.concat_arrays([plain, pa.array(cut, pa.large_string())])


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of all words of ``least_length`` code points and more, over all rows."""

    def run(batches):
        held, rows = [], 0

        def out(table):
            return [pa.record_batch([b.column(0).cast(pa.string()), b.column(1)], names=["word", "n"]) for b in table.to_batches(max_chunksize=1 << 16)]

        for batch in batches:
            lead = [x.encode() for x in batch.column("lead").to_pylist()]
            for a, b, data, offsets in slices(batch.column("text"), SLICE):
                found = pc.value_counts(_words_of(data, offsets, lead[a:b], least_length, damage))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
                if rows > HELD:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from out(held[0])
                        held, rows = [], 0
        if held:
            yield from out(_added(held))

    lead = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    counted = docs.filter(F.col("text").isNotNull()).select(lead.alias("lead"), "text").mapInArrow(run, "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, mark, n``: every word once per code point that a rotation brings last, and once per plain rotation.

    ``mark`` is twice the code point, plus 1 unless an equal one stands before it in the
    word; 0 marks the word itself, turned whole.
    """
    size = F.length("word")
    turned = words.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    i, word = F.col("i"), F.col("word")
    head = F.substring(word, F.lit(1), i)
    last = F.substring(word, i + 1, F.lit(1))
    fresh = (i == 0) | (last != F.substring(word, i, F.lit(1)))
    return turned.select(
        "n",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.concat(F.substring(word, i + 1, F.col("size")), F.lit(END), head).alias("prefix"), F.lit(0).alias("mark")),
                    F.struct(F.concat(F.substring(word, i + 2, F.col("size")), F.lit(END), head).alias("prefix"), (F.ascii(last) * 2 + fresh.cast("int")).alias("mark")),
                ),
                lambda x: (x["mark"] == 0) | (i < F.col("size")),
            )
        ).alias("r"),
    ).select("r.prefix", "r.mark", "n")


def _scan_stretches(group: np.ndarray, mark: np.ndarray, n: np.ndarray):
    """(row, partners, best partner's row): findings for the members of sorted stretches.

    A member can have two findings: replacements, and the indel.
    """
    k = int(group[-1]) + 1
    code, fresh = mark >> 1, (mark & 1) == 1
    base = np.full(k, -1)
    whole = np.flatnonzero(mark == 0)
    base[group[whole]] = whole
    rows, partners, best = [], [], []

    def ranked(which):
        """Members by count (larger first), then code point; the first one and the second of each group."""
        at = which[np.lexsort((code[which], -n[which], group[which]))]
        g = group[at]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]) if len(g) else np.empty(0, bool))
        size = np.diff(np.append(start, len(g)))
        first, second, many = np.full(k, -1), np.full(k, -1), np.zeros(k, np.int64)
        first[g[start]], many[g[start]] = at[start], size
        two = size > 1
        second[g[start[two]]] = at[start[two] + 1]
        return first, second, many

    letter = np.flatnonzero(mark > 0)
    first, second, many = ranked(letter)
    some = letter[many[group[letter]] > 1]
    g = group[some]
    rows.append(some)
    partners.append(many[g] - 1)
    best.append(np.where(first[g] == some, second[g], first[g]))
    # indels: the whole rotation and the letters that are first of their kind
    new = letter[fresh[letter] & (base[group[letter]] >= 0)]
    rows.append(new)
    partners.append(np.ones(len(new), np.int64))
    best.append(base[group[new]])
    first, _, many = ranked(new)
    lone = whole[many[group[whole]] > 0]
    rows.append(lone)
    partners.append(many[group[lone]])
    best.append(first[group[lone]])
    return np.concatenate(rows), np.concatenate(partners), np.concatenate(best)


def _scan(batches):
    """Stretches of equal prefix in sorted rows; the last one of a batch waits for the next batch."""
    rest = None
    for batch in _and_end(batches):
        if batch is None:
            whole, rest = rest, None
        else:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            prefix = table.column("prefix").combine_chunks()
            changes = np.flatnonzero(pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(prefix) > 1 else np.empty(0, np.int64)
            cut = int(changes[-1]) if len(changes) else 0
            whole, rest = table.slice(0, cut), table.slice(cut).combine_chunks()
        if whole is None or not whole.num_rows:
            continue
        prefix = whole.column("prefix").combine_chunks()
        new = np.ones(len(prefix), dtype=bool)
        new[1:] = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(new) - 1
        shared = (np.bincount(group) > 1)[group]
        if not shared.any():
            continue
        at = np.flatnonzero(shared)
        group = np.unique(group[at], return_inverse=True)[1]
        mark, n = (whole.column(c).to_numpy()[at] for c in ("mark", "n"))
        rows, partners, best = _scan_stretches(group, mark, n)
        yield pa.record_batch(
            [prefix.take(pa.array(at[rows])), pa.array((mark[rows] >> 1).astype(np.int32)), pa.array(partners), pa.array((mark[best] >> 1).astype(np.int32)), pa.array(n[best])],
            names=["prefix", "own", "partners", "other", "other_n"],
        )


def _and_end(batches):
    yield from batches
    yield None


def _word(code):
    """The word that a rotation was made from."""
    own = F.when(F.col(code) == 0, F.lit("")).otherwise(F.char(F.col(code)))
    return F.concat(F.substring_index("prefix", END, -1), own, F.substring_index("prefix", END, 1))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n``: how many words are one code point away, and the most frequent of them.

    ``words``: distinct ``word`` of code points up to U+00FF without ``$``, and ``n``.
    Ties go to the smallest word in code-point order.  Words without near words have no row.
    """
    turned = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "mark")
    found = turned.mapInArrow(_scan, "prefix STRING, own INT, partners BIGINT, other INT, other_n BIGINT")
    named = found.select(_word("own").alias("word"), "partners", F.struct((-F.col("other_n")).alias("m"), _word("other").alias("w")).alias("best"))
    summed = named.groupBy("word").agg(F.sum("partners").alias("n_near"), F.min("best").alias("b"))
    return summed.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: each form followed to the last, doubling the stretch per round."""
    now, path = stored(forms.select("word", F.col("form").alias("root")), "form-roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        if now.join(ahead, now["root"] == ahead["_word"], "left_semi").isEmpty():
            return now
        step = now.join(ahead, now["root"] == ahead["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"))
        further, next_path = stored(step, "form-roots")
        drop_stored(forms.sparkSession, path)
        now, path = further, next_path


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR, damage: int = DAMAGE
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of all texts.

    A null text has no words; a null id stands as nothing before the colon of the
    checksum.  Every row counts, repeated ones too.  A word without near words has
    n_near 0; without a form (or with the form's count below ``factor`` times its own)
    form and form_n are null and root is the word.  An empty table gives no rows.
    """
    counted = word_counts(docs, least_length, damage).filter(F.col("n") >= least_count)
    words, _ = stored(counted, "spelling-words")
    near = near_words(words)
    named = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * factor
    formed, _ = stored(
        named.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
