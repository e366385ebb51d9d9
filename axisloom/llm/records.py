"""Token ids as length-delimited binary records with a separate offset index.

A data file ``shard-<n>-<attempt>.rec`` is a run of records, one per document:

    uint64  bytes of the payload        uint32  masked CRC-32 of those 8 bytes
    payload                             uint32  masked CRC-32 of the payload

all little-endian.  The payload is one byte for the width of an id (2 or 4),
the document id (int64, with one byte before it that is 0 for a null id) and the
ids.  The masking turns the checksum right by 15 bits and adds a constant, so
that a checksum of data that holds checksums stays useful.  The ``.idx`` file beside it
is an Arrow file with ``doc_id, offset, size, n_tokens`` per record: a reader
that shuffles fetches single records by offset.

Documents are range-partitioned by doc_id, a shard per partition, and sorted
inside, so file order is ascending doc_id order (null ids first, equal ids in
text order).  Files are written through ``pyarrow.fs`` to the shared folder under names
of the task's attempt; the table of files, which Spark commits, names those that count.
A task that runs again writes files of its own and renames nothing, and what a lost
attempt has left is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .words import slices, text_bytes

MASK_ADD = 0xA282EAD8
#: pieces that an encoder remembers, and bytes of text it takes at once
MAX_CACHED = 400_000
#: bytes of text in a shard at most, and at least (small inputs get a shard per shuffle partition)
MAX_SHARD, LEAST_SHARD = 256 << 20, 4 << 20
SLICE = 1 << 21
HEAD, CRC, PAYLOAD = "<QI", "<I", "<B?q"
HEAD_SIZE, PAYLOAD_SIZE = struct.calcsize(HEAD), struct.calcsize(PAYLOAD)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, struct.pack(CRC, masked(size)), payload, struct.pack(CRC, masked(payload))))


def payload(width: int, doc: int | None, raw: bytes) -> bytes:
    return struct.pack(PAYLOAD, width, doc is not None, doc or 0) + raw


def parse(body: bytes) -> tuple[int | None, np.ndarray]:
    width, has_id, doc = struct.unpack_from(PAYLOAD, body)
    return doc if has_id else None, np.frombuffer(body, f"<u{width}", offset=PAYLOAD_SIZE)


def unframe(read, what: str) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the records that ``read(n)`` delivers; raises on damage."""
    at = 0
    while head := read(HEAD_SIZE):
        if len(head) < HEAD_SIZE:
            raise OSError(f"{what}: cut off at {at}")
        size, crc = struct.unpack(HEAD, head)
        if crc != masked(head[:8]):
            raise OSError(f"{what}: damaged length at {at}")
        body = read(size + 4)
        if len(body) < size + 4 or struct.unpack(CRC, body[size:])[0] != masked(body[:size]):
            raise OSError(f"{what}: damaged record at {at}")
        yield at, body[:size]
        at += HEAD_SIZE + size + 4


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder as Spark names it."""
    if path.startswith("file:/") or "://" in path:
        return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path


# --- encoding -----------------------------------------------------------------


#: fixed values: the normaliser and splitter that ``pieces`` and ``PLAIN`` reproduce
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: classes of lower-cased bytes: white space, parts of letters, digits, symbols
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_CLASS = np.full(256, _LETTER, np.uint8)
_CLASS[:128] = _SYMBOL
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
#: bytes that stand alone in texts whose normal form, lower case and classes are beyond doubt
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[9, 10, 13, *range(0x20, 0x7F)]] = True
#: what may follow C3 (letters U+00C0 to U+00FF without the signs for times and divided by) and C5 (the ligature oe)
_AFTER_C3 = np.zeros(256, dtype=bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False
_AFTER_C5 = np.zeros(256, dtype=bool)
_AFTER_C5[[0x92, 0x93]] = True


def plain_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold plain characters only."""
    after = np.zeros(len(data) + 1, np.uint8)
    after[1:-1] = data[:-1]
    before, nxt = after[:-1], np.append(data[1:], np.uint8(0)) if len(data) else data
    good = _PLAIN[data]
    good |= (before == 0xC3) & _AFTER_C3[data]
    good |= (data == 0xC3) & _AFTER_C3[nxt]
    good |= (before == 0xC5) & _AFTER_C5[data]
    good |= (data == 0xC5) & _AFTER_C5[nxt]
    bad = np.searchsorted(np.flatnonzero(~good), offsets)
    return bad[1:] == bad[:-1]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of plain texts: all lower and upper forms have equal lengths."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        wide, oe = data[:-1] == 0xC3, data[:-1] == 0xC5
        out[1:][wide & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
        out[1:][oe & (data[1:] == 0x92)] = 0x93
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class per byte, starts, ends) of the pieces of lower-cased plain texts.

    Runs of letters, single digits, runs of symbols; an apostrophe alone before s, t, m,
    d, re, ve or ll takes these letters with it.
    """
    kind = _CLASS[data]
    begin = np.empty(len(data), dtype=bool)
    begin[:1] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    border = offsets[1:-1]
    begin[border[border < len(data)]] = True
    quote = np.flatnonzero(begin & (data == 39))
    end_of = np.searchsorted(offsets, quote, side="right")  # each quote's document ends there
    room = offsets[end_of] - quote
    one, two = (data[np.minimum(quote + k, len(data) - 1)] for k in (1, 2))
    short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (room > 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    for which, size in ((short, 2), (long, 3)):
        at, left = quote[which], room[which]
        begin[at + 1] = False
        more = at[left > size] + size
        # the letters behind are a piece of their own
        begin[more] |= kind[more] == _LETTER
    begin &= kind != _SPACE
    stop = np.append(np.flatnonzero(begin | (kind == _SPACE)), len(data))
    starts = np.flatnonzero(begin)
    return kind, starts, stop[np.searchsorted(stop, starts) + 1] if len(starts) else starts


class Encoder:
    """Exactly what ``Tokenizer.encode`` gives, with a memory for repeated words.

    The tokenizer splits a text into pieces and encodes each alone, so the ids of a piece
    never depend on its neighbours.  Texts of plain characters are cut into pieces as
    byte arrays; a slice looks up its distinct pieces once, and id runs are gathered for
    all places.  All other texts, and all texts when the tokenizer has another
    normaliser or splitter, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.known = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and said["model"]["end_of_word_suffix"] == "</w>"
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if n <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.ends = np.zeros(n, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        # the memory: distinct pieces, and their runs of ids one after the other
        self.words = pa.array([], pa.string())
        self.ids, self.length = np.empty(0, self.dtype), np.empty(0, np.int64)

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _encoded(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each): many pieces per call, an id of a word end closes each."""
        ids, length = [], []
        for k in range(0, len(new), 4096):
            some = new.slice(k, 4096)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            found = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(found):
                ids.append(found)
                length.append(np.diff(cuts, prepend=0))
            else:
                each = [x.ids for x in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
                ids.append(np.array([i for x in each for i in x], self.dtype))
                length.append(np.array([len(x) for x in each], np.int64))
        return (np.concatenate(ids), np.concatenate(length)) if ids else (self.ids[:0], self.length[:0])

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the memory, which learns the new ones."""
        at = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(at.is_null())
        number = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        ids, length = self._encoded(new)
        self.words = pa.concat_arrays([self.words, new])
        self.ids, self.length = np.concatenate((self.ids, ids)), np.concatenate((self.length, length))
        return number

    def _forget(self, number: np.ndarray, often: np.ndarray) -> None:
        """Keeps the pieces of the present slice that stood in it more than once."""
        keep = np.sort(number[often])
        keep = keep[: MAX_CACHED // 2]
        first = np.cumsum(self.length) - self.length
        length = self.length[keep]
        self.ids = self.ids[np.repeat(first[keep] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        self.words, self.length = self.words.take(pa.array(keep)), length

    def _gather(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of plain texts."""
        data = lowered(data)
        kind, starts, ends = pieces(data, offsets)
        sizes = ends - starts
        # pieces and white space make up the texts, so the bytes of all pieces lie in a row
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        column = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data[kind != _SPACE])])
        coded = column.dictionary_encode()
        number, at = self._numbers(coded.dictionary), coded.indices.to_numpy()
        first = np.cumsum(self.length) - self.length
        place = number[at]
        many = self.length[place]
        placed = np.concatenate(([0], np.cumsum(many)))
        out = self.ids[np.repeat(first[place] - placed[:-1], many) + np.arange(placed[-1])].tobytes()
        if len(self.words) > MAX_CACHED:
            self._forget(number, np.bincount(at, minlength=len(number)) > 1)
        cut = (placed[np.searchsorted(starts, offsets)] * self.width).tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Packed little-endian ids per text, ``width`` bytes each; a null text is empty."""
        data, offsets = text_bytes(column)
        plain = plain_documents(data, offsets) if self.known else np.zeros(len(column), dtype=bool)
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                plain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = raw.find(mark, at + 1)
        del raw
        out: list[bytes | None] = [None] * len(column)
        if plain.all():
            return self._gather(data, offsets) if len(column) else []
        some = np.flatnonzero(plain)
        if len(some):
            keep = np.repeat(plain, np.diff(offsets))
            inner = np.concatenate(([0], np.cumsum(np.diff(offsets)[some])))
            for i, ids in zip(some.tolist(), self._gather(data[keep], inner)):
                out[i] = ids
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self._pack(self.tokenizer.encode(column[i].as_py() or "", add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker and file.

    Task code arrives anew with every task, but the tokenizers module stays
    loaded in a worker: the encoder and what it has learnt are kept there.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_axisloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# --- writing and reading --------------------------------------------------------


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shards: int | None = None
) -> DataFrame:
    """Writes the files; a table ``shard, path, n_docs, n_tokens, n_bytes`` tells of them.

    ``docs``: doc_id, text (null: empty).  Runs when the returned table is read: write it
    down before reading it more than once.  The number of shards follows from the bytes of the texts.
    """
    if shards is None:
        size = int(docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)
        usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-size // MAX_SHARD), min(usual, -(-size // LEAST_SHARD)))
    n = shards
    data = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated ids are told apart by their text, so the order is the same on every run
    ordered = data.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        end = np.asarray([end_id], dtype=encoder.dtype).tobytes()
        where, top = filesystem(folder)
        where.create_dir(top, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        own = f"{top}/{name}"
        index, at, tokens, n_docs = [], 0, 0, 0
        with where.open_output_stream(own + ".rec") as out:
            for batch in batches:
                for a, b, _, _ in slices(batch.column("text"), SLICE):
                    ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                    offsets, sizes, counts = [], [], []
                    chunk = []
                    for doc, raw in zip(ids, encoder.encode_column(batch.column("text").slice(a, b - a))):
                        raw += end
                        record = frame(payload(encoder.width, doc, raw))
                        offsets.append(at)
                        sizes.append(len(record))
                        counts.append(len(raw) // encoder.width)
                        at += len(record)
                        chunk.append(record)
                    out.write(b"".join(chunk))
                    tokens += sum(counts)
                    n_docs += len(ids)
                    index.append(pa.record_batch([pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "offset", "size", "n_tokens"]))
        if not n_docs:
            where.delete_file(own + ".rec")
            return
        with where.open_output_stream(own + ".idx") as out, pa.ipc.new_file(out, index[0].schema) as w:
            for x in index:
                w.write_batch(x)
        yield pa.record_batch([[shard], [f"{folder}/{name}"], [n_docs], [tokens], [at]], names=["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    return ordered.mapInArrow(write, "shard BIGINT, path STRING, n_docs BIGINT, n_tokens BIGINT, n_bytes BIGINT")


def read_records(files: DataFrame) -> DataFrame:
    """The documents of the files: ``shard, seq, doc_id, n_tokens, ids_crc32, ids, data_offset``.

    ``seq`` counts the documents of a shard.  Every length and checksum is tested, and
    so is the index: its offsets must be those found.  ``ids`` are uint32, little-endian.
    """

    def read(batches):
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                where, top = filesystem(path)
                with where.open_input_file(top + ".idx") as f:
                    index = pa.ipc.open_file(f).read_all()
                with where.open_input_stream(top + ".rec", buffer_size=1 << 20) as f:
                    yield from _batches(shard, unframe(f.read, path), index, path)

    return files.select("shard", "path").mapInArrow(
        read, "shard BIGINT, seq BIGINT, doc_id BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY, data_offset BIGINT"
    )


def _batches(shard, records, index, path):
    seq = 0
    while some := list(islice(records, 512)):
        docs, counts, crcs, raws = [], [], [], []
        for _, body in some:
            doc, ids = parse(body)
            ids = ids.astype("<u4").tobytes()
            docs.append(doc)
            counts.append(len(ids) // 4)
            crcs.append(zlib.crc32(ids))
            raws.append(ids)
        said = index.slice(seq, len(some))
        if said.column("offset").to_pylist() != [at for at, _ in some] or said.column("n_tokens").to_pylist() != counts:
            raise OSError(f"{path}: the index does not fit the data")
        yield pa.record_batch(
            [pa.array(x, t) for x, t in (([shard] * len(some), pa.int64()), (list(range(seq, seq + len(some))), pa.int64()), (docs, pa.int64()), (counts, pa.int64()), (crcs, pa.int64()), (raws, pa.binary()), ([at for at, _ in some], pa.int64()))],
            names=["shard", "seq", "doc_id", "n_tokens", "ids_crc32", "ids", "data_offset"],
        )
        seq += len(some)
    if seq != index.num_rows:
        raise OSError(f"{path}: {seq} records, {index.num_rows} in the index")


def read_at(path: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Single records of one file by offset, in the order asked for: (doc_id, ids)."""
    where, top = filesystem(path)
    with where.open_input_file(top + ".rec") as f:
        for at in offsets:
            f.seek(at)
            yield parse(next(unframe(f.read, path))[1])


def token_records(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None
) -> DataFrame:
    """Writes the documents and reads them back: ``doc_id, start, n_tokens, ids_crc32, shard, data_offset``.

    ``start`` counts the ids of all records before it.  Shards and documents are counted
    in two levels, so that nothing but one row per shard is ever brought together.
    An empty table gives no files and no rows.
    """
    folder = folder or scratch_path(spark, "records")
    # the table of files is kept: reading it again must not write again.  One task writes its rows
    # down, one per shard: a file of its own for each would cost an executor several processes
    told = scratch_path(spark, "record-files")
    write_records(docs, folder, tokenizer, end_id).repartition(1).write.parquet(told)
    files = spark.read.parquet(told)
    base = files.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    n = max(1, files.count())
    read = read_records(files.repartition(n, "shard")).drop("ids")
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq"))
    placed = read.withColumn("inside", within - F.col("n_tokens"))
    return placed.join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "data_offset"
    )
