"""Token ids in files: a static range asymmetric numeral system over interleaved lanes.

A file set is a folder with two tables. `tables` has one row, the shared frequency table. `blocks`
has a row for each block: part and block (their order is the documents'), base (ids of the part
before it), n_ids, and payload, the block's bytes:

    magic "LRB1", then little-endian u32: crc32 of what follows, lanes, ids, documents, steps
    between checkpoints, checkpoints, words; then document ids (i64), their null flags (u8), lengths
    (u32), checkpoints' word offsets (u32), lane states (u64 for each lane: the start's, then each
    checkpoint's), words (u32).

Id i is lane i mod lanes at step i div lanes. A block needs nothing but the frequency table, and
each checkpoint lets a decoder start in the midst of it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.words import encoder

BITS = 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(0xFFFFFFFF)
_HEAD = struct.Struct("<4s8I")
LANES, EVERY, BLOCK = 1024, 64, 1 << 18


class Corrupt(ValueError):
    """A block's bytes are not those that were written."""


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2^bits; at least 1 for what occurs."""
    counts, size = np.asarray(counts, np.float64), 1 << bits
    used = counts > 0
    if used.sum() > size // 2:
        raise ValueError("too many distinct ids for this precision")
    if not used.any():
        return np.zeros(len(counts), np.int64)
    freq = np.where(used, np.maximum(1, np.floor(counts * (size / counts.sum()))), 0).astype(np.int64)
    while over := int(freq.sum()) - size:
        top = np.argsort(-freq, kind="stable")[: max(1, min(abs(over), int(used.sum()) // 8))]
        share = abs(over) // len(top)
        freq[top] -= np.minimum(share, freq[top] // 2) if over > 0 else -share
    return freq


class Tables:
    """What coding needs, from the frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY):
        """(lane states at the start, checkpoints' word offsets, their states, words)."""
        n = len(ids)
        if n and (ids.max() >= len(self.freq) or not self.freq[ids].all()):
            raise ValueError("an id that the frequency table lacks")
        freq, cum, shift = self.freq[ids], self.cum[ids], np.uint64(63 - self.bits)
        x, out, marks, told = np.full(lanes, _LOW, np.uint64), [], [], 0
        for t in range(-(-n // lanes) - 1, -1, -1):
            s, e = t * lanes, min(n, (t + 1) * lanes)
            f, y = freq[s:e], x[: e - s]
            big = y >= f << shift
            words = (y[big] & _WORD).astype(np.uint32)
            out.append(words)
            told += len(words)
            y = np.where(big, y >> np.uint64(32), y)
            q = y // f
            x[: e - s] = (q << np.uint64(self.bits)) + (y - q * f) + cum[s:e]
            if t and t % every == 0:
                marks.append((told, x.copy()))
        marks.reverse()
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return x, np.array([told - m[0] for m in marks], np.uint32), np.array([m[1] for m in marks], np.uint64).reshape(-1, lanes), words

    def decode(self, x: np.ndarray, words: np.ndarray, n: int, first: int = 0, steps: int | None = None) -> np.ndarray:
        """Ids of the steps from first on, given the state and the words there; n: ids of the block."""
        lanes, x = len(x), x.copy()
        last = -(-n // lanes)
        last = last if steps is None else min(last, first + steps)
        out, p, low, bits = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32), 0, np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(first, last):
            k = min(n - t * lanes, lanes)
            y = x[:k]
            slot = y & low
            s = self.symbol[slot]
            out[(t - first) * lanes : (t - first) * lanes + k] = s
            y = self.freq[s] * (y >> bits) + slot - self.cum[s]
            need = np.flatnonzero(y < _LOW)
            y[need] = (y[need] << np.uint64(32)) | words[p : p + len(need)]
            p += len(need)
            x[:k] = y
        return out


def pack_block(tables: Tables, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    lanes = min(LANES, 1 << max(0, (len(ids) // 16).bit_length() - 1)) if len(ids) >= 16 else 1
    start, offsets, states, words = tables.encode(ids, lanes)
    body = b"".join(a.astype(t).tobytes() for a, t in ((doc_ids, "<i8"), (nulls, "u1"), (lengths, "<u4"), (offsets, "<u4"), (start, "<u8"), (states, "<u8"), (words, "<u4")))
    head = struct.pack("<7I", lanes, len(ids), len(doc_ids), EVERY, len(offsets), len(words), 0)
    return struct.pack("<4sI", b"LRB1", zlib.crc32(head + body)) + head + body


class Block:
    """A block's parts, its checksum verified."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size or data[:4] != b"LRB1" or zlib.crc32(data[8:]) != struct.unpack_from("<I", data, 4)[0]:
            raise Corrupt("a block's checksum differs")
        _, _, self.lanes, self.n, docs, self.every, marks, words, _ = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.nulls, self.lengths = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs)
        self.offsets, self.start = take("<u4", marks), take("<u8", self.lanes)
        self.states, self.words = take("<u8", marks * self.lanes).reshape(marks, self.lanes), take("<u4", words)

    def ids(self, tables: Tables, segment: int | None = None) -> np.ndarray:
        """All ids, or those from one checkpoint (0: the start) to the next."""
        if segment is None:
            return tables.decode(self.start, self.words, self.n)
        x, at = (self.start, 0) if segment == 0 else (self.states[segment - 1], int(self.offsets[segment - 1]))
        return tables.decode(x, self.words[at:], self.n, segment * self.every, self.every)


def _narrow(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _binary(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of these arrays' bytes."""
    ends = np.cumsum([0, *(p.nbytes for p in parts)])
    data = pa.py_buffer(np.concatenate(parts).tobytes() if parts else b"")
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.astype("<i4").tobytes()), data])
    return pa.array([p.tobytes() for p in parts], pa.binary())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, style: str = "byte", end_id: int = 2, vocabulary: int = 50258, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> None:
    """Encode every text and write the ids, in ascending order of document ids, to a new folder at path.

    Null texts count as empty (end_id alone); null ids come first; rows of one id are ordered by a
    digest of their ids, so that only rows that are equal in all could change places; an empty
    table gives a folder without blocks; very long texts are encoded in parts. Texts are encoded
    where they lie, and only their ids are sorted, by ranges in which a drawn number parts equal
    rows too. Of the corpus only the counts of ids (at most the vocabulary) go to the driver. A
    document is never split, so a block holds about 2^18 ids, or one longer document. added: see
    words.Encoder.
    """
    kind = _narrow(vocabulary)

    def tokenise(batches):
        tok, total = encoder(tokenizer, style, added), np.zeros(vocabulary, np.int64)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ["k", "ids", "id", "n"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = batch.slice(at, 512)
                ids = [np.append(x, np.uint32(end_id)) for x in tok.encode(got.column(1).to_pylist())]
                total += np.bincount(np.concatenate(ids), minlength=vocabulary)
                yield pa.RecordBatch.from_arrays([got.column(0), _binary([x.astype(kind) for x in ids]), pa.nulls(len(ids), kinds[2]), pa.nulls(len(ids), kinds[3])], names=names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None], kinds[0]), pa.array([None], kinds[1]), pa.array([used.astype(np.int32)], kinds[2]), pa.array([total[used]], kinds[3])], names=names)

    spark = docs.sparkSession
    coded = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(tokenise, "k long, ids binary, id array<int>, n array<long>")
    coded = storage.settle(coded.withColumns({"tie": F.xxhash64("ids"), "drawn": F.rand(17)}))
    counts = np.zeros(vocabulary, np.int64)
    pairs = coded.where("n is not null").select(F.inline(F.arrays_zip("id", "n"))).groupBy("id").agg(F.sum("n").alias("n"))
    for i, n in pairs.collect():
        counts[i] = n
    freq = quantise(counts)

    def code(batches):
        tables, part, block, base, size = Tables(freq), TaskContext.get().partitionId(), 0, 0, 0
        keys, nulls, lengths, held = [], [], [], []

        def row():
            nonlocal keys, nulls, lengths, held, block, base, size
            data = pack_block(tables, np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths), np.concatenate(held))
            values = (part, block, base, size, data)
            block, base, size, keys, nulls, lengths, held = block + 1, base + size, 0, [], [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "base", "n_ids", "payload"])

        for batch in batches:
            key, column = batch.column(0), batch.column(1)
            null, key = np.asarray(key.is_null()), key.fill_null(0).to_numpy()
            begin = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset).astype(np.int64) // np.dtype(kind).itemsize
            ids, at = np.frombuffer(column.buffers()[2], kind), 0
            while at < len(key):
                to = min(len(key), int(np.searchsorted(begin, begin[at] + BLOCK - size)))
                keys.append(key[at:to])
                nulls.append(null[at:to].astype(np.uint8))
                lengths.append(np.diff(begin[at : to + 1]))
                held.append(ids[begin[at] : begin[to]].copy())
                size += len(held[-1])
                at = to
                if size >= BLOCK:
                    yield row()
        if size:
            yield row()

    ordered = coded.where("n is null").select("k", "ids", "tie", "drawn").repartitionByRange("k", "tie", "drawn").sortWithinPartitions("k", "tie", "ids")
    ordered.select("k", "ids").mapInArrow(code, "part int, block int, base long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(BITS, bytearray(freq.astype("<i8").tobytes()))], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/tables")
    storage.forget(coded)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Every document of the folder at path, from its blocks: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the little-endian unsigned 32-bit ids), ids (that binary;
    left out unless keep_ids). A block whose checksum differs is an error. Of the blocks only a
    count a part goes to the driver.
    """
    bits, freq = spark.read.parquet(f"{path}/tables").first()
    freq = np.frombuffer(bytes(freq), "<i8")
    blocks = spark.read.schema("part int, block int, base long, n_ids long, payload binary").parquet(f"{path}/blocks")
    starts, total = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect())):
        starts[part] = total
        total += n

    def decode(batches):
        tables = Tables(freq, bits)
        for batch in batches:
            for part, base, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(payload)
                ids, ends = block.ids(tables).astype("<u4"), np.cumsum(block.lengths.astype(np.int64))
                begins = ends - block.lengths
                data = memoryview(ids.tobytes())
                parts = [data[4 * s : 4 * e] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(block.doc_ids, pa.int64(), mask=block.nulls), pa.array(starts[part] + base + begins, pa.int64()), pa.array(block.lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([bytes(p) for p in parts], pa.binary())] if keep_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    return blocks.select("part", "base", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
