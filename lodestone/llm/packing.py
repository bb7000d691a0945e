"""Best-fit packing of token sequences.

Best-fit decreasing depends on the lengths alone, and lengths are whole numbers of at most the
capacity. So the plan is made over the histogram of lengths (a row for each length, however many
pieces there are): bins of equal remaining capacity are intervals of bin numbers, a segment tree
over remaining capacities finds the tightest open ones, and the plan's runs go back to the pieces
by their rank in decreasing length. The packing is exactly the one that best-fit decreasing makes
piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.words import encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class SegmentTree:
    """Over remaining capacities 0..size: which of them some open bin has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)

    def put(self, at: int, present: bool) -> None:
        i = at + self.width
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def least_from(self, at: int) -> int | None:
        """The least present capacity >= at."""
        i = at + self.width
        if self.any[i]:
            return at
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for so many pieces of each length.

    Runs (rank, length, per_bin, bin, offset): the pieces from this rank on, in decreasing length,
    go per_bin to a bin, into bins numbered from bin on, each bin filled from offset.
    """
    tree = SegmentTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    runs, rank, bins = [], 0, 0

    def keep(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if remaining not in open_:
                open_[remaining] = []
                tree.put(remaining, True)
            open_[remaining].append((first, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.least_from(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    tree.put(room, False)
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((rank, length, per, first, capacity - room))
                keep(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left:
                # fewer than a bin takes: the last bin of this length
                runs.append((rank, length, per, first, capacity - room))
                keep(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            keep(room, first, n)
    return runs


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, ties: tuple[str, ...] = ()) -> DataFrame:
    """pieces with sequence_id and offset: best-fit decreasing over all of them.

    length: a column of whole numbers from 1 to capacity (rows with null or 0 get null sequence_id
    and offset; longer ones are an error). ties: columns that order pieces of one length; any
    order gives as many sequences. Other columns pass through; own columns of these names are
    replaced. The histogram (at most capacity rows) and a count a partition go to the driver, and
    the plan, whose size depends on the capacity only, is broadcast. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    order, place = storage.free_name(pieces, "order"), storage.free_name(pieces, "place")
    whole = pieces.where(F.col(length) > 0).withColumn(order, -F.col(length))
    rest = pieces.where(~F.coalesce(F.col(length) > 0, F.lit(False)))
    fixed, _ = storage.ranked(whole, order, *ties, name=place)
    fixed = fixed.drop(order)
    histogram = {int(r[0]): r[1] for r in fixed.groupBy(length).agg(F.count("*")).collect()}
    if max(histogram, default=0) > capacity:
        raise ValueError(f"a piece of {max(histogram)} is longer than the capacity {capacity}")
    runs = plan(histogram, capacity)
    out = fixed.mapInArrow(_placer(runs, place, length), _with(fixed.drop(place), "sequence_id long, offset long"))
    return out.unionByName(rest.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))


def _with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def _placer(runs, place, length):
    ranks, _, per, first, offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [[]] * 5))

    def placed(batches):
        for batch in batches:
            rank, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (place, length))
            i = np.searchsorted(ranks, rank, side="right") - 1
            k = rank - ranks[i]
            names = [n for n in batch.schema.names if n != place]
            own = [pa.array(first[i] + k // per[i]), pa.array(offset[i] + k % per[i] * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *own], names=[*names, "sequence_id", "offset"])

    return placed


def token_pieces(docs: DataFrame, path: str, style: str = "word", end_id: int = 1, size: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Each document's ids, with end_id after them, in pieces of at most size ids.

    Returns doc_id, piece, start, length and ids (binary: little-endian unsigned 32-bit). Null and
    empty texts are one piece that holds end_id; null ids stay null; repeated rows give their
    pieces again; an empty table gives none. Very long texts are encoded in parts and give as many
    pieces as they need. Other columns of docs are not read. added: see words.Encoder.
    """

    def cut(batches):
        tok = encoder(path, style, added)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 1024):
                keys, rows = batch.column(0)[at : at + 1024].to_pylist(), []
                for key, ids in zip(keys, tok.encode(texts[at : at + 1024].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(key, k, s, min(size, len(ids) - s), ids[s : s + size].tobytes()) for k, s in enumerate(range(0, len(ids), size))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, path: str, style: str = "word", end_id: int = 1, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Token pieces of docs with their ids, packed: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(storage.settle(token_pieces(docs, path, style, end_id, capacity, added=added)), capacity=capacity, ties=("doc_id", "piece"))


__all__ = ["CAPACITY", "SegmentTree", "pack", "pack_documents", "plan", "token_pieces"]
