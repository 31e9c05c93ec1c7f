"""Bounded-space online best-fit packing of documents' tokens into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, operator, pick, saved, slices
from .tokens import SLICE, encoder, with_end

#: Bins that stay open in one group of pieces.
OPEN_BINS = 8192

#: Pieces that one task packs; each group closes its last bins unfilled, so groups are large.
GROUP_PIECES = 200_000

#: Copies of one piece that go to a group together.
COPIES = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Online best fit with a fixed number of open bins.

    A bitset has bit f set while some open bin has f places free, so the tightest bin for a piece is the lowest set bit
    at or above its length, and the fullest bin the lowest of all. That one closes when there are too many.
    """

    def __init__(self, size: int, most: int = OPEN_BINS) -> None:
        self.size, self.most, self.open, self.made, self.free = size, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def take(self, f: int) -> int:
        out = self.bins[f].pop()
        if not self.bins[f]:
            self.free ^= 1 << f
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """The bin of the next piece, and where in it the piece begins."""
        if fitting := self.free >> length:
            f = length + (fitting & -fitting).bit_length() - 1
            at = self.take(f)
        else:
            if self.open == self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            at, f = self.made, self.size
            self.made += 1
        if f > length:
            self.bins[f - length].append(at)
            self.free |= 1 << (f - length)
            self.open += 1
        return at, self.size - f


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids with the end id; rows longer than size are cut, and the first piece takes what is left over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            ids, lengths = with_end(*encoder(tokenizer).encode(batch.column("text")), end_id)
            many = -(-lengths // size)
            doc = np.repeat(np.arange(len(lengths)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = (lengths - 1) % size + 1
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
            own = np.where(piece == 0, head[doc], size)
            raw = ids.astype("<u4").tobytes()
            at = (np.repeat(np.cumsum(lengths) - lengths, many) + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + own * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(own, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            del ids, raw

    return mapped(pick(docs, id_col, text_col), cut, PIECES)


def pack(cut: DataFrame, size: int, open_bins: int = OPEN_BINS, group: int = GROUP_PIECES) -> DataFrame:
    """The rows of a saved table of pieces with sequence_id and offset.

    Pieces of full length are sequences as they are. The rest, a few numbers a row, is dealt by hash into groups of
    bounded size, and each group is packed in one pass, online: in the order of that hash, each piece as it comes.
    Equal rows are counted before they move and dealt by so many, so that neither repeated rows, nor rows without an id,
    nor a hot document or length makes a large task. Groups and their order follow from the rows alone: a task that
    runs again, or another order of the input, packs the same.
    """
    rest = cut.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))
    names = [x.split()[0] for x in PIECES.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(size, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            batch = batch.select(names).take(pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("copies")))))
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([2 * (base + b) + 1 for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    same = rest.groupBy(*names).agg(F.count("*").alias("many"))
    dealt = same.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("many") - 1).cast("long"), F.lit(COPIES).cast("long"))))
    dealt = dealt.withColumn("copies", F.least(F.lit(COPIES), F.col("many") - F.col("lot"))).withColumn("deal", F.xxhash64(*names, "lot"))
    order = ["deal", *names, "lot"]
    dealt = dealt.repartition(groups, "deal").sortWithinPartitions(*order).select(*names, "copies")
    full = cut.where(F.col("length") == size).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    return full.unionByName(mapped(dealt, fill, f"{PIECES}, sequence_id long, offset long"))


@operator(python_last=True)
def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the ids of all rows into sequences of at most `size` ids.

    Null and empty texts have one piece, the end id; very long texts are cut into pieces of `size` ids, the first of
    which takes what is left over; equal texts and ids, repeated rows and null ids are packed row by row; of bins with
    as much room, the last that came to have it is taken; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    return pack(saved(pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces"), size)
