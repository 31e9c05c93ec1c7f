"""Token ids in files of blocks under one length-limited canonical Huffman code, and their decoding by table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, operator, partitions, pick, saved, slices
from .tokens import SLICE, WORDS_KEPT, encoder, with_end

#: Longest code in bits; a decoding table has two to this power entries.
LONGEST = 18

#: Ids after which a block ends, with the document that reaches it.
BLOCK_IDS = 1 << 17

#: Ids between two checkpoints; a block is decoded at all its checkpoints at once.
STRIDE = 128

#: Stored bytes of documents in a shard.
SHARD_BYTES = 256 << 20

HEAD = "shard int, first long, n_ids long, doc_ids array<long>, doc_lengths array<int>"
BLOCKS = f"{HEAD}, bits long, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code with no code above `longest` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} symbols can't have codes of at most {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        leaves.append(rank < n)
        level = both[rank]
    lengths, chosen = np.zeros(n, np.uint8), 2 * n - 2
    for own in reversed(leaves):
        alone = int(own[:chosen].sum())
        lengths[:alone] += 1
        chosen = 2 * (chosen - alone)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: shorter codes first, then smaller ids. Its lengths say all."""

    lengths: np.ndarray
    longest: int = LONGEST

    @cached_property
    def order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.lexsort((used, self.lengths[used]))]

    @cached_property
    def codes(self) -> np.ndarray:
        """Each id's code in its low bits."""
        n = self.lengths[self.order].astype(np.int64)
        steps = np.left_shift(np.int64(1), self.longest - n)
        out = np.zeros(len(self.lengths), np.uint64)
        out[self.order] = ((np.cumsum(steps) - steps) >> (self.longest - n)).astype(np.uint64)
        return out

    @cached_property
    def table(self) -> np.ndarray:
        """For each string of `longest` bits, the id whose code it begins with, times 32, plus that code's length."""
        n = self.lengths[self.order].astype(np.int64)
        out = np.repeat((self.order << 5 | n).astype(np.uint32), 1 << (self.longest - n))
        return np.concatenate([out, np.full((1 << self.longest) - len(out), 1, np.uint32)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, int, bytes]:
        """The codes of the ids in 32-bit big-endian words, their bits, and the bit at which each STRIDE-th id begins."""
        n = self.lengths[ids]
        ends = np.cumsum(n, dtype=np.int64 if len(ids) > 1 << 26 else np.int32)
        starts, bits = ends - n, int(ends[-1]) if len(ends) else 0
        if not bits:
            return b"", 0, b""
        word = starts >> 5
        wide = self.codes[ids] << (64 - n - (starts & 31).astype(np.uint8)).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=word.dtype.type(-1)))  # a code is shorter than a word, so each word has a first code
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[new]] = np.add.reduceat(wide >> np.uint64(32), new)
        out[word[new] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), new)
        return out.astype(">u4").tobytes(), bits, starts[::STRIDE].astype("<u8").tobytes()

    def decode(self, payload: bytes, n_ids: int, checkpoints: bytes) -> np.ndarray:
        """All ids of a block, by a step of the table at every checkpoint at once."""
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out, last = np.empty((STRIDE, len(at)), np.uint32), len(window) - 1
        for k in range(STRIDE):
            found = self.table[(window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.longest)]
            out[k] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:n_ids]


def planes(ids: np.ndarray, wide: int) -> bytes:
    """Ids of `wide` bytes as they lie between two steps: all their low bytes, then the next, which compresses well."""
    return np.ascontiguousarray(ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes()


def unplanes(raw: bytes, wide: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).reshape(-1).view(f"<u{wide}")


def token_runs(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, wide: int, id_col: str, text_col: str) -> DataFrame:
    """Rows in ascending doc_id order, in runs that each become a block: their ids, and where in its shard each run begins. The last row of a shard has no run, but how often each id occurs in the shard."""
    arrow = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("counted", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(values, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, total = TaskContext.get().partitionId(), 0, np.zeros(vocabulary, np.int64)
        for batch in slices(batches, most=2 * SLICE):
            ids, lengths = with_end(*encoder(tokenizer, 2 * WORDS_KEPT).encode(batch.column("text")), end_id)
            ends, docs = np.cumsum(lengths), batch.column("doc_id").to_pylist()
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(BLOCK_IDS, ends[-1], BLOCK_IDS)) + 1, len(ends))).tolist()
            for a, b in zip([0, *cuts], cuts, strict=False):
                i, j = int(ends[a] - lengths[a]), int(ends[b - 1])
                yield row(shard, first + i, j - i, docs[a:b], lengths[a:b].tolist(), planes(ids[i:j], wide), None, None)
            total += np.bincount(ids, minlength=vocabulary)
            first += len(ids)
        used = np.flatnonzero(total)
        yield row(shard, first, 0, None, None, None, used, total[used])

    rows = pick(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs, SHARD_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return mapped(rows.select("doc_id", "text"), run, f"{HEAD}, ids binary, counted array<long>, counts array<long>")


def global_counts(runs: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all shards. A shard has a count for each id at most, and so has the sum that reaches the driver."""
    each = runs.where("counts is not null").select(F.explode(F.arrays_zip("counted", "counts")).alias("x"))
    counts = np.zeros(vocabulary, np.int64)
    for row in each.groupBy("x.counted").agg(F.sum("x.counts").alias("n")).collect():
        counts[row["counted"]] = row["n"]
    return counts


@operator()
def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all rows, each document's followed by the end id, in ascending doc_id order.

    The format: `path/code` has the code's length for each id that occurs; `path/blocks/shard=K` has the blocks of the
    K-th range of doc_id, each of whole documents, with its first id's place in the shard, the documents' ids and
    lengths, the bits, and the bit offset of every STRIDE-th id. A block is decoded without any other. Spark's commit
    protocol writes it, so a lost executor leaves neither gaps nor doubles.

    Null and empty texts have the end id alone; rows of the same doc_id, and rows without one, which come first, are
    ordered by a hash of their text; repeated rows are written as often as they come; an empty table gives files without
    blocks; other columns, whatever their names, are ignored. A very long text is one block, whose offsets have 64 bits.
    Texts move, not ids: those of a vocabulary of 16 bits are as large as the compressed texts, and would be saved before.
    """
    spark = docs.sparkSession
    vocabulary = max(encoder(tokenizer).vocabulary, end_id + 1)
    wide = 2 if vocabulary <= 1 << 16 else 4
    runs = saved(token_runs(docs, tokenizer, end_id, vocabulary, wide, id_col, text_col), "runs")
    code = Code(code_lengths(global_counts(runs, vocabulary), longest), longest)
    lengths = [(int(i), int(code.lengths[i])) for i in np.flatnonzero(code.lengths)]
    spark.createDataFrame(lengths, "id int, length int").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [code.encode(unplanes(x.as_py(), wide)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[1] for x in coded], pa.int64()), pa.array([x[0] for x in coded], pa.binary()), pa.array([x[2] for x in coded], pa.binary())],
                names=[*batch.schema.names[:-1], "bits", "payload", "checkpoints"],
            )

    blocks = mapped(runs.where("counts is null").drop("counted", "counts"), encode, BLOCKS).sortWithinPartitions("shard", "first")
    blocks.write.option("compression", "uncompressed").partitionBy("shard").parquet(f"{path}/blocks")


@operator(python_last=True)
def read(spark: SparkSession, path: str, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, decoded from the files. start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers."""
    rows = spark.read.schema("id int, length int").parquet(f"{path}/code").collect()  # a row for each id of the vocabulary at most
    code = Code(np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.uint8), longest)
    for r in rows:
        code.lengths[r["id"]] = r["length"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = code.decode(row["payload"], row["n_ids"], row["checkpoints"]).astype("<u4").tobytes()
                own = [raw[a:b] for a, b in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + row["first"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 4 + with_ids], names=names[: 4 + with_ids])

    return mapped(blocks.join(F.broadcast(before), "shard"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
