"""Lines that many documents share, found in hash order and dropped but in one document; decisions leave as bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, ascii_lower, mapped, operator, partitions, pick, rows_a_batch, saved, slices, small

#: A line counts if its key has so many code points at least, and is dropped if so many documents hold it at least.
LEAST_LENGTH, LEAST_DOCS = 40, 5

#: Stored bytes of lines in a range, which one task streams.
RANGE_BYTES = 32 << 20

LINE = "h1 long, h2 long, doc long, row long, pos int, n_lines int"
RUNS = f"open boolean, part int, {LINE}, n_docs long, low long, high long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, doc, row): doc stands for the id, with the least number for null, and row for the text; together they tell apart all rows that can differ in what they keep."""
    return pick(docs, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("row"))


def lines(rows: DataFrame, least_length: int) -> DataFrame:
    """A row for each line whose key is long enough: 128 bits of the key's hash, the document, the place."""
    cut = rows.select("doc", "row", F.split("text", "\n", -1).alias("all")).select("doc", "row", F.size("all").alias("n_lines"), "all")
    each = cut.select("doc", "row", "n_lines", F.posexplode_outer("all").alias("pos", "line"))
    key = each.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= least_length).withColumn("line", ascii_lower(F.col("line")))
    return key.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "row", "pos", "n_lines")


@dataclass
class Run:
    """The lines of one hash as far as they were streamed: how many documents, the first and the last of them; whether it is its range's first run, which may have begun in another."""

    h1: int
    h2: int
    high: int
    low: int
    n_docs: int
    leads: bool


def runs(sorted_lines: DataFrame, least_docs: int) -> DataFrame:
    """Streams each range of (hash, falling document, place) once. Lines to drop leave as rows.

    The first document of a run is the one that keeps its lines; those of the next ones are held until there are
    least_docs documents, and leave as they come from then on. So a task holds one batch, and the lines of one hash of
    a few documents, however long the run. The first run of a range may go on from others: its lines leave whole,
    marked open. The last one may go on in others: what is held of it leaves as open. Both leave a row with their count.
    """
    names = [x.split()[0] for x in RUNS.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, held = TaskContext.get().partitionId(), None, []

        def rows(some: pa.RecordBatch, is_open: bool) -> pa.RecordBatch:
            nothing = pa.nulls(some.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, is_open)), pa.array(np.full(some.num_rows, part, np.int32)), *some.columns, nothing, nothing, nothing], names=names)

        def count(x: Run) -> pa.RecordBatch:
            values = (True, part, x.h1, x.h2, None, None, None, None, x.n_docs, x.low, x.high)
            kinds = [pa.bool_(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(x).to_numpy() for x in ("h1", "h2", "doc"))
            goes_on = run is not None and (run.h1, run.h2) == (h1[0], h2[0])
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            other = new | np.append(True, doc[1:] != doc[:-1])
            other[0] = not goes_on or doc[0] != run.low
            start, of = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(start[1:], len(doc)) - 1
            seen = np.cumsum(other)
            rank = seen - (seen[start] - other[start])[of]  # which document of its run a line is in, from 1
            n_docs = np.bincount(of[other], minlength=len(start))
            if goes_on:
                rank[: last[0] + 1] += run.n_docs
                n_docs[0] += run.n_docs
            elif run is not None:
                held = []
                if run.leads:
                    yield count(run)
            leads = run is None or goes_on and run.leads
            whole = np.zeros(len(start), bool)
            whole[0] = leads
            drop = (rank >= 2) & ((n_docs >= least_docs) & ~whole)[of]
            if leads:
                yield rows(batch.slice(0, last[0] + 1), True)
            if goes_on and held and n_docs[0] >= least_docs:
                yield from (rows(x, False) for x in held)
                held = []
            if drop.any():
                yield rows(batch.filter(pa.array(drop)), False)
            first = Run(h1[0], h2[0], run.high if goes_on else doc[0], doc[last[0]], int(n_docs[0]), leads)
            if len(start) > 1:
                held = []
                if leads:
                    yield count(first)
                run = Run(h1[-1], h2[-1], doc[start[-1]], doc[-1], int(n_docs[-1]), False)
            else:
                run = first
            if not run.leads and run.n_docs < least_docs:
                held.append(batch.filter(pa.array((of == of[-1]) & (rank >= 2))))
        if run is not None:
            yield from (rows(x, True) for x in held)
            yield count(run)

    return mapped(sorted_lines, stream, RUNS)


@operator(python_last=True)
def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, n_lines, keep): for each document that loses lines, a compressed bitmap of those it keeps.

    A line's key is the line without ASCII white space at its ends and with A-Z in small letters. Keys of at least
    least_length code points that at least least_docs distinct doc_ids hold stay in the largest of these only; rows of
    one doc_id are one document, as are rows without one, whose id counts as the smallest. Null and empty texts hold
    one empty line. An empty table gives no rows. Repeated rows keep the same lines; very long texts are split whole;
    other columns, whatever their names, are ignored. Lines are dealt by ranges of (hash, document, place), so a line
    that a third of all documents share spreads over many tasks.
    """
    spark = docs.sparkSession
    found = saved(lines(keyed(docs, id_col, text_col), least_length), "lines", "lz4")
    order = ["h1", "h2", F.desc("doc"), "row", "pos"]
    with rows_a_batch(spark, 20_000):
        told = saved(runs(found.repartitionByRange(partitions(found, RANGE_BYTES), *order).sortWithinPartitions(*order), least_docs), "runs", "lz4")
    parts = told.where("n_docs is not null")  # two rows for each range at most
    before = F.lag("low").over(W.partitionBy("h1", "h2").orderBy("part"))
    whole = parts.select("h1", "h2", "high", (F.col("n_docs") - F.when(before == F.col("high"), 1).otherwise(0)).alias("n"))
    over = whole.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("high").alias("top")).where(F.col("n") >= least_docs)
    rest = told.where("open and n_docs is null").join(F.broadcast(over), ["h1", "h2"]).where("doc != top")
    place = ["doc", "row", "pos", "n_lines"]
    drops = told.where("not open").select(place).unionByName(rest.select(place))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
                keep = np.ones(n, np.uint8)
                keep[places] = 0
                out.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([*batch.select(["doc", "row", "n_lines"]).columns, pa.array(out, pa.binary())], names=["doc", "row", "n_lines", "keep"])

    each = drops.groupBy("doc", "row").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("places"))
    return mapped(each, bits, "doc long, row long, n_lines int, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    every = text.split("\n")
    if keep is None:
        return every, len(every)
    stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(every)).tolist()
    return [x for x, k in zip(every, stay, strict=True) if k], len(every)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs with their bitmaps, null where all lines stay; others are more columns of docs to keep. bitmaps is a saved table: it is broadcast if it is small, else both sides are shuffled."""
    rows = docs.select(*(docs[x].alias(f"other{i}") for i, x in enumerate(others)), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "row": F.xxhash64("text")})
    return rows.join(small(bitmaps.select("doc", "row", "keep")), ["doc", "row"], "left").drop("doc", "row")


@operator(python_last=True)
def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row, by the bitmaps."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, dropped, sums = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                if keep is None:
                    counts.append(text.count("\n") + 1)
                    dropped.append(0)
                else:
                    stay, n = kept_lines(text, keep)
                    counts.append(n)
                    dropped.append(n - len(stay))
                    text = "\n".join(stay)
                sums.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col)
    return mapped(with_bitmaps(docs, bitmaps, id_col, text_col), digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


@operator(python_last=True)
def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the dropped lines taken out of their texts; all rows and other columns stay, and null texts stay null."""
    bitmaps = keep_bitmaps(docs, least_length, least_docs, id_col, text_col)
    others = [x for x in docs.columns if x not in (id_col, text_col)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x if k is None else "\n".join(kept_lines(x, k)[0]) for x, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            own = pc.if_else(batch.column("null"), None, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], batch.column("doc_id"), own], names=[*batch.schema.names[: len(others)], "doc_id", "text"])

    rows = with_bitmaps(docs.withColumn("\0null", F.col(text_col).isNull()), bitmaps, id_col, text_col, (*others, "\0null")).withColumnRenamed(f"other{len(others)}", "null")
    kinds = {x.name: x.dataType for x in docs.schema}
    fields = [T.StructField(f"other{i}", kinds[x]) for i, x in enumerate(others)]
    out = mapped(rows, apply, T.StructType([*fields, T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    names = {**{x: f"other{i}" for i, x in enumerate(others)}, id_col: "doc_id", text_col: "text"}
    return out.select(*(F.col(names[x]).cast(kinds[x]).alias(x) for x in docs.columns))


#: The same by SQL.
SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from l
), d as (
  select line_key, max(doc_id) as top from k where length(line_key) >= 40 group by line_key having count(distinct doc_id) >= 5
), m as (
  select k.doc_id, k.line, k.pos, d.line_key is not null and k.doc_id <> d.top as dropped from k left join d on k.line_key = d.line_key
)
select doc_id, count(*) as n_lines, cast(sum(case when dropped then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by doc_id
"""
