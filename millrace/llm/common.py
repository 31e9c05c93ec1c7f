"""What the operators of this subpackage share: the input frame, the shared work folder, Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import new_path

#: The ASCII capitals and their small letters, and ASCII white space.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

#: Rows that Spark puts into one Arrow batch for Python; with texts of some 100 KB that is still some MB.
ROWS_A_BATCH = 64

#: Bytes of text that a Python worker handles at once.
BYTES_A_SLICE = 4 << 20

#: A table is broadcast by this package only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by the shared folder, once for each application, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top, raw = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(raw, "w") as out:
            for x in sorted(top.rglob("*.py")):
                out.write(x, x.relative_to(top.parent))
        path = f"{new_path(spark, 'package')}/{top.name}.zip"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
        stream.write(bytearray(raw.getvalue()))
        stream.close()
        context.addPyFile(path)


#: What the operators need of a session while they run: batches for Python bounded by rows, as long texts make rows large, and no files of shuffles that are done.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_A_BATCH), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for what is run inside; then with its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def operator(python_last: bool = False) -> Callable:
    """Marks a function of a DataFrame or a session as an operator: the package is with the executors, and SETTINGS hold while it runs, not longer. Where the result's last step is Python code, which needs them too, the result is saved."""

    def mark(f: Callable) -> Callable:
        @wraps(f)
        def run(first: DataFrame | SparkSession, *args: object, **more: object) -> DataFrame | None:
            spark = first if isinstance(first, SparkSession) else first.sparkSession
            ship(spark)
            with settings(spark, SETTINGS):
                out = f(first, *args, **more)
                return saved(out, "result") if python_last else out

        return run

    return mark


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Larger Arrow batches for what is run inside: rows of a few numbers."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: lost executors cost no recomputation of what is before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a saved table lies in."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def partitions(df: DataFrame, each: int) -> int:
    """How many partitions to deal df into: the session's number, or as many as keep them at about `each` stored bytes."""
    size = stored_bytes(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-size // each) if size < 1 << 58 else 0)  # Spark gives an unknown size as a huge one


def is_small(df: DataFrame) -> bool:
    return stored_bytes(df) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, a saved table, marked for broadcast if its measured size allows; else Spark joins it by shuffling."""
    return F.broadcast(df) if is_small(df) else df


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); other columns, whatever their names, can't clash with an operator's own. Null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BYTES_A_SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `most` bytes of the column, or of one row that has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + (not held), int(np.searchsorted(ends, done + most - size, side="right")))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - done)
            if to < batch.num_rows or size >= most:
                out, held, size = pa.concat_batches(held), [], 0
                yield out
                del out
                release()
            at = to
    if held:
        yield pa.concat_batches(held)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def release() -> None:
    """Gives memory that a worker doesn't need back to the machine; workers stay, and others follow them on it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow, after which the worker holds no more memory than it must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(column):
    """A-Z to small letters, other letters as they are. A text of ASCII only takes the faster general function."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))
