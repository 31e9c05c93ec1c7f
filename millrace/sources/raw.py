"""Raw files of little-endian 32-bit keys, with a block of values behind them or none, as a Spark data source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition and of an Arrow batch.
PARTITION_ROWS, BATCH_ROWS = 1 << 24, 1 << 18

#: What the names of a folder's parts end with.
SUFFIX = ".raw"

#: What is added to a row's position for its value, where the file has none.
R_OFFSET, S_OFFSET = 1, 100_000_001


@dataclass
class Rows(InputPartition):
    """Rows of one file: its path and all its rows; the first of the partition's rows in the file, how many, and the position of the first."""

    path: str
    rows: int
    first: int
    count: int
    position: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}") if path.startswith("/") else fs.FileSystem.from_uri(path)


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.values = options.get("readval", "false").lower() in ("1", "true")
        self.offset = int(options.get("offset", R_OFFSET))
        system, place = opened(self.path)
        found = system.get_file_info(place)
        if found.type == fs.FileType.Directory:
            found = sorted((x for x in system.get_file_info(fs.FileSelector(place)) if x.base_name.endswith(SUFFIX)), key=lambda x: x.base_name)
        else:
            found = [found]
        width = 8 if self.values else 4
        self.files: list[tuple[str, int]] = []
        for x in found:
            if x.size is None or x.size % width:
                raise ValueError(f"{x.path} has {x.size} bytes, which is no number of rows")
            self.files.append((x.path, x.size // width))
        self.rows = sum(n for _, n in self.files)
        if (told := options.get("rows")) is not None and int(told) != self.rows:
            raise ValueError(f"{self.path} has {self.rows} rows, not {told}")
        self.step = int(options.get("partitionrows", PARTITION_ROWS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        before = 0
        for path, rows in self.files:
            out += [Rows(path, rows, a, min(self.step, rows - a), before + a) for a in range(0, rows, self.step)]
            before += rows
        return out or [Rows(self.path, 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = opened(self.path)

        def block(file: pa.NativeFile, at: int, n: int) -> np.ndarray:
            file.seek(at)
            raw = file.read(4 * n)
            if len(raw) != 4 * n:
                raise ValueError(f"{partition.path} ends early")
            return np.frombuffer(raw, "<i4")

        with system.open_input_file(partition.path) as file:
            for a in range(partition.first, partition.first + partition.count, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.first + partition.count - a)
                position = np.arange(n) + (partition.position + a - partition.first)
                val = block(file, 4 * (partition.rows + a), n) if self.values else (position + self.offset).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(position), pa.array(block(file, 4 * a, n)), pa.array(val)], names=["position", "key", "val"])


class RawSource(DataSource):
    """Options: path of a file, or of a folder of parts; rows (an error if the file has another number), readVal, offset (of values made from positions), partitionRows."""

    @classmethod
    def name(cls) -> str:
        return "rawrelation"

    def schema(self) -> str:
        return "position bigint, key int, val int"

    def reader(self, schema: object) -> DataSourceReader:
        return RawReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, rows: int | None = None, read_val: bool = False, offset: int = R_OFFSET) -> DataFrame:
    """(position, key, val) of a raw file, or of a folder of them in the order of their names; each task reads its own range. A file of another length than told, or cut inside a row, is an error."""
    spark.dataSource.register(RawSource)
    reader = spark.read.format("rawrelation").option("path", path).option("readVal", str(read_val)).option("offset", offset)
    return (reader if rows is None else reader.option("rows", rows)).load()


def payload(rel: DataFrame, offset: int, position: str = "position") -> DataFrame:
    """(key, val) with values made from positions."""
    return rel.select("key", (F.col(position) + F.lit(offset)).cast("int").alias("val"))


def positioned(rel: DataFrame) -> DataFrame:
    """The rows, in the order of their partitions, with positions from 0: each partition's rows are counted, and the few counts summed. The rows are kept, so that both passes see the same partitions."""
    local = rel.withColumn("__id", F.monotonically_increasing_id()).persist()
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = local.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    return local.withColumn("__part", part).join(F.broadcast(before), "__part").select((F.col("__before") + place).alias("position"), *rel.columns)


def write_parts(rel: DataFrame, path: str, values: bool = False, rows: int = PARTITION_ROWS) -> None:
    """Writes key (and val) of a relation with positions 0 to n - 1 into a folder of raw files of about `rows` rows each, side by side.

    A part's name is its first position. A task writes under a name of its own and moves the file when it is whole, so a
    task that runs again, or twice, leaves the same parts.
    """
    system, place = opened(path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(place, recursive=True)
    columns = ["key", "val"] if values else ["key"]
    part = F.floor(F.col("position") / F.lit(rows)).cast("bigint").alias("part")
    own = rel.select(part, "position", *(F.col(x).cast("int").alias(x) for x in columns))
    parts = max(1, -(-rel.count() // rows))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                held.clear()
                name = f"{place}/{table['position'][0].as_py():020d}"
                own = f"{name}.{uuid.uuid4().hex}.tmp"
                inner = opened(path)[0]
                with inner.open_output_stream(own) as out:
                    for x in columns:
                        out.write(table[x].to_numpy().astype("<i4").tobytes())
                inner.move(own, f"{name}{SUFFIX}")
                yield pa.RecordBatch.from_arrays([pa.array([table.num_rows])], names=["n"])

        for batch in batches:
            number = np.asarray(batch.column("part"))
            for some in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if len(some):
                    if held and held[-1].column("part")[0].as_py() != int(number[some[0]]):
                        yield from finish()
                    held.append(batch.slice(int(some[0]), len(some)))
        yield from finish()

    dealt = own.repartitionByRange(parts, "part").sortWithinPartitions("part", "position")
    dealt.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


def write(rel: DataFrame, path: str, values: bool = False) -> None:
    """Writes key (and val) of a relation with positions 0 to n - 1 as one raw file.

    The format is one file, which only one writer can append to: the driver gets the blocks of rows in order and holds
    one at a time. For large relations use write_parts, which all tasks write at once.
    """
    system, place = opened(path)
    columns = ["key", "val"] if values else ["key"]
    with system.open_output_stream(place) as out:
        for column in columns:
            ordered = rel.select("position", F.col(column).cast("int").alias("x")).repartitionByRange("position").sortWithinPartitions("position")
            packed = ordered.select("x").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(0)).astype("<i4").tobytes()])], names=["raw"]) for b in batches), "raw binary")
            for row in packed.toLocalIterator():
                out.write(row["raw"])
