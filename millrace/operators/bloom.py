"""A Bloom filter of known size as a table, its merging, and what passes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MASK, bucket, modulo, u32, with_hashes

#: Bits of a block and of a word.
BLOCK, WORD = 256, 32

#: Bytes of filter that go to all tasks at once, and how often S is read for it at most; a larger filter is shuffled.
BROADCAST_BYTES, MOST_PASSES = 16 << 20, 8

#: Where a key's bits are: inside one block under a seed for each hash; inside one block, or over all bits, by two hashes; over all bits under a seed for each hash.
LAYOUTS = ("blocked", "blocked_double", "double", "plain")


@dataclass(frozen=True)
class Shape:
    """Bits, a multiple of the block; hashes; and for a partitioned filter its segments, of so many bits each."""

    bits: int
    hashes: int
    layout: str = "blocked"
    segments: int = 0

    def __post_init__(self) -> None:
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout is one of {LAYOUTS}")
        if self.segments and self.layout != "blocked":
            raise ValueError("segments need the blocked layout")

    @property
    def whole(self) -> int:
        """Bits rounded up to whole blocks; of a segment, if there are any."""
        bits = self.bits // self.segments if self.segments else self.bits
        return max(BLOCK, -(-bits // BLOCK) * BLOCK)

    @property
    def words(self) -> int:
        """Words of all segments."""
        return self.whole // WORD * max(1, self.segments)

    @property
    def passes(self) -> int:
        """How often S is read so that no part of the filter that is sent is too large; 0 if that is too often."""
        n = max(1, -(-8 * (self.words // 2) // max(1, BROADCAST_BYTES))) if BROADCAST_BYTES > 0 else MOST_PASSES + 1
        return n if n <= MOST_PASSES else 0


def with_bits(df: DataFrame, shape: Shape) -> DataFrame:
    """df with the segment __seg of its key, the block __block if there are any, and its bits __bit0, __bit1, ..., counted from the block's or else the filter's first."""
    double, blocked = "double" in shape.layout, "blocked" in shape.layout
    first = 0 if shape.layout == "plain" else 1
    seeds = {f"__h{i}": i for i in ((1, 2) if double else range(min(first, 1), shape.hashes + first))}
    df = with_hashes(df, "key", seeds)
    one = [F.col("__h1") + F.lit(i) * F.col("__h2") if double else F.col(f"__h{i + first}") for i in range(shape.hashes)]
    if double:
        one = [x.bitwiseAND(F.lit(MASK)) for x in one]
    seg = modulo(u32(F.coalesce("key", F.lit(0))), shape.segments) if shape.segments else F.lit(0).cast("bigint")
    out = {"__seg": seg}
    if blocked:
        out["__block"] = modulo(F.col("__h1"), shape.whole // BLOCK)
    out |= {f"__bit{i}": x.bitwiseAND(F.lit(BLOCK - 1)) if blocked else modulo(x, shape.whole) for i, x in enumerate(one)}
    return df.withColumns(out).drop(*seeds)


def build(r: DataFrame, shape: Shape, *by: str) -> DataFrame:
    """([by,] seg, word, bits): the filter's words that have bits, of R's keys. `by` builds one filter for each slice."""
    if not shape.hashes:
        return r.select(*by, F.lit(0).cast("bigint").alias("seg"), F.lit(0).cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("bits")).limit(0)
    rows = with_bits(r.where("key is not null").select(*by, "key"), shape)
    base = F.col("__block") * BLOCK if "blocked" in shape.layout else F.lit(0)
    rows = rows.select(*by, F.col("__seg").alias("seg"), base.alias("base"), F.explode(F.array(*(f"__bit{i}" for i in range(shape.hashes)))).alias("bit"))
    word = rows.select(*by, "seg", F.shiftright(F.col("base") + F.col("bit"), 5).alias("word"), F.expr(f"shiftleft(1L, cast(bit & {WORD - 1} as int))").alias("bits"))
    return word.groupBy(*by, "seg", "word").agg(F.bit_or("bits").alias("bits"))


def build_with_histogram(r: DataFrame, shape: Shape, partitions: int) -> DataFrame:
    """(kind, place, value) from one reading of R: the words of a filter without segments, and the rows of each first-level bucket, empty ones too."""
    rows = with_bits(r.where("key is not null").select("key"), shape)
    base = F.col("__block") * BLOCK if "blocked" in shape.layout else F.lit(0).cast("bigint")
    one = lambda bit: F.expr(f"shiftleft(1L, cast({bit} & {WORD - 1} as int))")
    row = lambda kind, place, bits, n: F.struct(F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), bits.cast("bigint").alias("bits"), F.lit(n).cast("bigint").alias("n"))
    each = [row("word", F.shiftright(base + F.col(f"__bit{i}"), 5), one(f"__bit{i}"), 0) for i in range(shape.hashes)]
    each.append(row("bucket", bucket(F.col("key"), partitions), F.lit(0), 1))
    empty = r.sparkSession.range(partitions).select(F.lit("bucket").alias("kind"), F.col("id").alias("place"), F.lit(0).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("n"))
    spread = rows.select(F.explode(F.array(*each)).alias("x")).select("x.*").unionByName(empty)
    return spread.groupBy("kind", "place").agg(F.when(F.col("kind") == "word", F.bit_or("bits")).otherwise(F.sum("n")).alias("value"))


def merge(words: DataFrame) -> DataFrame:
    """One filter of several: the union of their bits. Every way to exchange filters between machines computes this; Spark does it by partial and final aggregation."""
    return words.groupBy("seg", "word").agg(F.bit_or("bits").alias("bits"))


def merge_by_bits(words: DataFrame) -> DataFrame:
    """merge() by way of one number for each bit, their maxima, and words packed again."""
    spread = words.select("seg", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("place"))
    one = spread.select("seg", "word", "place", F.expr("shiftrightunsigned(bits, place) & 1").alias("bit"))
    high = one.groupBy("seg", "word", "place").agg(F.max("bit").alias("bit"))
    return high.groupBy("seg", "word").agg(F.sum(F.expr("shiftleft(bit, place)")).cast("bigint").alias("bits"))


def fill(words: DataFrame, shape: Shape) -> DataFrame:
    """(set_bits, all_bits, ratio) of a filter."""
    whole = shape.whole * max(1, shape.segments)
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("set_bits")).withColumns({"all_bits": F.lit(whole).cast("bigint"), "ratio": F.col("set_bits") / F.lit(float(whole))})


def packed(words: DataFrame, shape: Shape, first: int, n: int) -> DataFrame:
    """One row with an array of n numbers: pairs of the filter's words from the first pair on, zeros where it has no bits. Its size is bounded by BROADCAST_BYTES."""
    at = F.col("seg") * (shape.whole // WORD) + F.col("word")
    half = words.select(F.shiftright(at, 1).alias("place"), F.when(at.bitwiseAND(F.lit(1)) == 1, F.shiftleft("bits", 32)).otherwise(F.col("bits")).alias("bits"))
    own = half.where((F.col("place") >= first) & (F.col("place") < first + n))
    zeros = words.sparkSession.range(first, first + n, 1, 1).select(F.col("id").alias("place"), F.lit(0).cast("bigint").alias("bits"))
    every = own.unionByName(zeros).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bits"))), lambda x: x["bits"]).alias("filter"))


def probed(s: DataFrame, words: DataFrame, shape: Shape, flag: str | None) -> DataFrame:
    """passing() where S stays: each task gets the filter, or a part of it for each time that S is read, as one array in which it looks up its keys' bits."""
    columns, n = s.columns, shape.words // 2
    own = with_bits(s if flag else s.where("key is not null"), shape)
    base = F.col("__seg") * F.lit(shape.whole)
    if "blocked" in shape.layout:
        base = base + F.col("__block") * F.lit(BLOCK)
    if shape.passes > 1:  # whole blocks; a pass takes the keys whose block is in its part
        if "blocked" not in shape.layout:
            return shuffled(s, words, shape, flag)
        step = -(-n // shape.passes // (BLOCK // 64)) * (BLOCK // 64)
    else:
        step = n
    # a column of which Catalyst can't know that it is always the same keeps the test above the hashes' projections; pushed below, it would hold each of them many times over
    own = own.withColumn("__base", F.when(F.monotonically_increasing_id() >= 0, base))
    out = None
    for first in range(0, n, step):
        many = min(step, n - first)
        part = own if step >= n else own.where((F.col("__base") >= first * 64) & (F.col("__base") < (first + many) * 64))
        bits = [F.col("__base") + F.col(f"__bit{i}") - F.lit(first * 64) for i in range(shape.hashes)]
        array = packed(words, shape, first, many).scalar()
        part = part.withColumns({f"__at{i}": x for i, x in enumerate(bits)})
        test = F.col("key").isNotNull()
        for i in range(shape.hashes):
            word = F.get(array, F.shiftright(F.col(f"__at{i}"), 6).cast("int"))
            test &= F.call_function("shiftrightunsigned", word, F.col(f"__at{i}").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        part = part.withColumn(flag, F.coalesce(test, F.lit(False))).select(*columns, flag) if flag else part.where(test).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def passing(s: DataFrame, words: DataFrame, shape: Shape, flag: str | None = None) -> DataFrame:
    """The rows of S whose key has all its bits in the filter; with `flag`, all rows, and whether they have.

    The filter's size follows from its shape alone. Up to BROADCAST_BYTES it goes to all tasks, and S is filtered where
    it is, in one pass with its scan. Up to MOST_PASSES times that, S is read once for each part of the filter, which
    costs less than to move it. Beyond, S moves once, to the filter's blocks. Null keys pass nothing. Without hashes
    every other row passes.
    """
    if not shape.hashes:
        return s.withColumn(flag, F.col("key").isNotNull()) if flag else s.where("key is not null")
    return probed(s, words, shape, flag) if shape.passes else shuffled(s, words, shape, flag)


def shuffled(s: DataFrame, words: DataFrame, shape: Shape, flag: str | None) -> DataFrame:
    """passing() by a join. In the blocked layouts one join brings a key its block, as eight words; in the others there is one join for each hash. Spark splits hot blocks."""
    columns = s.columns
    own = with_bits(s if flag else s.where("key is not null"), shape)
    test = F.col("key").isNotNull()
    has = lambda word, bit: F.call_function("shiftrightunsigned", word, F.col(bit).bitwiseAND(F.lit(WORD - 1)).cast("int")).bitwiseAND(F.lit(1)) == 1
    if "blocked" in shape.layout:
        eight = BLOCK // WORD
        block = words.groupBy("seg", F.shiftright("word", 3).alias("block")).agg(*(F.max(F.when(F.col("word").bitwiseAND(F.lit(eight - 1)) == i, F.col("bits"))).alias(f"w{i}") for i in range(eight)))
        block = block.select(F.col("seg").alias("__s"), F.col("block").alias("__b"), F.array(*(F.coalesce(f"w{i}", F.lit(0).cast("bigint")) for i in range(eight))).alias("__words"))
        own = own.join(block, (F.col("__seg") == F.col("__s")) & (F.col("__block") == F.col("__b")), "left" if flag else "inner")
        for i in range(shape.hashes):
            test &= has(F.get("__words", F.shiftright(f"__bit{i}", 5).cast("int")), f"__bit{i}")
    else:
        for i in range(shape.hashes):
            side = words.select(F.col("word").alias(f"__x{i}"), F.col("bits").alias(f"__bits{i}"))
            own = own.join(side, F.shiftright(f"__bit{i}", 5) == F.col(f"__x{i}"), "left" if flag else "inner")
            test &= has(F.col(f"__bits{i}"), f"__bit{i}")
    if flag:
        return own.withColumn(flag, F.coalesce(test, F.lit(False))).select(*columns, flag)
    return own.where(test).select(*columns)


def candidate_rate(s: DataFrame, words: DataFrame, shape: Shape) -> DataFrame:
    """(rows, candidates, percent): how many rows of S pass."""
    out = passing(s, words, shape, "pass").agg(F.count("*").alias("rows"), F.count_if("pass").alias("candidates"))
    return out.withColumn("percent", F.when(F.col("rows") > 0, F.col("candidates") * 100.0 / F.col("rows")).otherwise(0.0))


def candidate_histogram(s: DataFrame, words: DataFrame, shape: Shape, partitions: int) -> DataFrame:
    """(b1, candidates): rows of S that pass, by their first-level bucket. Rows move only if the filter is shuffled."""
    return passing(s, words, shape).groupBy(bucket(F.col("key"), partitions).alias("b1")).agg(F.count("*").alias("candidates"))
