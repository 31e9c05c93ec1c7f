"""32-bit unsigned arithmetic on signed 64-bit columns, and the hash and buckets built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF

#: The multipliers of the hash.
FIRST_FACTOR, SECOND_FACTOR = 0x85EBCA6B, 0xC2B2AE35


def u32(key: Column) -> Column:
    """The key's low 32 bits as an unsigned number."""
    return key.cast("bigint").bitwiseAND(F.lit(MASK))


def times(h: Column, factor: int) -> Column:
    """h * factor modulo 2^32 without leaving 64 bits: the factor's upper half only matters for the product's low 16 bits."""
    low, high = factor & 0xFFFF, factor >> 16
    return (h * F.lit(low) + (h * F.lit(high)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(MASK))


def hash32(key: Column, seed: Column | int) -> Column:
    """The filter's hash of a key under a seed, 0 to 2^32 - 1."""
    h = u32(key).bitwiseXOR(F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint"))
    h = times(h, FIRST_FACTOR)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = times(h, SECOND_FACTOR)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def with_hashes(df: DataFrame, key: str, names: dict[str, int]) -> DataFrame:
    """df with columns that hold hash32 of the key under seeds; 0 stands for a null key.

    Each step is a projection of its own, which Catalyst keeps apart as it uses the last one twice; as one expression
    the hash would hold the key sixteen times over, and several of them make code that the JVM won't compile.
    """
    df = df.withColumns({x: u32(F.coalesce(F.col(key), F.lit(0))).bitwiseXOR(F.lit(seed).cast("bigint")) for x, seed in names.items()})
    df = df.withColumns({x: times(F.col(x), FIRST_FACTOR) for x in names})
    df = df.withColumns({x: F.col(x).bitwiseXOR(F.shiftrightunsigned(x, 13)) for x in names})
    df = df.withColumns({x: times(F.col(x), SECOND_FACTOR) for x in names})
    return df.withColumns({x: F.col(x).bitwiseXOR(F.shiftrightunsigned(x, 16)) for x in names})


def modulo(x: Column, n: int) -> Column:
    """x % n of a column that is never null, as one that is never null; else Spark would test each row for it."""
    return F.coalesce(x % F.lit(n).cast("bigint"), F.lit(0).cast("bigint"))


def bucket(key: Column, n: int) -> Column:
    """The unsigned key modulo n; differs from pmod for negative keys."""
    return u32(key) % F.lit(n).cast("bigint")


def slice_of(position: Column, rows: Column | int, slices: int) -> Column:
    """Which of `slices` equal runs of positions a row is in; the last run also has what is left over."""
    each = F.floor((F.lit(rows) if isinstance(rows, int) else rows) / F.lit(slices)).cast("bigint")
    return F.when(each == 0, F.lit(slices - 1)).otherwise(F.least(F.floor(position / F.greatest(each, F.lit(1))), F.lit(slices - 1))).cast("bigint")


def chunk_of(place: Column, rows: Column, chunks: int) -> Column:
    """Which of `chunks` pieces of a slice a row is in, by its place in the slice; a piece has the quotient rounded up."""
    return F.floor(place / F.greatest(F.ceil(rows / F.lit(chunks)), F.lit(1))).cast("bigint")
