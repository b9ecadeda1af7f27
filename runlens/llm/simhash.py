"""SimHash of words with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Words summed at once: a number holds four sums of 16 bits, the highest of which keeps the sign free.
WORDS_AT_ONCE = 32_767
ONE_BIT_IN_SIXTEEN = 0x0001000100010001
LANES = 16
SEPARATORS = r"[\x00-/:-@\[-`{-\xBF\xD7\xF7]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of all but separators: ASCII and Latin-1 characters that are neither letters nor digits."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _majority(count: Callable[[int], Column], n: Column) -> Column:
    """The number whose bits are those that more than half of n hashes have."""
    bits = [F.when(2 * count(bit) > n, F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0).cast("bigint")) for bit in range(64)]
    return sum(bits[1:], bits[0])


def _count(bit: int) -> Column:
    """How many hashes have the bit: lane i holds the counts of bits i, i + 16, i + 32 and i + 48."""
    return F.shiftrightunsigned(f"l{bit % LANES}", bit // LANES * 16).bitwiseAND(F.lit(0xFFFF))


def with_simhash(df: DataFrame, words: str, key: list[str], work: Workspace, name: str = "sim") -> DataFrame:
    """df's columns but `words`, with the 64-bit SimHash of the array; a bit without a majority is 0. key: names one row each.

    Words are hashed and their bits summed by generated code, 64 sums in 16 numbers. A row with more than WORDS_AT_ONCE
    words is summed in parts, which are added up bit by bit. Rows without words get no result.
    """
    rest = [c for c in df.columns if c not in (words, *key)]
    each = df.select(*key, *rest, F.size(words).alias("_n"), F.posexplode(words).alias("_at", "_w"))
    hashed = each.select(*key, *rest, "_n", F.floor(F.col("_at") / WORDS_AT_ONCE).cast("int").alias("_part"), F.xxhash64("_w").alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(ONE_BIT_IN_SIXTEEN))).alias(f"l{i}") for i in range(LANES)]
    parts = work.keep(hashed.groupBy(*key, *rest, "_part").agg(F.max("_n").alias("_n"), *lanes), "bit-sums")
    whole = parts.where(F.col("_n") <= WORDS_AT_ONCE).select(*key, *rest, _majority(_count, F.col("_n")).alias(name))
    counts = parts.where(F.col("_n") > WORDS_AT_ONCE).groupBy(*key, *rest).agg(F.max("_n").alias("_n"), *[F.sum(_count(bit)).alias(f"b{bit}") for bit in range(64)])
    return whole.unionByName(counts.select(*key, *rest, _majority(lambda bit: F.col(f"b{bit}"), F.col("_n")).alias(name)))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))
