"""Lines of text files, read in byte ranges: a log of any size is searched by many tasks and keeps its line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes in which a null byte marks a file as binary.
BINARY_PREFIX = 8192
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _blocks(spark: SparkSession, places: str | list[str], glob: str) -> DataFrame:
    """(file, block, place, raw): the lines of each byte range that Spark cuts a file into, in their order. A line belongs to the range in which it begins."""
    read = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).text(places)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))


def binary_files(blocks: DataFrame) -> DataFrame:
    """(file) of those with a null byte in their first BINARY_PREFIX bytes. Only files with a null byte in a range near their start are looked at twice."""
    null = F.instr("raw", "\0")
    first = blocks.where(F.col("block") < BINARY_PREFIX)
    marked = first.where(null > 0).groupBy("file").agg(F.min(F.struct("block", "place", F.octet_length(F.substring_index("raw", "\0", 1)).alias("at"))).alias("first"))
    before = first.join(marked, "file").groupBy("file", "first").agg(F.sum(F.when(F.struct("block", "place") < F.struct("first.block", "first.place"), _size(F.col("raw")) + 1).otherwise(0)).alias("bytes"))
    return before.where(F.col("bytes") + F.col("first.at") < BINARY_PREFIX).select("file")


def text_lines(spark: SparkSession, places: str | list[str], glob: str = "*") -> DataFrame:
    """(file, line, text): the lines, numbered from 1, of all files of a name below some folders.

    Lines end at \\n alone; a last line without one counts, and nothing follows the last one. A byte order mark at the start goes, bytes that are no UTF-8
    stay, and a file with a null byte near its start has no lines. The line counts of the ranges are added up file by file; the lines themselves are not
    shuffled, as the first of a range tells the numbers of the others. Files are read twice and must not change meanwhile; one that goes is left out.
    """
    blocks = _blocks(spark, places, glob)
    counts = blocks.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "first").join(binary_files(blocks), "file", "left_anti")
    line = F.col("place") - F.col("first") + F.col("before") + 1
    bare = F.when((line == 1) & F.startswith(F.col("raw").cast("binary"), F.lit(BYTE_ORDER_MARK)), F.substring(F.col("raw").cast("binary"), 4, 1 << 30).cast("string")).otherwise(F.col("raw"))
    return blocks.join(starts, ["file", "block"]).select("file", line.alias("line"), bare.alias("text"))
