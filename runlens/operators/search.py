"""Search over log lines: each hit is a path, a line number and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import line_predicate
from ..plans.filters import Filter
from ..schema import Tables
from .paths import paths
from .texts import first_lines
from .where import describe

#: Bytes in which a null byte marks a file as binary.
BINARY_PREFIX = 8192


def lines(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, line, text): lines from 1. A byte order mark at the start goes, a last line without a line feed counts, nothing
    follows the last line feed, and a file with a null byte near its start has no lines."""
    whole = F.regexp_replace(F.col(text), "^﻿", "")
    binary = F.instr(F.substring(F.col(text).cast("binary"), 1, BINARY_PREFIX).cast("string"), "\x00") > 0
    split = F.split(whole, "\n", -1)
    own = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return files.where(~binary).select(*keep, F.posexplode(own).alias("line", "text")).withColumn("line", F.col("line") + 1)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt to all cores where they come in fewer partitions, as from one row group; a large input stays as it is."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def grep(log_lines: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, within: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Lines that hold the pattern, of all files or of those that `within` lists by key."""
    hits = log_lines.where(line_predicate(F.col("text"), pattern, fixed, ignore_case))
    return hits if within is None else hits.join(within.select(key).distinct(), key, "left_semi")


def grep_units(tables: Tables, f: Filter, pattern: str, kinds: tuple[str, ...] | None = None, more_lines: DataFrame | None = None, fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """Hits (path, line, text) in the files that a filter selects; without kinds in logs and extracted files.

    Lines come from tables.log_lines and from more_lines (path, line, text), which holds those of extracted files or documents.
    """
    if kinds is not None and "artifact" in kinds:
        raise ValueError("archives can't be searched; expand them first")
    own = tables.log_lines.select("path", "line", "text")
    own = own if more_lines is None else own.unionByName(more_lines.select("path", "line", "text"))
    return grep(own, pattern, fixed, ignore_case, within=paths(tables, f, kinds))


def enriched_hits(hits: DataFrame, tables: Tables) -> DataFrame:
    """Hits with the run, attempt, job or artifact that each path names."""
    return describe(hits, tables)


def unreadable(wanted: DataFrame, log_lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason) of selected files that no lines were read from: those that went, and binary ones. Empty files have none."""
    unread = wanted.select("path").distinct().join(log_lines.select("path").distinct(), "path", "left_anti")
    sized = unread.join(files.groupBy("path").agg(F.max("length").alias("length")), "path", "left")
    return sized.where("length is null or length > 0").select("path", F.when(F.col("length").isNull(), "missing").otherwise("binary").alias("reason"))


def files_with_matches(hits: DataFrame, key: str = "path") -> DataFrame:
    """Each file with a hit, once."""
    return hits.select(key).distinct()


def with_context(log_lines: DataFrame, hits: DataFrame, around: int, key: str = "path") -> DataFrame:
    """Hits and the lines up to `around` lines from one, each once, with `is_hit`. Hits spread by number and join by equality."""
    near = hits.select(key, F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"), F.col("line").alias("of"))
    wanted = near.groupBy(key, "line").agg(F.bool_or(F.col("of") == F.col("line")).alias("is_hit"))
    return log_lines.join(wanted, [key, "line"])


def top_lines(hits: DataFrame, k: int | None = None) -> DataFrame:
    """How often each text occurs without its time stamp, most often first; k leads to a bounded sort."""
    bare = F.regexp_replace("text", r"^\d{4}-\d\d-\d\dT\S+ ", "")
    ranked = hits.groupBy(bare.alias("text")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text")
    return ranked if k is None else ranked.limit(k)


def first_and_last_seen(hits: DataFrame, group: str, date: str, run: str) -> DataFrame:
    """Per group: the first and the last date of a hit, and the number of runs with one."""
    return hits.groupBy(group).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.count_distinct(run).alias("runs"))


def summary(log_lines: DataFrame, pattern: str, key: str = "path", **options: bool) -> DataFrame:
    """One row: files searched, files with a hit, hits, and whether nothing matched."""
    hit = line_predicate(F.col("text"), pattern, **options)
    by_file = log_lines.groupBy(key).agg(F.count_if(hit).alias("hits"))
    total = by_file.agg(F.count("*").alias("files"), F.count_if(F.col("hits") > 0).alias("files_with_hits"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return total.withColumn("no_match", F.col("hits") == 0)


def verified(parsed: DataFrame, log_lines: DataFrame, key: str = "path") -> DataFrame:
    """Hits (key, line, text) as verified_line: their line if it holds the text, else the first line of the file that does,
    else null. A hit meets its own line; only those that miss it are looked for in their file."""
    asked = parsed.select(key, "line", "text").distinct()
    own = asked.join(log_lines.select(key, "line", F.col("text").alias("found")), [key, "line"], "left").withColumn("held", F.coalesce(F.contains("found", F.col("text")), F.lit(False)))
    missed = own.where("not held").select(key, "line", "text")
    elsewhere = missed.join(first_lines(missed, log_lines, key), [key, "text"])
    places = own.where("held").select(key, "line", "text", F.col("line").alias("at")).unionByName(elsewhere.select(key, "line", "text", "at"))
    return parsed.join(places.withColumnRenamed("at", "verified_line"), [key, "line", "text"], "left")
