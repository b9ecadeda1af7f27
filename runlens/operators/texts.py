"""Which line of a file holds a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_lines(asked: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, text, at): the first line of each file that holds each asked text, for the texts that one holds.

    A text of three words or more meets only lines with the longest of its inner words (by hash), which stands between blanks in them as well. Shorter
    ones, each once, are held against all lines of their file.
    """
    words = F.split("text", r"\s+")
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = asked.select(key, "text").where("text is not null").distinct().withColumn("word", longest)
    own = lines.join(wanted.select(key).distinct(), key, "left_semi").select(key, F.col("line").alias("at"), F.col("text").alias("found"))
    keyed = wanted.where("word is not null").withColumn("word", F.xxhash64("word"))
    # A word's row has its line's number alone; texts of lines come for those that a sought word stands in.
    spread = own.select(key, "at", F.explode(F.array_distinct(F.transform(F.split("found", r"\s+"), lambda w: F.xxhash64(w)))).alias("word"))
    near = spread.join(keyed, [key, "word"]).select(key, "text", "at").join(own, [key, "at"])
    far = own.join(wanted.where("word is null").drop("word"), key)
    both = near.select(key, "text", "at", "found").unionByName(far.select(key, "text", "at", "found"))
    return both.where(F.contains("found", F.col("text"))).groupBy(key, "text").agg(F.min("at").alias("at"))
