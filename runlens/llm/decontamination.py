"""Passages of benchmark items in documents (operator 1), with DataFrame operations only.

A document's windows have the size of an item. Windows that share no shingle with the item can't be like it, so only those
around a shared shingle are fingerprinted; each of them is. Fingerprints are SimHashes of the windows' words, in RADIUS + 1
blocks, of which two within RADIUS bits share one at least. The blocks find no candidates beyond those of the shingles: they
and the radius only narrow them. What is within the radius is verified by the exact similarity of the shingles, weighted by how often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash import distance, with_simhash, words_of
from .workspace import Workspace

#: Words of a shingle, least similarity in percent, and Hamming radius; at 75 % up to a seventh of the words can differ at an end.
SIZE, SIMILARITY, RADIUS = 5, 75, 22
#: Shingles of all items up to which the items are sent to all tasks (40 bytes for each); more are joined by a shuffle, with equal results.
MOST_SENT = 500_000


def word_hashes(words: Column) -> Column:
    """Hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` word hashes in order; none where there are fewer. The same for a number as for a column."""
    last = F.size(hashes) - size + 1
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    if isinstance(size, int):
        runs = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(size)]))
    else:
        runs = F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def _numbered(hashes: Column) -> Column:
    """Each hash with the number of equal ones before it, so that sets of these count how often a shingle occurs."""
    return F.transform(hashes, lambda x, i: F.struct(x.alias("h"), F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda y: y == x)).alias("k")))


def _block(fingerprint: Column, i: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, i * width).bitwiseAND(F.lit((1 << width) - 1))


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id", size: int = SIZE, similarity: int = SIMILARITY, radius: int = RADIUS, most_sent: int = MOST_SENT) -> DataFrame:
    """Per document and item that it holds: id, item_id, similarity (of the best window), start (its first word, from 0), n_windows.

    A window has as many words as the item, or is the whole text if that is shorter. Shingles have `size` words, or as
    many as the item if it has fewer. A window is held against an item if 100 * sum of the smaller counts >= similarity *
    sum of the larger counts over all their shingles, and their fingerprints are within the radius. Null and empty texts and items give no
    rows; repeated rows give one; equal similarities go to the first window. A null id is a document of its own name, null.
    """
    work = Workspace(docs.sparkSession)
    known = items.select(F.col(item_id).alias("item_id"), words_of(F.coalesce(item_text, F.lit(""))).alias("item_words")).where(F.size("item_words") > 0)
    known = known.withColumns({"n_item": F.size("item_words"), "run": F.least(F.lit(size), F.size("item_words"))}).distinct()
    known = with_simhash(known.withColumns({"item_shingles": shingles(word_hashes(F.col("item_words")), F.col("run")), "words": F.col("item_words")}), "words", ["item_id", "item_words"], work, "item_sim")
    few = known.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()[0] <= most_sent
    sent = F.broadcast if few else (lambda df: df)
    runs = [r[0] for r in known.select("run").distinct().collect()]  # up to `size` numbers
    index = known.select("item_id", "n_item", "run", "item_sim", F.explode(F.array_distinct("item_shingles")).alias("h"))

    texts = docs.select(F.col(id_).alias("doc_id"), F.xxhash64(text).alias("same"), words_of(F.coalesce(text, F.lit(""))).alias("words")).withColumn("hashes", word_hashes(F.col("words")))
    # Where the items are sent, words go along with the shingles inside a task; else only keys are shuffled, and words come by another join.
    carried = ["words"] if few else []
    met = []
    for run in runs or [size]:
        at = texts.select("doc_id", "same", *carried, F.posexplode(shingles(F.col("hashes"), run)).alias("p", "h")).withColumn("run", F.lit(run))
        met.append(at.join(sent(index), ["h", "run"]))
    anchors = met[0]
    for more in met[1:]:
        anchors = anchors.unionByName(more)
    if not few:
        own = texts.select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "words").dropDuplicates(["_id", "_same"])
        anchors = anchors.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("same").eqNullSafe(F.col("_same"))).drop("_id", "_same")
    n, w, p = F.size("words"), F.col("n_item"), F.col("p") + 1
    low = F.greatest(F.lit(1), p - w + F.col("run"))
    around = anchors.select("doc_id", "same", "item_id", "n_item", "run", "item_sim", p.alias("p"), n.alias("n"), low.alias("low"), F.slice("words", low, F.least(n, p + w - 1) - low + 1).alias("around"))
    before = F.lag("p").over(Window.partitionBy("doc_id", "same", "item_id", "n_item", "item_sim").orderBy("p"))
    first = F.greatest("low", F.coalesce(before + 1, F.lit(1)))
    last = F.least("p", F.greatest(F.lit(1), F.col("n") - F.col("n_item") + 1))
    started = around.withColumns({"first": first, "last": last}).where("first <= last")
    windows = started.withColumn("start", F.explode(F.sequence("first", "last"))).select(
        "doc_id", "same", "item_id", "n_item", "run", "item_sim", "start", F.slice("around", F.col("start") - F.col("low") + 1, F.col("n_item")).alias("window")
    )
    windows = windows.withColumn("own", shingles(word_hashes(F.col("window")), F.col("run")))
    marked = with_simhash(windows, "window", ["doc_id", "same", "item_id", "item_sim", "start"], work)

    blocks, width = radius + 1, 64 // (radius + 1)
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))

    def keys(fingerprint: Column) -> Column:
        return F.transform(numbers, lambda i: _block(fingerprint, i, width))

    by_block = known.select("item_id", "item_sim", F.posexplode(keys(F.col("item_sim"))).alias("block", "bits"))
    found = marked.select("*", F.posexplode(keys(F.col("sim"))).alias("block", "bits")).join(sent(by_block), ["item_id", "item_sim", "block", "bits"])
    agreeing = F.array_min(F.filter(numbers, lambda i: _block(F.col("sim"), i, width) == _block(F.col("item_sim"), i, width)))
    wanted = sent(known.select("item_id", "item_sim", "item_shingles"))
    near = found.where((distance(F.col("sim"), F.col("item_sim")) <= radius) & (F.col("block") == agreeing)).join(wanted, ["item_id", "item_sim"])

    shared = F.size(F.array_intersect(_numbered(F.col("own")), _numbered(F.col("item_shingles"))))
    counted = near.select("doc_id", "item_id", "start", shared.alias("shared"), (F.size("own") + F.size("item_shingles") - shared).alias("all"))
    like = counted.where(100 * F.col("shared") >= similarity * F.col("all")).withColumn("similarity", F.col("shared") / F.col("all"))
    return like.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by(F.col("start") - 1, F.struct(-F.col("similarity"), "start")).alias("start"), F.count_distinct("start").alias("n_windows")).withColumnRenamed("doc_id", id_)
