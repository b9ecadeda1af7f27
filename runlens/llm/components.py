"""Connected components of links, and links of buckets without listing their pairs. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Bits of the filter over ids: 2**FILTER_BITS (1 MB) at least, 2**MOST_FILTER_BITS (64 MB) at most.
FILTER_BITS, MOST_FILTER_BITS = 23, 29
#: Rows of a written table up to which it is sent to all tasks; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Parts of a hot bucket; members of a block where members of a bucket meet each other.
PARTS, BLOCK = 32, 512
#: Pairs across components up to which all are verified at once; of more, one of ACROSS_PARTS goes first.
MOST_ACROSS, ACROSS_PARTS = 200_000, 16


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Links (a, b), bigint → (node, root) for each node of a link, root being the smallest id reachable.

    Alternates two steps over all links at once until nothing changes, which takes rounds in the logarithm of the longest
    path: every node's larger neighbours are tied to its least neighbour, then its smaller ones. Each round aggregates
    before it joins, so that a node with very many links is no group of rows in one task, and is written to the shared folder.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = work.keep(pairs, "links")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        new = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        work.drop(pairs, large)
        pairs = after
        if new == state:
            break
        state = new
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_roots(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(node, ...) with root; a node without links is its own."""
    return nodes.join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))


def sent(kept: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A written table of a few columns, marked to be sent to all tasks if it has `most` rows or less."""
    return F.broadcast(kept) if kept.count() <= most else kept


def id_filter(ids: DataFrame, column: str, hashed: bool = False) -> tuple[int, bytes]:
    """A bitmap of 2**bits bits over ids, or their hashes unless they are hashes, and its bits; it has no false negatives.

    It grows with the number of ids, up to 2**MOST_FILTER_BITS bits; with still more ids it lets others pass as well, which the
    join that follows takes out. One 64-bit word per row reaches the driver, 2**bits / 64 at most.
    """
    import numpy as np

    bits = min(max(FILTER_BITS, ids.count().bit_length() + 4), MOST_FILTER_BITS)
    at = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(1 << bits))
    slots = ids.select(at.alias("slot")).distinct()
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set")).toArrow()
    table = np.zeros((1 << bits) // 64, np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    return bits, table.tobytes()


def linked_components(spark: SparkSession, buckets: DataFrame, bounds: Callable, verify: Callable[[DataFrame], DataFrame], work: Workspace, before: DataFrame | None = None, across: bool = True, leaders: int = 1) -> DataFrame:
    """Components under all verified links between members of a bucket: (node, root).

    buckets: (key, node, hot, ...), one row per member, `node` the id of one of its distinct contents, `hot` true for the
    keys that very many may have. bounds(x, y): what two members' rows must fulfil to be a candidate. verify: (a, b) → the
    pairs that are linked.

    First each member meets its bucket's least member only; a hot bucket is dealt to PARTS parts, whose least members meet
    that of the bucket (`hot` need not be the same for all members of a bucket). A bucket whose members are then in one component has lost nothing: all of it is linked. In each
    other bucket, members of different components meet, under the bounds, and what is linked is added. So each pair of a
    bucket is either verified or in one component already, and the pairs of a large group of copies are never listed.

    before: components (node, root) that are known already. across: if false, members meet their least member alone.
    leaders: by the key, the least member is that with the least of so many hashes, so that members of several buckets meet different ones.
    """
    others = [c for c in buckets.columns if c not in ("key", "hot")]
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(0)
    dealt = buckets.select("key", "hot", F.struct("node", *[c for c in others if c != "node"]).alias("x"), part.alias("part"))
    w = Window.partitionBy("key", "part")
    led = dealt.withColumns({"y": (F.min("x") if leaders == 1 else F.min_by("x", F.struct(F.xxhash64("x.node", F.pmod("key", F.lit(leaders))), "x"))).over(w), "size": F.count(F.lit(1)).over(w)}).where("size > 1 or hot")
    met = work.keep(led.select("key", "hot", "part", "x", "y"), "buckets")
    work.release()
    dealt_keys = met.where("hot").select("key").distinct()
    heads = met.where(F.col("x.node") == F.col("y.node")).join(dealt_keys, "key", "left_semi").select("key", "x").distinct()
    to_head = heads.join(heads.groupBy("key").agg(F.min("x").alias("y")), "key").select("x", "y")
    to_leader = met.select("x", "y").unionByName(to_head).where((F.col("x.node") != F.col("y.node")) & bounds(F.col("x"), F.col("y")))
    tried = work.keep(to_leader.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "to-leader")
    found = verify(tried)
    if before is not None:
        found = found.unionByName(before.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = work.keep(found, "leader-links")
    work.release()
    known = work.keep(connected_components(links, work), "leader-components")
    if not across:
        return known
    roots = sent(known)
    by_key = with_roots(met.select("key", F.col("x.node").alias("node")), roots).groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    open_ = work.keep(by_key.where("first < last").select("key"), "open-keys")
    if open_.isEmpty():
        return known
    open_ = sent(open_)
    rest = work.keep(with_roots(met.join(open_, "key", "left_semi").select("key", "x", F.col("x.node").alias("node")), roots), "open-buckets")
    work.drop(met)
    work.release()
    # Parts of a bucket can have come apart: what is left of it meets its one least member before members meet each other.
    head = rest.groupBy("key").agg(F.min(F.struct("x", "root")).alias("h")).select("key", F.col("h.x").alias("y"), F.col("h.root").alias("s"))
    again = rest.join(head, "key").where((F.col("root") != F.col("s")) & bounds(F.col("x"), F.col("y"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    again = work.keep(again.join(sent(tried), ["a", "b"], "left_anti"), "to-head")
    links = work.keep(links.unionByName(verify(again)), "more-links")
    work.release()
    tried = work.keep(tried.unionByName(again), "tried")
    known = work.keep(connected_components(links, work), "head-components")
    members = work.keep(with_roots(rest.drop("root"), sent(known)), "open-members")
    work.drop(rest)
    work.release()
    rest = members
    # Members of a large bucket are dealt to blocks, and each two blocks meet in a place of their own.
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key", "blocks")
    placed = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = placed.select("key", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "x", F.col("root").alias("r"))
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("x").alias("y"), F.col("root").alias("s"))
    unlike = F.when(F.col("i") == F.col("j"), F.col("r") < F.col("s")).otherwise(F.col("r") != F.col("s"))
    cross = left.join(right, ["key", "i", "j"]).where(unlike & bounds(F.col("x"), F.col("y"))).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    fresh = work.keep(cross.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "across")
    if fresh.count() > MOST_ACROSS:
        # Most groups that are one come together by a part of their pairs; what is left of the others is whole.
        own = F.pmod(F.xxhash64("a", "b"), F.lit(ACROSS_PARTS))
        some = work.keep(fresh.where(own == 0), "across-first")
        links = work.keep(links.unionByName(verify(some)), "first-links")
        known = work.keep(connected_components(links, work), "first-components")
        work.release()
        one, two = (sent(known).select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "r"), ("b", "s")))
        still = fresh.where(own != 0).join(one, "a", "left").join(two, "b", "left").where(F.coalesce("r", "a") != F.coalesce("s", "b"))
        fresh = work.keep(still.select("a", "b"), "across-rest")
    more = work.keep(verify(fresh), "across-links")
    if more.isEmpty():
        return known
    return connected_components(links.unionByName(more), work)
