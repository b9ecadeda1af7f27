"""Trie of the common beginnings of conversations (operator 11).

Burst tries: conversations are suffixes in a container below a head, which is a prefix of turns. A container with too many distinct suffixes bursts:
its head becomes a node, and its suffixes go on, without their first turn, to one container for each next turn. What is left are small
containers, sorted and swept into nodes by one pass that keeps the path to the last suffix. Long conversations are cut into segments, each
of which lies in a container of its own below the prefix before it, so that no conversation is one row; equal suffixes are one row with a count.
Sums over subtrees are made by the sweep; only nodes above a burst or a cut get theirs by doubling the distance to the ancestors they report to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import column
from .components import sent
from .workspace import Workspace

#: Distinct suffixes of a container at most, turns of a segment, and segments whose hashes one window function adds up.
CONTAINER, SEGMENT, SEGMENTS_AT_ONCE = 256, 32, 1024
#: Rows of a table of heads up to which it is sent to all tasks (about 60 bytes each).
MOST_SENT = 200_000
#: Ids of a conversation that are one piece of a digest (a power of two: 2**12).
DIGEST_BITS = 12

_TOP = ["c1", "c2", "depth", "w", "p1", "p2", "parent_conv_id"]


def ordered_turns(conversations: DataFrame, work: Workspace, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, h1, h2, words) of every turn, pos from 1 in the order of `turn`, and (conv_id, n): how many turns each conversation has.

    A null turn comes first; turns of one number follow in the order of a hash of role and text. Rows are numbered in a range-partitioned order, so
    that a conversation with very many turns is no group in one task. A null role or text is empty; rows without conv_id are left out.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    words = F.size(F.array_remove(F.split(said, r"[\x20\x09-\x0D]+"), ""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(by, said).alias("h1"), F.xxhash64(F.lit(1), said, by).alias("h2"), words.alias("words")
    )
    order = ["conv_id", "turn", "h1", "h2"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"place": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    rows = work.keep(rows.drop("turn"), "turns")
    # A conversation's rows in a partition stand together; the partitions before it say how many came earlier.
    parts = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = work.keep(parts.withColumn("before", before), "parts")
    pos = F.col("place") - F.col("first") + F.col("before") + 1
    turns = rows.join(parts, ["conv_id", "part"]).select("conv_id", pos.alias("pos"), "h1", "h2", "words")
    return turns, parts.groupBy("conv_id").agg(F.sum("own").alias("n"))


def with_shared_openings(turns: DataFrame, sizes: DataFrame, block: int = 20, openings: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of conversation c - c % block (fewer, if it has fewer), h = crc32(c) % openings."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    named = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    first = sizes.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    named = named.join(first, "base", "left").withColumn("copied", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(named.select("conv_id", "h", "copied"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("copied"))
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < openings)).withColumnRenamed("conv_id", "base")
    copied = named.select("conv_id", "base", "h").join(heads, "base").where("pos <= h")
    names = ["conv_id", "pos", "h1", "h2", "words"]
    return own.select(*names).unionByName(copied.select(*names)), named.select("conv_id", (F.col("copied") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _segments(turns: DataFrame, sizes: DataFrame, length: int, work: Workspace) -> DataFrame:
    """(conv_id, c1, c2, depth, w, suffix, ends, e1, e2): segments of up to `length` turns below the prefix (c1, c2) before them.

    A prefix is named by the exclusive or of hashes of its turns with their places, which needs no order of addition. A conversation ends in its last
    segment, which is empty if the one before is full. suffix: an array of (z1, z2, words).
    """
    z1, z2 = F.xxhash64("h1", "h2", "pos"), F.xxhash64("pos", "h2", "h1")
    seg = F.floor((F.col("pos") - 1) / length)
    none = F.lit(None).cast("bigint")
    each = turns.select("conv_id", seg.alias("seg"), "pos", z1.alias("z1"), z2.alias("z2"), "words", F.lit(False).alias("ends"), none.alias("w"))
    lead = turns.where(F.col("pos") % length == 0).select("conv_id", F.floor(F.col("pos") / length).alias("seg"), none.alias("pos"), none.alias("z1"), none.alias("z2"), F.lit(None).cast("int").alias("words"), F.lit(False).alias("ends"), F.col("words").cast("bigint").alias("w"))
    last = sizes.select("conv_id", F.floor(F.col("n") / length).alias("seg"), none.alias("pos"), none.alias("z1"), none.alias("z2"), F.lit(None).cast("int").alias("words"), F.lit(True).alias("ends"), none.alias("w"))
    found = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "z1", "z2", "words"))))
    xor = lambda c: F.coalesce(F.bit_xor(c), F.lit(0).cast("bigint"))
    segments = each.unionByName(lead).unionByName(last).groupBy("conv_id", "seg").agg(found.alias("t"), xor("z1").alias("x1"), xor("z2").alias("x2"), F.max("ends").alias("ends"), F.coalesce(F.max("w"), F.lit(0)).alias("w"))
    segments = work.keep(segments.withColumn("suffix", F.transform("t", lambda x: F.struct(x["z1"], x["z2"], x["words"]))).drop("t"), "segments")
    # What stands before a segment: the segments of its stretch, and the stretches before that.
    long = segments.where((F.col("seg") > 0) | ~F.col("ends")).select("conv_id", "seg", "x1", "x2", F.floor(F.col("seg") / SEGMENTS_AT_ONCE).alias("stretch"))
    earlier = lambda key, by: Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = long.withColumns({f"s{i}": F.coalesce(F.bit_xor(f"x{i}").over(earlier(["conv_id", "stretch"], "seg")), F.lit(0)) for i in (1, 2)})
    whole = long.groupBy("conv_id", "stretch").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    whole = whole.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier(["conv_id"], "stretch")), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    heads = inside.join(whole, ["conv_id", "stretch"]).where("seg > 0").select("conv_id", "seg", *[F.col(f"s{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"c{i}") for i in (1, 2)])
    zero = F.lit(0).cast("bigint")
    placed = segments.where("seg = 0").withColumns({"c1": zero, "c2": zero}).unionByName(segments.where("seg > 0").join(heads, ["conv_id", "seg"]))
    return placed.select("conv_id", "c1", "c2", (F.col("seg") * length).alias("depth"), "w", "suffix", "ends", *[F.col(f"c{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"e{i}") for i in (1, 2)])


class _Sweep:
    """Nodes of one container after the other, from suffixes in order."""

    #: What a node has; saved and leaves are sums over what the container has of its subtree, whole unless open.
    NAMES = ("c1", "c2", "depth", "p1", "p2", "parent_conv_id", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "kind")
    TOP, OPEN, LINK, BURST = 1, 2, 4, 8
    SCHEMA = "c1 bigint, c2 bigint, depth bigint, p1 bigint, p2 bigint, parent_conv_id bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, kind int"

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.top: tuple | None = None

    def begin(self, top: tuple) -> None:
        """top: c1, c2, depth, w, p1, p2, parent_conv_id of the container's head."""
        self.end()
        self.top = top
        # c1, c2, depth, words, parent's number, members, least member, children, open
        self.nodes = [[top[0], top[1], top[2], top[3], -1, 0, None, 0, False]]
        self.links: list[tuple] = []
        self.path, self.last = [0], []

    def add(self, suffix: list[tuple], goes_on: bool, n: int, first: int) -> None:
        same = 0
        for x, y in zip(self.last, suffix, strict=False):
            if x != y:
                break
            same += 1
        nodes, path = self.nodes, self.path
        del path[same + 1 :]
        for i in range(same, len(suffix)):
            z1, z2, w = suffix[i]
            up = nodes[path[-1]]
            up[7] += 1
            if goes_on and i + 1 == len(suffix):  # the next segment's container has this node
                up[8] = True
                self.links.append((up[0] ^ z1, up[1] ^ z2, up[2] + 1, path[-1]))
                break
            nodes.append([up[0] ^ z1, up[1] ^ z2, up[2] + 1, w, path[-1], 0, None, 0, False])
            path.append(len(nodes) - 1)
        for i in path:
            own = nodes[i]
            own[5] += n
            if own[6] is None or first < own[6]:
                own[6] = first
        self.last = suffix

    def end(self) -> None:
        if self.top is None:
            return
        nodes = self.nodes
        leaves, saved = [int(not x[7]) for x in nodes], [(x[5] - 1) * x[3] for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i][4]
            if nodes[i][8]:
                nodes[up][8] = True
            else:
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        for i, x in enumerate(nodes):
            up = nodes[x[4]] if i else None
            above = (up[0], up[1], up[6]) if i else self.top[4:7]
            self.out.append((x[0], x[1], x[2], *above, x[6], x[5], x[7], leaves[i], saved[i], (0 if i else self.TOP) + self.OPEN * x[8]))
        for c1, c2, depth, i in self.links:
            up = nodes[i]
            self.out.append((c1, c2, depth, up[0], up[1], up[6], None, 0, 0, 0, 0, self.LINK))
        self.top = None

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * len(self.NAMES)
        self.out = []
        kinds = [pa.int64()] * (len(self.NAMES) - 1) + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], list(self.NAMES))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and links of containers; a container is in memory, which CONTAINER and SEGMENT bound."""
    sweep, key = _Sweep(), None
    for batch in batches:
        suffixes = column(batch, "suffix")
        offsets = suffixes.offsets.to_numpy()
        flat = suffixes.values
        turns = list(zip(*[flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(3)], strict=True))
        tops = zip(*[column(batch, name).to_pylist() for name in _TOP], strict=True)
        rest = zip(*[column(batch, name).to_pylist() for name in ("ends", "n", "first")], strict=True)
        for i, (top, (ends, n, first)) in enumerate(zip(tops, rest, strict=True)):
            if top[:2] != key:
                sweep.begin(top)
                key = top[:2]
            sweep.add(turns[offsets[i] : offsets[i + 1]], not ends, n, first)
        if len(sweep.out) > 10_000:
            yield sweep.taken()
    sweep.end()
    yield sweep.taken()


def _burst(rows: DataFrame, container: int, work: Workspace) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Containers that are small enough, heads of those that burst, and links to heads of next segments."""
    small, heads, links = [], [], []
    while True:
        sizes = rows.groupBy(*_TOP).agg(F.count("*").alias("suffixes"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
        large = work.keep(sizes.where(F.col("suffixes") > container).drop("suffixes"), "burst")
        if large.isEmpty():
            return [*small, rows], heads, links
        told = sent(large.select("c1", "c2", F.col("conv_id").alias("_above")), MOST_SENT)
        small.append(rows.join(told, ["c1", "c2"], "left_anti"))
        heads.append(large)
        t = F.col("suffix")[0]
        below = rows.join(told, ["c1", "c2"]).where(F.size("suffix") > 0)
        below = below.select(
            F.col("c1").bitwiseXOR(t["z1"]).alias("c1"), F.col("c2").bitwiseXOR(t["z2"]).alias("c2"), (F.col("depth") + 1).alias("depth"), t["words"].cast("bigint").alias("w"),
            F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("_above").alias("parent_conv_id"), F.slice("suffix", 2, F.size("suffix")).alias("suffix"), "ends", "n", "first",
        )
        below = work.keep(below, "below")
        over = (F.size("suffix") == 0) & ~F.col("ends")
        links.append(below.where(over).select("c1", "c2", "p1", "p2", "parent_conv_id").distinct())
        rows = below.where(~over)


def _added_up(tree: DataFrame, work: Workspace) -> DataFrame:
    """(c1, c2, n_leaves, saved_tokens, p1, p2) with the sums over all descendants; in each round a row reports to an ancestor twice as far above."""
    tree = work.keep(tree, "open-nodes")
    while not tree.where("p1 is not null").isEmpty():
        add = tree.where("p1 is not null").groupBy("p1", "p2").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")).withColumnsRenamed({"p1": "c1", "p2": "c2"})
        above = tree.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
        joined = tree.join(add, ["c1", "c2"], "left").join(above, ["p1", "p2"], "left")
        after = joined.select("c1", "c2", *[(F.col(c) + F.coalesce(a, F.lit(0))).alias(c) for c, a in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))], F.col("_p1").alias("p1"), F.col("_p2").alias("p2"))
        after = work.keep(after, "open-nodes")
        work.drop(tree)
        tree = after
    return tree


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; only the state of one digest is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for own, ids in zip(zip(*[column(batch, c).to_pylist() for c in ("c1", "c2")], strict=True), column(batch, "ids").to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["c1", "c2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["c1", "c2", "ends_sha256"])


def _both(c: str, ids: Column) -> Column:
    return F.coalesce(F.col(c), ids)


def prefix_trie(turns: DataFrame, sizes: DataFrame, container: int = CONTAINER, segment: int = SEGMENT, work: Workspace | None = None) -> DataFrame:
    """A row for each distinct beginning of conversations: depth, conv_id (its least member), parent_conv_id, n_convs (members), n_children, n_leaves,
    saved_tokens and ends_sha256, and (c1, c2), the name of the node.

    turns: (conv_id, pos, h1, h2, words), pos from 1 without gaps, h1 and h2 hashes that name a turn. sizes: (conv_id, n) of all conversations; one without
    turns is a member of the root alone. n_leaves and saved_tokens are summed over the subtree, its top included; a node saves
    (n_convs - 1) * words of its last turn. ends_sha256: digest of the ids of conversations that end there, in order and joined by commas.
    Conversations that are equal are members of the same nodes. Without conversations there is no node.
    """
    work = work or Workspace(turns.sparkSession)
    segments = work.keep(_segments(turns, sizes, segment, work), "suffixes")
    null = F.lit(None).cast("bigint")
    rows = segments.groupBy("c1", "c2", "depth", "w", "suffix", "ends").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).withColumns({"p1": null, "p2": null, "parent_conv_id": null})
    small, burst, burst_links = _burst(work.keep(rows, "containers"), container, work)
    containers = small[0]
    for more in small[1:]:
        containers = containers.unionByName(more)
    containers = containers.select(*_TOP, "suffix", "ends", "n", "first")
    swept = work.keep(containers.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "suffix").mapInArrow(_swept, _Sweep.SCHEMA), "swept")
    is_ = lambda bit: F.col("kind").bitwiseAND(F.lit(bit)) > 0
    nodes = swept.where(~is_(_Sweep.LINK))
    links = swept.where(is_(_Sweep.LINK)).select("c1", "c2", "p1", "p2", "parent_conv_id")
    heads = nodes.limit(0)
    for own, more in zip(burst, burst_links, strict=True):
        links = links.unionByName(more)
        saved = (F.col("n_convs") - 1) * F.col("w")
        heads = heads.unionByName(own.select("c1", "c2", "depth", "p1", "p2", "parent_conv_id", "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_children"), F.lit(0).cast("bigint").alias("n_leaves"), saved.alias("saved_tokens"), F.lit(_Sweep.TOP | _Sweep.OPEN | _Sweep.BURST).alias("kind")))
    # The first node of a later segment learns from the segment before what stands above it.
    above = links.select("c1", "c2", F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), F.col("parent_conv_id").alias("_above"))
    tops = nodes.where(is_(_Sweep.TOP)).unionByName(heads).join(above, ["c1", "c2"], "left")
    tops = work.keep(tops.withColumns({"p1": _both("p1", F.col("_p1")), "p2": _both("p2", F.col("_p2")), "parent_conv_id": _both("parent_conv_id", F.col("_above"))}).drop("_p1", "_p2", "_above"), "tops")
    every = nodes.where(~is_(_Sweep.TOP)).unionByName(tops)
    open_ = every.where(is_(_Sweep.OPEN))
    reported = tops.where(F.col("p1").isNotNull()).groupBy("p1", "p2").agg(
        F.count("*").alias("_children"), *[F.sum(F.when(~is_(_Sweep.OPEN), F.col(c))).alias(a) for c, a in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))]
    ).withColumnsRenamed({"p1": "c1", "p2": "c2"})
    tree = work.keep(open_.join(reported, ["c1", "c2"], "left").select(
        "c1", "c2", "depth", "p1", "p2", "parent_conv_id", "conv_id", "n_convs", F.when(is_(_Sweep.BURST), F.coalesce("_children", F.lit(0))).otherwise(F.col("n_children")).alias("n_children"),
        *[(F.col(c) + F.coalesce(a, F.lit(0))).alias(c) for c, a in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))],
    ), "open")
    sums = _added_up(tree.select("c1", "c2", "n_leaves", "saved_tokens", "p1", "p2"), work).select("c1", "c2", "n_leaves", "saved_tokens")
    names = ["c1", "c2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = every.where(~is_(_Sweep.OPEN)).select(*names).unionByName(tree.drop("n_leaves", "saved_tokens").join(sums, ["c1", "c2"]).select(*names))
    pieces = segments.where("ends").groupBy(F.col("e1").alias("c1"), F.col("e2").alias("c2"), F.shiftright("conv_id", DIGEST_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("c1", "c2", "piece", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    digests = pieces.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "piece").mapInArrow(_digests, "c1 bigint, c2 bigint, ends_sha256 string")
    return whole.join(digests, ["c1", "c2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def conversation_trie(conversations: DataFrame, block: int = 20, openings: int = 4, **limits: int) -> DataFrame:
    """The trie of conversations that are rebuilt with shared openings; see with_shared_openings and prefix_trie.

    conversations: conv_id, turn, role, text. A null role or text is empty, a null turn comes first, and of turns with one number the order is that of a hash.
    Repeated rows are turns of their own. Rows without conv_id take no part; other columns are not read. Texts of any length are hashed where they are read.
    """
    work = Workspace(conversations.sparkSession)
    turns, sizes = ordered_turns(conversations, work)
    turns, sizes = with_shared_openings(turns, sizes, block, openings)
    return prefix_trie(turns, work.keep(sizes, "sizes"), work=work, **limits)
