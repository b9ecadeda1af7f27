"""Removal of word sequences that stand in more than one place (operator 12).

Fixed-block anchors: every text is cut into blocks of (window + 1) // 2 words that don't overlap, and their hashes are the index; any window holds
one of these blocks whole. All texts then probe the index with a block at every word. A window without a hit occurs nowhere else. Around
the hits the longest runs of windows with a hit are taken, and equal runs are one: a run that stands in two places is an exact repeat,
and no longer one begins or ends inside it. What is left, the runs that stand in one place alone, is extended window by window against all distinct
runs. So the copies of a passage cost one row each, and its words are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import STEP, STEP_BACK, by_bytes, column, flat, mixed, word_hashes
from .workspace import Workspace

#: Words of a window.
WINDOW = 35
#: Windows of a run at most (the cut depends on the run alone), and words that are hashed at once.
RUN_BITS = 12
SLICE = 1 << 18
#: Bits of the number of 64-bit words of the filter over anchors, which has two such tables (2**22: 32 MB each).
LEAST_FILTER_BITS, MOST_FILTER_BITS = 10, 22
#: Runs whose windows a task remembers to have handed on.
RUNS_KEPT = 100_000

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((STEP, STEP_BACK)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


class Rolling:
    """Hashes of any runs of words of one array, from sums over its beginnings."""

    def __init__(self, words: np.ndarray):
        up, self.back = _power_tables(max(len(words), 1 << 18))
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.total[1:])

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Of the runs of `size` words from each begin."""
        return mixed((self.total[begin + size] - self.total[begin]) * self.back[begin] + np.asarray(size).astype(np.uint64))


def _slices(texts: pa.Array, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words (hashed) of a bounded slice, and for each window that begins there: its begin in the slice, its text, its begin in the text."""
    words, at = word_hashes(*flat(texts), lower=False)
    for x in range(0, max(len(words) - window + 1, 0), most):
        part = words[x : x + most + window - 1]
        begin = np.arange(len(part) - window + 1)
        text = np.searchsorted(at, begin + x, "right") - 1
        fits = begin + x + window <= at[text + 1]
        begin, text = begin[fits], text[fits]
        if len(begin):
            yield part, begin, text, begin + x - at[text]


def _anchored(part: np.ndarray, begin: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every block of the windows: its begin in the slice, its hash, whether it is one of the fixed blocks of its text."""
    block = (window + 1) // 2
    within = np.zeros(len(part) + 1, np.int32)
    within[begin] += 1
    within[begin + (window - block + 1)] -= 1
    starts = np.flatnonzero(np.cumsum(within[:-1]) > 0)
    # A text's windows are without a gap, so that the place of a block follows from the last window that begins before or at it.
    last = np.searchsorted(begin, starts, "right") - 1
    return starts, Rolling(part).of(starts, block), (starts - begin[last] + place[last]) % block == 0


def anchor_filter(docs: DataFrame, text: str, window: int, slice_words: int = SLICE) -> tuple[int, bytes]:
    """Two Bloom tables over the hashes of fixed blocks, of those that occur and of those that occur twice or more, and the bits of their size.

    They grow with the number of blocks up to 2**MOST_FILTER_BITS numbers each. Beyond that they let more windows pass, which
    the later steps tell apart; nothing is lost.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found = [np.zeros(0, np.uint64)]
            for part, begin, _, place in _slices(column(batch, text), window, slice_words):
                _, own, fixed = _anchored(part, begin, place, window)
                found.append(own[fixed])
            own, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(count)], ["anchor", "n"])

    work = Workspace(docs.sparkSession)
    counted = work.keep(docs.where(F.col(text).isNotNull()).select(text).mapInArrow(blocks, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    bits = min(max(LEAST_FILTER_BITS, counted.count().bit_length()), MOST_FILTER_BITS)
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {6 * i}) & 63 as int))" for i in range(4)))
    slot = F.shiftrightunsigned("anchor", 64 - bits)
    slots = counted.groupBy(slot.alias("slot")).agg(F.bit_or(mask).alias("any"), F.bit_or(F.when(F.col("n") > 1, mask).otherwise(F.lit(0).cast("bigint"))).alias("twice")).toArrow()
    work.drop(counted)
    tables = np.zeros((2, 1 << bits), np.int64)
    tables[0, slots["slot"].to_numpy()] = slots["any"].to_numpy()
    tables[1, slots["slot"].to_numpy()] = slots["twice"].to_numpy()
    return bits, tables.tobytes()


def _hits(anchors: np.ndarray, fixed: np.ndarray, bits: int, tables: np.ndarray) -> np.ndarray:
    """Blocks that the index has from another place: a fixed block must be there twice, since it is there itself."""
    mask = np.zeros(len(anchors), np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((anchors >> np.uint64(6 * i)) & np.uint64(63))
    slot = (anchors >> np.uint64(64 - bits)).astype(np.int64) + (fixed.astype(np.int64) << bits)
    return (tables[slot] & mask) == mask


def hit_runs(docs: DataFrame, text: str, id_: str, window: int, run_bits: int = RUN_BITS, slice_words: int = SLICE) -> DataFrame:
    """(doc_id, own, start, size, r1, r2, w1, w2): runs of `size` windows from word `start`, the run's hash, and hashes of its windows.

    own: hash of the text, which tells apart rows that share an id. w1 and w2 are null where the task has handed them on for an equal run.
    """
    bits, raw = anchor_filter(docs, text, window, slice_words)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    block, most = (window + 1) // 2, 1 << run_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.frombuffer(shared.value, np.uint64)
        met: set[tuple[int, int]] = set()
        for batch in by_bytes(batches, text):
            for part, begin, owner, place in _slices(column(batch, text), window, slice_words):
                starts, anchors, fixed = _anchored(part, begin, place, window)
                hit = np.zeros(len(part) + 1, np.int32)
                hit[starts + 1] = _hits(anchors, fixed, bits, tables)
                hit = np.cumsum(hit)
                held = np.flatnonzero(hit[begin + (window - block + 1)] > hit[begin])
                if not len(held):
                    continue
                begin, owner, place = begin[held], owner[held], place[held]
                first = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1] + 1) | (owner[1:] != owner[:-1])]))
                lengths = np.diff(np.append(first, len(begin)))
                pieces = -(-lengths // most)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                at = np.repeat(first, pieces) + nth * most
                size = np.minimum(np.repeat(lengths, pieces) - nth * most, most)
                one, two = Rolling(part), Rolling(mixed(part, 1))
                r1, r2 = one.of(begin[at], size + window - 1), two.of(begin[at], size + window - 1)
                w1, w2 = one.of(begin, window), (two.of(begin, window) >> np.uint64(32)).astype(np.uint32)
                if len(met) > RUNS_KEPT:
                    met.clear()
                fresh = []
                for key in zip(r1.tolist(), r2.tolist(), strict=True):
                    fresh.append(key not in met)
                    met.add(key)
                payloads = [[w[a : a + n].tobytes() if x else None for a, n, x in zip(at.tolist(), size.tolist(), fresh, strict=True)] for w in (w1, w2)]
                docs_of = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "_id").take(docs_of), column(batch, "_own").take(docs_of), pa.array(place[at].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), *[pa.array(x, pa.binary()) for x in payloads]],
                    ["doc_id", "own", "start", "size", "r1", "r2", "w1", "w2"],
                )

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_).alias("_id"), F.xxhash64(text).alias("_own"), text)
    kind = docs.schema[id_].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, own bigint, start int, size int, r1 bigint, r2 bigint, w1 binary, w2 binary")


def _exploded(run_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, w1, w2, code): a row for each window of runs, with its hashes and where it is; code is -1 if its run is known to be repeated.

    Windows that are equal within a batch are known to be repeated: one row without a place stands for them, and each of them only hands on its place,
    under a key of its own. So a window of very many runs is no large group.
    """
    for batch in by_bytes(batches, "w1", 1 << 20):
        w1 = np.frombuffer(b"".join(column(batch, "w1").to_pylist()), np.int64)
        w2 = np.frombuffer(b"".join(column(batch, "w2").to_pylist()), np.int32)
        size = column(batch, "size").to_numpy()
        nth = np.arange(len(w1)) - np.repeat(np.cumsum(size) - size, size)
        code = np.where(np.repeat(column(batch, "repeated").to_numpy(zero_copy_only=False), size), -1, (np.repeat(column(batch, "run").to_numpy(), size) << run_bits) + nth)
        order = np.lexsort((w2, w1))
        w1, w2, code = w1[order], w2[order], code[order]
        like = np.concatenate([[False], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])])
        again = like.copy()
        again[:-1] |= like[1:]
        placed = np.flatnonzero(again & (code >= 0))
        known = np.concatenate([np.zeros(np.count_nonzero(~like), bool), np.ones(len(placed), bool)])
        keys = [np.concatenate([x, y]) for x, y in ((w1[~like], mixed(code[placed].view(np.uint64)).view(np.int64)), (w2[~like], np.zeros(len(placed), np.int32)), (np.where(again, -1, code)[~like], code[placed]))]
        yield pa.RecordBatch.from_arrays([pa.array(known), *map(pa.array, keys)], ["known", "w1", "w2", "code"])


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of the windows that a neighbour in the order equals; a window needs only the row before it, whatever the size of its group."""
    w1, w2, code = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    told = False  # of the row that is held back: it equals the one before it
    for batch in batches:
        known = column(batch, "known").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(column(batch, "code").to_numpy()[known])], ["code"])
        w1, w2, code = (np.concatenate([x, column(batch, name).to_numpy()[~known]]) for x, name in ((w1, "w1"), (w2, "w2"), (code, "code")))
        if not len(w1):
            continue
        like = np.concatenate([[told], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])])
        again = like.copy()
        again[:-1] |= like[1:]
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1][again[:-1] & (code[:-1] >= 0)])], ["code"])
        w1, w2, code, told = w1[-1:], w2[-1:], code[-1:], bool(like[-1])
    yield pa.RecordBatch.from_arrays([pa.array(code[np.array([told] * len(code), bool) & (code >= 0)])], ["code"])


def repeated_windows(docs: DataFrame, text: str = "text", id_: str = "doc_id", window: int = WINDOW, run_bits: int = RUN_BITS, slice_words: int = SLICE) -> DataFrame:
    """(doc_id, own, start, size, mask) of windows whose words also begin elsewhere: `size` windows from word `start`, or those of a 64-bit mask.

    own is xxhash64 of the text. Windows are the same if 96 bits of hash are equal, runs if 128 bits are.
    """
    work = Workspace(docs.sparkSession)
    runs = work.keep(hit_runs(docs, text, id_, window, run_bits, slice_words), "runs")
    often = work.keep(runs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2"), "repeated-runs")
    whole = runs.select("doc_id", "own", "start", "size", "r1", "r2").join(often, ["r1", "r2"]).select("doc_id", "own", "start", "size", F.lit(None).cast("bigint").alias("mask"))
    distinct = runs.where("w1 is not null").dropDuplicates(["r1", "r2"]).join(often.withColumn("repeated", F.lit(True)), ["r1", "r2"], "left")
    distinct = work.keep(distinct.select(F.monotonically_increasing_id().alias("run"), F.coalesce("repeated", F.lit(False)).alias("repeated"), "doc_id", "own", "start", "size", "w1", "w2"), "distinct-runs")
    pool = distinct.select("run", "repeated", "size", "w1", "w2").mapInArrow(partial(_exploded, run_bits), "known boolean, w1 bigint, w2 int, code bigint")
    codes = pool.repartition("w1").sortWithinPartitions("w1", "w2").mapInArrow(_met_again, "code bigint")
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    masks = codes.groupBy(F.shiftrightunsigned("code", run_bits).alias("run"), F.shiftright(F.col("code").bitwiseAND(F.lit((1 << run_bits) - 1)), 6).cast("int").alias("slot")).agg(F.bit_or(bit).alias("mask"))
    single = distinct.where("not repeated").select("run", "doc_id", "own", "start").join(masks, "run")
    single = single.select("doc_id", "own", (F.col("start") + 64 * F.col("slot")).cast("int").alias("start"), F.lit(64).alias("size"), "mask")
    return work.keep(whole.unionByName(single), "repeated-windows")


def covered_words(n: int, marks: list[dict], window: int) -> np.ndarray:
    """Which of a text's n words stand in a marked window."""
    edge = np.zeros(n + 1, np.int32)
    for m in marks:
        if m["mask"] is None:
            edge[m["start"]] += 1
            edge[m["start"] + m["size"] + window - 1] -= 1
        else:
            own = m["start"] + np.flatnonzero(np.unpackbits(np.array([m["mask"]], "<i8").view(np.uint8), bitorder="little"))
            np.add.at(edge, own, 1)
            np.add.at(edge, own + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: str, marks: list[dict] | None, window: int) -> tuple[str, int, int]:
    """What is left of a text, its words, and the words removed."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at blank and \t..\r
    if not marks:
        return b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0
    gone = covered_words(len(words), marks, window)
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode("utf-8", "surrogatepass"), len(words), int(gone.sum())


def remove_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id", window: int = WINDOW, n_words: str = "n_words", n_removed: str = "n_removed", **limits: int) -> DataFrame:
    """All rows and columns of docs, with the words of `text` that stay joined by a blank, and two counts more (replaced if docs has them).

    A word goes if a window of `window` words of the text covers it that also begins anywhere else, in the same text or another.
    Words are runs of characters other than blank and \\t..\\r, compared as they are. All windows are judged on docs as given: no
    occurrence is kept. A null text stays null, without words. Repeated rows, with or without an id, are places of their own, so two
    equal rows of `window` words or more lose all words. Texts shorter than a window stay whole. There are no ties.
    Only marks travel to the texts, one row per text; a text is held by one task, whatever its length.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in (n_words, n_removed)])
    marks = repeated_windows(docs, text, id_, window, **limits).groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "size", "mask")).alias("_marks"))
    marks = marks.select(F.col("doc_id").alias("_marked_id"), F.col("own").alias("_marked_own"), "_marks")
    joined = docs.join(marks, docs[id_].eqNullSafe(F.col("_marked_id")) & (F.xxhash64(docs[text]) == F.col("_marked_own")), "left").drop("_marked_id", "_marked_own")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found = [_kept(t, m, window) if t is not None else (None, 0, 0) for t, m in zip(column(batch, text).to_pylist(), column(batch, "_marks").to_pylist(), strict=True)]
            columns = [pa.array([x[0] for x in found], pa.string()) if name == text else column(batch, name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[i] for x in found], pa.int64()) for i in (1, 2)]], [*names, n_words, n_removed])

    return joined.mapInArrow(run, schema)
