"""Hard negatives of anchors by filtered inner products (operator 13).

Every vector is stored with the mean and the deviation of each of its segments, at three widths. The product of two segments lies within the product of
their deviations around the product of their means, so the sums over all segments bound a score from both sides. Blocks of anchors meet blocks of rows: the wide segments
are looked at first, and what they leave is refined by narrower ones, before the scores that are left are computed exactly. A row is left out only where its
bounds show that it can't be among an anchor's first, or not within the band of any of its positives; so nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import column
from .workspace import Workspace

#: Components of a segment, level by level; vectors are filled up with zeros to a multiple of the first.
WIDTHS = (64, 8, 2)
#: Anchors sent to all tasks at once (about 1 KB each at 64 components), and anchors and rows of a block.
ANCHORS_AT_ONCE, BLOCK_ANCHORS, BLOCK_ROWS = 1 << 15, 1 << 11, 1 << 10
#: Candidates of a block beyond which each anchor's first are told apart before sorting.
MANY = 200_000
EXACT = float(1 << 53)


def summaries(vectors: np.ndarray) -> np.ndarray:
    """For each level, means and deviations of all segments in a row, scaled so that products of whole segments are bounded."""
    out = []
    for width in WIDTHS:
        parts = vectors.reshape(len(vectors), -1, width)
        mean = parts.mean(axis=2, keepdims=True)
        out += [mean[:, :, 0] * width**0.5, np.sqrt(((parts - mean) ** 2).sum(axis=2))]
    return np.concatenate(out, axis=1).astype(np.float32)


def _filled(rows: list[np.ndarray], size: int, kind: type) -> np.ndarray:
    out = np.zeros((len(rows), size), kind)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class Vectors:
    """Rows of an index in memory: ids, labels, whole-number components, and summaries by level."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        get = (lambda name: column(batch, name)) if isinstance(batch, pa.RecordBatch) else (lambda name: batch[name].combine_chunks())
        self.ids, self.labels = get("vec_id").to_numpy(), get("label").to_numpy()
        raw = [np.frombuffer(x, np.int64) for x in get("components").to_pylist()]
        self.size = max([WIDTHS[0], *map(len, raw)])
        self.whole = _filled(raw, self.size, np.int64)
        self.most = float(np.abs(self.whole.astype(np.float64)).max(initial=0))
        self.values = self.whole.astype(np.float64)
        if all(len(x) == self.size for x in raw):
            flat = np.frombuffer(b"".join(get("summary").to_pylist()), np.float32).reshape(len(raw), -1)
        else:  # rows of several lengths: as if all were filled up
            flat = summaries(self.values)
        ends = np.cumsum([self.size // w for w in WIDTHS for _ in (0, 1)])
        parts = np.split(flat.astype(np.float64), ends[:-1], axis=1)
        self.levels = [(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        self.norms = np.sqrt((self.levels[0][0] ** 2 + self.levels[0][1] ** 2).sum(axis=1))


def _level(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(x.shape[1], y.shape[1])  # what one side lacks is zero
    return x[:, :n], y[:, :n]


def candidate_scores(anchors: Vectors, rows: Vectors, a: slice, r: slice, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs of two blocks whose score can lie between the anchor's `least` and `most`."""
    at, of, mask = np.arange(len(anchors.ids))[a], np.arange(len(rows.ids))[r], allowed
    size = min(anchors.size, rows.size)
    exact = size * anchors.most * rows.most < EXACT
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True) if exact else ():
        left, above = mask.any(axis=1), mask.any(axis=0)
        if not left.all() or not above.all():
            at, of, mask = at[left], of[above], mask[left][:, above]
        if not mask.size:
            break
        x, y = _level(am[at], rm[of])
        middle = x @ y.T
        x, y = _level(ad[at], rd[of])
        around = x @ y.T + 1e-5 * np.outer(anchors.norms[at], rows.norms[of]) + 1e-3
        mask = mask & (middle + around >= least[at - a.start][:, None]) & (middle - around <= most[at - a.start][:, None])
    i, j = np.nonzero(mask)
    if exact and len(i) * 4 < mask.size:
        score = np.einsum("ij,ij->i", anchors.values[at[i], :size], rows.values[of[j], :size]).astype(np.int64)
    else:
        x = (anchors.values, rows.values) if exact else (anchors.whole, rows.whole)
        score = (x[0][at, :size] @ x[1][of, :size].T)[i, j].astype(np.int64)
    return at[i], of[j], score


class Best:
    """The first k rows of each of n keys, by score and then by id, of all rows offered so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """The score from which a row can still come among the first."""
        return np.where(self.filled == self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def offer(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        full = self.filled[key] == self.k
        wanted = ~full | (score >= self.score[key, -1])
        key, ids, score = key[wanted], ids[wanted], score[wanted]
        if not len(key):
            return
        touched = np.unique(key)
        old = np.arange(self.k)[None, :] < self.filled[touched][:, None]
        key = np.concatenate([key, np.repeat(touched, old.sum(axis=1))])
        ids, score = np.concatenate([ids, self.id[touched][old]]), np.concatenate([score, self.score[touched][old]])
        order = np.lexsort((ids, -score.astype(np.float64), key)) if not len(score) or np.abs(score).max() < EXACT else np.lexsort((ids, ~score, key))
        key, ids, score = key[order], ids[order], score[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        first = nth < self.k
        key, ids, score, nth = key[first], ids[first], score[first], nth[first]
        self.id[key, nth], self.score[key, nth] = ids, score
        self.filled[touched] = np.bincount(np.searchsorted(touched, key), minlength=len(touched))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, nth = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        return key, self.id[key, nth], self.score[key, nth]


def _blocks(anchors: Vectors, rows: Vectors) -> Iterator[tuple[slice, slice]]:
    for x in range(0, len(rows.ids), BLOCK_ROWS):
        for y in range(0, len(anchors.ids), BLOCK_ANCHORS):
            yield slice(y, min(y + BLOCK_ANCHORS, len(anchors.ids))), slice(x, min(x + BLOCK_ROWS, len(rows.ids)))


def first_of_label(anchors: Vectors, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """The first k rows of each anchor's own label among the batches, itself left out."""
    best = Best(len(anchors.ids), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Vectors(batch)
        for a, r in _blocks(anchors, rows):
            allowed = (anchors.labels[a][:, None] == rows.labels[r][None, :]) & (anchors.ids[a][:, None] != rows.ids[r][None, :])
            i, j, score = candidate_scores(anchors, rows, a, r, allowed, best.least()[a], np.full(a.stop - a.start, np.inf))
            best.offer(i, rows.ids[j], score)
    return best


def first_in_bands(anchors: Vectors, low: np.ndarray, high: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """The first k rows of other labels in each band of each anchor; bands (n anchors × m) that hold nothing have low above high."""
    n, m = low.shape
    best = Best(n * m, k)
    open_ = low <= high
    top = np.where(open_, high.astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Vectors(batch)
        for a, r in _blocks(anchors, rows):
            floor = np.where(open_, np.maximum(best.least().reshape(n, m), low), np.inf).min(axis=1, initial=np.inf)
            allowed = (anchors.labels[a][:, None] != rows.labels[r][None, :]) & open_[a].any(axis=1)[:, None]
            i, j, score = candidate_scores(anchors, rows, a, r, allowed, floor[a], top[a])
            for p in range(m):
                held = np.flatnonzero(open_[i, p] & (score >= low[i, p]) & (score <= high[i, p]))
                if len(held) > MANY:  # of an anchor's first k no other is needed
                    order = held[np.lexsort((-score[held], i[held]))]
                    nth = np.arange(len(order)) - np.searchsorted(i[order], i[order])
                    last = np.full(n, np.iinfo(np.int64).min)
                    last[i[order[nth == k - 1]]] = score[order[nth == k - 1]]
                    held = held[score[held] >= last[i[held]]]
                best.offer(i[held] * m + p, rows.ids[j[held]], score[held])
    return best


def vector_index(vectors: DataFrame, id_: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, components, summary) of rows with an id, a label and finite components; components become floor(scale * x)."""
    rows = vectors.select(F.col(id_).cast("bigint").alias("vec_id"), label.cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column(batch, "x")
            size = np.diff(x.offsets.to_numpy())
            flat = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            width = np.maximum(-(-size // WIDTHS[0]), 1) * WIDTHS[0]
            components, told = [b""] * len(size), [b""] * len(size)
            begin = np.cumsum(size) - size
            for w in np.unique(width):  # one, unless vectors differ in length
                own = np.flatnonzero(width == w)
                whole = _filled([flat[b : b + n] for b, n in zip(begin[own], size[own], strict=True)], w, np.int64)
                for i, v, s in zip(own, whole, summaries(whole.astype(np.float64)), strict=True):
                    components[i], told[i] = v.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), pa.array(components, pa.binary()), pa.array(told, pa.binary())], ["vec_id", "label", "components", "summary"])

    return rows.mapInArrow(run, "vec_id bigint, label int, components binary, summary binary")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of the tasks' firsts, the first k of each key, with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], id_: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_at_once: int = ANCHORS_AT_ONCE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    is_anchor: which ids are anchors, given the id column. An anchor's positives are its first `positives` other rows of the same label, by inner product
    and then by smaller id. Its negatives for one of them are the first `negatives` rows of other labels whose score is `low` to `high` percent
    of the positive's. Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Of rows that share an id the one
    with the least label and components does. Vectors of unlike lengths are filled up with zeros; an empty one scores 0. Scores are 64-bit; beyond that they wrap.
    An anchor without rows of its label, and a positive without a row in its band, give nothing. An empty table gives an empty result.

    All rows are read twice for every anchors_at_once anchors, which are sent to all tasks; a task hands on its first rows of each anchor.
    """
    spark = vectors.sparkSession
    work = Workspace(spark)
    index = work.keep(vector_index(vectors, id_, vector, F.col(label) if isinstance(label, str) else label, scale), "index")
    again = work.keep(index.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if not again.isEmpty():
        least = index.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "components", "summary")).alias("v")).select("vec_id", "v.*")
        index = work.keep(index.join(again, "vec_id", "left_anti").unionByName(least), "index-of-ids")
    anchors = index.where(is_anchor(F.col("vec_id")))
    chunks = -(-anchors.count() // anchors_at_once)
    found = []
    for c in range(chunks):
        sent = spark.sparkContext.broadcast(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow())

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Vectors(sent.value)
            at, ids, score = first_of_label(own, batches, positives).rows()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.ids[at], ids, score)], ["anchor_id", "id", "score"])

        near = _first(index.mapInArrow(nearest, "anchor_id bigint, id bigint, score bigint"), ["anchor_id"], positives)
        near = work.keep(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").alias("nth"), F.col("score").alias("positive_score")), "positives")
        bands = spark.sparkContext.broadcast(near.select("anchor_id", "nth", "positive_score").toArrow())

        def within(batches: Iterator[pa.RecordBatch], sent=sent, bands=bands) -> Iterator[pa.RecordBatch]:
            own, told = Vectors(sent.value), bands.value
            order = np.argsort(own.ids)
            at = order[np.searchsorted(own.ids, told["anchor_id"].to_numpy(), sorter=order)]
            nth = told["nth"].to_numpy() - 1
            lows, highs = np.ones((len(own.ids), positives), np.int64), np.zeros((len(own.ids), positives), np.int64)
            scores = told["positive_score"].to_pylist()  # Python's numbers don't overflow
            lows[at, nth] = [-(-low * s // 100) for s in scores]
            highs[at, nth] = [high * s // 100 for s in scores]
            key, ids, score = first_in_bands(own, lows, highs, batches, negatives).rows()
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[key // positives]), pa.array((key % positives + 1).astype(np.int32)), pa.array(ids), pa.array(score)], ["anchor_id", "nth", "id", "score"])

        hard = _first(index.mapInArrow(within, "anchor_id bigint, nth int, id bigint, score bigint"), ["anchor_id", "nth"], negatives)
        joined = hard.join(near, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.append(work.keep(joined, "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
