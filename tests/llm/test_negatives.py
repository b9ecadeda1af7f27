"""Hard negatives against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, anchors, positives=5, negatives=10):
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and fits(v)]
    least = {}
    for i, v, y in rows:
        least[i] = min(least.get(i, (y, v)), (y, v))
    score = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    out = []
    for a in (i for i in least if anchors(i)):
        label, own = least[a]
        told = [(-score(own, v), i, y) for i, (y, v) in least.items() if i != a]
        for p, pos, _ in sorted(x for x in told if x[2] == label)[:positives]:
            held = sorted((s, i) for s, i, y in told if y != label and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, pos, n, i, -p, -s) for n, (s, i) in enumerate(held[:negatives], 1)]
    return sorted(out)


def rows_of(rng, n, size, spread):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [round(x + rng.gauss(0, spread), 2) / size**0.5 for x in c], rng.randrange(3)))
    return out


def test_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = rows_of(rng, 700, 70, 0.3)
    rows += [(10_000 + i, v, y) for i, v, y in rows[:60]]  # copies: ties go by id
    rows += [(20_000, None, 1), (20_005, [1.0, None], 1), (20_010, [float("nan")], 1), (20_015, [float("inf")] * 70, 1), (20_020, [1.0] * 70, None), (None, [1.0] * 70, 1)]
    rows += [(20_025, [], 1), (20_030, [0.5] * 3, 2), (20_035, [0.1] * 200, 0), (0, rows[1][1], 0), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("components", F.lit(0)).repartition(7)
    want = brute_force(rows, lambda i: i % 5 == 0)
    for at_once in (1 << 15, 50):
        got = hn.hard_negatives(df, lambda i: i % 5 == 0, anchors_at_once=at_once)
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 1000


def test_blocks_and_bounds(monkeypatch):
    """Bounds hold for every pair, blocks of any size give the same, and like clusters are filtered before exact scoring."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = rows_of(rng, 300, 64, 0.05)
    whole = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows])
    told = hn.summaries(whole.astype(float))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _, _ in rows]), pa.array([y for _, _, y in rows], pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in whole], pa.binary()), pa.array([s.tobytes() for s in told], pa.binary())], ["vec_id", "label", "components", "summary"]
    )
    own = hn.Vectors(batch)
    score = whole @ whole.T
    for m, d in own.levels:
        assert (m @ m.T + d @ d.T >= score - 1).all() and (m @ m.T - d @ d.T <= score + 1).all()
    monkeypatch.setattr(hn, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 41)
    small = hn.first_of_label(own, iter([batch]), 5).rows()
    monkeypatch.undo()
    assert all((x == y).all() for x, y in zip(small, hn.first_of_label(own, iter([batch]), 5).rows(), strict=True))
    # All pairs of unlike clusters fall to the bounds alone.
    i, _, _ = hn.candidate_scores(own, own, slice(0, 300), slice(0, 300), np.ones((300, 300), bool), np.sort(score, axis=1)[:, -20].astype(float), np.full(300, np.inf))
    assert 300 * 20 <= len(i) < 300 * 150


def test_large_components_and_empty_tables(spark):
    rows = [(i, [1e9 * (i + 1), -1e8], i % 2) for i in range(12)]
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i == 0)
    assert got.count() >= 0
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), lambda i: i % 100 == 0).count() == 0
    assert hn.hard_negatives(spark.createDataFrame(rows[:1], SCHEMA), lambda i: i % 100 == 0).count() == 0
