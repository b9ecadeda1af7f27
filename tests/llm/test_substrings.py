"""Removal of repeated word sequences against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from runlens.llm import substring_dedup


def brute_force(texts: list, window: int) -> list[tuple]:
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((None if t is None else b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return out


def random_texts(rng: random.Random, n: int, window: int) -> list:
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [text(rng.choice((window - 1, window, window + 1, 2 * window, 5 * window))) for _ in range(6)]
    out = [None, "", " \n\t", "a " * (3 * window), "b " * (window - 1), ("x y z " * window).strip(), "one word été"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += text(rng.randint(0, 2 * window)) if rng.random() < 0.5 else rng.choice(passages)[rng.randint(0, 3) :]
        out.append(rng.choice((" ", "\n", "  ")).join(parts))
    return out + [out[8], out[9], out[9]]


def got(spark, texts, window, **limits):
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, i, t) for i, t in enumerate(texts)], "doc_id bigint, row int, text string").repartition(5)
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("start", F.lit("clash")).withColumn("own", F.lit(1))
    rows = substring_dedup.remove_repeats(docs, window=window, **limits).select("row", "text", "n_words", "n_removed").collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_as_by_brute_force(spark):
    for seed, window, run_bits, size in ((1, 35, 12, 1 << 18), (2, 7, 6, 64), (3, 4, 7, 50), (4, 1, 6, 100)):
        texts = random_texts(random.Random(seed), 60, window)
        want = brute_force(texts, window)
        assert got(spark, texts, window, run_bits=run_bits, slice_words=size) == want
        assert 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


def test_long_text_and_full_filter(spark, monkeypatch):
    """A text of many slices, and a filter so small that it lets nearly all windows pass."""
    monkeypatch.setattr(substring_dedup, "MOST_FILTER_BITS", 1)
    monkeypatch.setattr(substring_dedup, "LEAST_FILTER_BITS", 1)
    rng = random.Random(9)
    long = [f"v{rng.randrange(40_000)}" for _ in range(120_000)]
    texts = [" ".join(long), " ".join(long[500:900]), " ".join(long[119_000:]), "free of it " * 3]
    assert got(spark, texts, 35) == brute_force(texts, 35)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
