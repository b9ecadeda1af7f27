"""Passages whose end is rewritten or cut, against brute force."""

import random
from collections import Counter

from runlens.llm import decontamination


def similarity(x: list[str], y: list[str]) -> float:
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (x, y))
    return (a & b).total() / (a | b).total()


def test_passages_that_differ_at_an_end(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for i in range(300):
        item = words(rng.randint(16, 59))
        changed = (len(item) - 4) // 7
        own = (item[:-changed] + words(changed), words(changed) + item[changed:], item[:-changed])[i % 3]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(own)))
        if similarity(own, item) >= 0.75:
            want.add((i, i))
    got = decontamination.find_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want) == 300
    assert got == want


def test_items_that_are_shuffled_are_found_as_those_sent(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(6, 40)))) for i in range(40)]
    docs = [(i if i % 9 else None, " ".join([*words(30), items[i][1], *words(20)])) for i in range(40)] * 2
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    told = [sorted(map(str, decontamination.find_passages(docs, items, most_sent=n).collect())) for n in (500_000, 0)]
    assert told[0] == told[1] and len(told[0]) >= 40


def test_all_windows_as_by_brute_force(spark):
    """Every window of the item's size that is like it is found, with the number of such windows."""
    rng = random.Random(6)
    item = [f"w{i}" for i in range(24)]
    text = [f"x{i}" for i in range(40)] + item[:23] + ["y"] + item + [f"z{i}" for i in range(30)]
    rng.shuffle(text[:40])
    want = [i for i in range(len(text) - 23) if similarity(text[i : i + 24], item) >= 0.75]
    got = decontamination.find_passages(spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).first()
    assert got.n_windows == len(want) and got.start == 64 and got.similarity == 1.0
