"""The trie of conversations against brute force."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

from pyspark.sql import functions as F

from runlens.llm import prefix_trie


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {}
    for c in own:
        turns = [x[2:] for x in sorted(own[c])]
        h = crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        first = [x[2:] for x in sorted(own.get(base, []))]
        told[c] = tuple(first[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in told.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode().split() if p else []) + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def got(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    nodes = prefix_trie.conversation_trie(df, **limits)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if x is None else x for x in r) for r in nodes.select(*columns).collect())


def random_rows(rng, n):
    rows = [(None, 1, "user", "no conversation"), (-7, 1, "user", "below zero"), (-7, 2, None, None), (-27, None, "", "x y")]
    said = ["yes", "no\tthen", "", "é  ü ", "a b c d e"]
    for c in range(n):
        if c % 20 == 0 and c % 3 == 0:
            continue
        for turn in range(rng.choice((1, 2, 3, 4, 6, 9))):
            rows.append((c, turn if turn else None, ("user", "assistant")[turn % 2], rng.choice(said) if turn else "hello there"))
    rows += [(2000 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]
    rows += [(3000, t, "user", f"long {t % 5} of it") for t in range(150)] + [(3100, t, "user", f"long {t % 5} of it") for t in range(150)] + [(3101, t, "user", f"long {t % 5} of it") for t in range(97)]
    return rows


def test_as_by_brute_force(spark):
    rows = random_rows(random.Random(2), 150)
    want = brute_force(rows)
    for container, segment in ((256, 32), (2, 3), (5, 1), (4, 200)):
        assert got(spark, rows, container=container, segment=segment) == want
    assert len(want) > 400


def test_stretches_of_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENTS_AT_ONCE", 3)
    monkeypatch.setattr(prefix_trie, "DIGEST_BITS", 2)
    monkeypatch.setattr(prefix_trie, "MOST_SENT", 0)
    rows = random_rows(random.Random(7), 60)
    assert got(spark, rows, container=3, segment=4) == brute_force(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_ties_and_repeats_are_turns(spark):
    rows = [(1, 5, "user", "a b"), (1, 5, "user", "a b"), (1, None, None, None), (2, 5, "user", "a b")]
    assert sum(x[3] for x in got(spark, rows) if x[1] == 0) == 2
    assert max(x[1] for x in got(spark, rows)) == 3 - min(3, crc32(b"1") % 4)
