"""Hits of a search tool: the path they begin with, and the line that holds their text."""

import random

from pyspark.sql import functions as F

from runlens.operators import search, where


def brute_force(hit, known):
    """The longest known path that the hit is, or that a : or - follows in it."""
    found = [p for p, is_dir in known if hit == p or not is_dir and hit.startswith(p) and hit[len(p) : len(p) + 1] in (":", "-")]
    return max(found, key=len, default=None)


def test_paths_as_by_brute_force(spark):
    rng = random.Random(6)
    names = ["a", "b-c", "d:e", "f", "b-c:1", "x y", "é-1", "log.txt", "log.txt-2"]
    known = {("/".join(rng.choice(names) for _ in range(rng.randint(1, 4))), rng.random() < 0.2) for _ in range(80)} | {("top", False), ("/rooted/a", False)}
    known = list(dict(sorted(known)).items())
    hits = [rng.choice(known)[0] + rng.choice(["", ":12:text", "-3-text: a/b-c", ":x", "/", "-", "/f:1:", ":1:" + "-/:" * 2000]) for _ in range(400)] + ["", ":", "/", "nothing-at:all", "/rooted/a:1:x", "top-1-"]
    got = where.parse_hits(spark.createDataFrame([(h,) for h in hits], "hit string"), spark.createDataFrame(known, "path string, is_dir boolean")).collect()
    assert len(got) == len(hits)
    for r in got:
        assert r.path == brute_force(r.hit, known), r.hit[:80]


def test_rows_of_a_hit_are_bounded_by_depth(spark):
    known = spark.createDataFrame([("h/o/r/log.txt",), ("h/o/r/log.txt-old",)], "path string")
    hit = "h/o/r/log.txt:1:" + "a-b:c/" * 5000
    assert where.candidate_paths(spark.createDataFrame([(hit,)], "hit string"), known).count() <= 2
    assert where.candidate_paths(spark.createDataFrame([(hit,)], "hit string"), known.limit(0)).count() == 0


def test_many_hits_in_one_file(spark):
    """50 000 hits of one file meet their own lines; those that miss are found by a word, without all lines of the file for each."""
    n = 50_000
    lines = spark.range(n).select(F.expr("if(id >= 0, 'p', 'q')").alias("path"), (F.col("id") + 1).cast("int").alias("line"), F.concat(F.lit("at step"), F.col("id").cast("string"), F.lit(" ok then")).alias("text"))
    right = lines.where("line % 10 > 0").select("path", "line", "text")
    wrong = lines.where("line % 10 = 0").select("path", (F.col("line") + 1).alias("line"), F.substring("text", 2, 1000).alias("text"))
    lost = spark.createDataFrame([("p", 7, "no such text here"), ("q", 1, "x"), ("p", 3, "then"), ("p", 99, "")], "path string, line int, text string")
    got = search.verified(right.unionByName(wrong).unionByName(lost), lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    told = got.selectExpr("line", "verified_line", "text").collect()
    assert len(told) == n + 4
    by = {(r.line, r.text): r.verified_line for r in told}
    assert by[(7, "no such text here")] is None and by[(1, "x")] is None and by[(3, "then")] == 3 and by[(99, "")] == 99
    assert sum(r.verified_line == r.line - 1 for r in told if r.text.startswith("t step")) == n // 10
    assert sum(r.verified_line == r.line for r in told if r.text.startswith("at step")) == n - n // 10
