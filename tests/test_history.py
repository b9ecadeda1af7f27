"""Queries over run history against DuckDB, and rules of single operators on hand-made rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens import queries, state_queries  # noqa: F401
from runlens.functions import names, patterns
from runlens.operators import archives, derive, flakes, freshness, ingest, retention, search, where
from runlens.schema import Tables

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem customer events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["F4_workflows", "F7_job_globs", "Q1_U1_paths", "Q2_A2_rerun_flips", "K3_O2_flip_text", "Q3_W1_W2_intermittent", "G1_G4_regex", "J9_match_original", "J10_J11_attribution", "Q8_R1_R4_retention", "A12_stuck_units", "J20_reconcile", "Q5_N9_J13_where", "N24_G12_place_hits", "F13_many_shas", "F13_many_prs", "P8_P9_digests", "R2_evicted_trees", "N17_T5_listing_windows", "T8_T9_discovery", "Q7_T12_T14_status", "Q1_extracted_and_run_files", "Q4_findings"])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    c = duck.execute(queries.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(c.description)}
    want = sorted(tuple(str(r[at[x]]) for x in df.columns) for r in c.fetchall())
    assert sorted(tuple(str(x) for x in r) for r in df.collect()) == want and want


def test_slugs(spark):
    cases = {"main": "main", "feat/retry upload": "feat-retry-upload", "日本": "none", "": "none", "--a..b--": "a..b", "a" * 59 + "-b": "a" * 59, "ünï": "n", ".x.": "x"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string").select("a", "b", names.slug(F.col("a")).alias("c"))
    assert [r for r in df.collect() if r.b != r.c] == []


def test_locations(spark):
    base = "h.example/o/r/runs/2026-10-03/12_wf_main"
    cases = [
        (base, (12, None, None, None, "", None)),
        (base + "/attempt-2/jobs/7_x/log.txt", (12, 2, 7, None, "log.txt", None)),
        (base + "/artifacts/9_y/extracted/a/b", (12, None, None, 9, "extracted/a/b", None)),
        (base + "/attempt-02/x", (None, None, None, None, None, "not an attempt dir")),
        (base + "/attempt-1/jobs/x_1/log.txt", (None, None, None, None, None, "not a job dir")),
        ("h/o/r/runs/2026-13-03/12_a_b", (None, None, None, None, None, "not in a run dir")),
        ("h/../r/runs/2026-10-03/12_a_b", (None, None, None, None, None, "not in a run dir")),
        ("/" + base, (None, None, None, None, None, "not in a run dir")),
        ("a", (None, None, None, None, None, "not in a run dir")),
    ]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p string").select(names.parse_location(F.col("p")).alias("x"))
    got = [(r.x.run_id, r.x.attempt, r.x.job_id, r.x.artifact_id, r.x.file, r.x.reason) for r in df.collect()]
    assert got == [w for _, w in cases]


def test_patterns(spark):
    cases = [("job*", "job/1", True), ("job?", "job12", False), ("[]a]x", "]x", True), ("[^a]x", "bx", True), ("a.b", "axb", False), ("*", "", True)]
    for glob, text, fits in cases:
        assert spark.range(1).select(patterns.glob_match(F.lit(text), [glob])).first()[0] is fits, glob
    for bad in ("a\nb", r"a\nb", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.line_regex(bad)
    lines = [(r"\s", "a\x0bb", False), (r"\bé", "é", False), ("end$", "the end\r", False), ("(?P<x>a)", "a", True), ("[[:digit:]]", "7", True), ("", "", True)]
    for pattern, text, fits in lines:
        assert spark.range(1).select(patterns.line_predicate(F.lit(text), pattern)).first()[0] is fits, pattern
    assert spark.range(1).select(patterns.line_predicate(F.lit("Kelvin"), "kelvin", True, True)).first()[0]


def _tables(spark, jobs, steps=(), attempts=(), runs=()):
    key = "host string, repo string, run_id bigint"
    own = lambda rows: [("h", "r", *x) for x in rows]
    return Tables(
        spark.createDataFrame(own(runs), f"{key}, latest_attempt int, head_sha string, head_branch string, from_fork boolean, event string, workflow_id bigint, workflow_name string, created_at timestamp_ntz, pr_numbers array<int>"),
        spark.createDataFrame(own(attempts), f"{key}, attempt int, conclusion string, run_started_at timestamp_ntz"),
        spark.createDataFrame(own(jobs), f"{key}, attempt int, job_id bigint, name string, kind string, conclusion string, has_log boolean, path string"),
        spark.createDataFrame(own(steps), f"{key}, attempt int, job_id bigint, number int, name string, conclusion string"),
    )


def test_flips_in_any_row_order(spark):
    """A failed step flips while its job does not; a carried failure voids a success; two jobs of a name are one."""
    from datetime import datetime

    runs = [(1, 2, "abc", "main", False, "push", 1, "wf", datetime(2026, 1, 1), [])]
    attempts = [(1, 1, "failure", datetime(2026, 1, 1)), (1, 2, "success", datetime(2026, 1, 2))]
    jobs = [
        (1, 1, 10, "lint", "ran", "failure", True, "p10"),
        (1, 1, 11, "lint", "ran", "success", True, "p11"),
        (1, 2, 20, "lint", "ran", "success", True, "p20"),
        (1, 1, 12, "deploy", "ran", "timed_out", True, "p12"),
        (1, 2, 21, "deploy", "ran", "success", True, "p21"),
        (1, 2, 22, "deploy", "carried_forward", "failure", False, "p22"),
        (1, 1, 13, "test", "ran", "success", True, "p13"),
        (1, 2, 23, "test", "ran", "success", False, "p23"),
    ]
    steps = [(1, 1, 10, 1, "setup", "success"), (1, 1, 10, 2, "run", "failure"), (1, 1, 11, 1, "run", "success"), (1, 2, 20, 2, "run", "success"), (1, 1, 13, 1, "odd", "cancelled"), (1, 2, 23, 1, "odd", "success")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(jobs)
        random.Random(seed).shuffle(steps)
        got = flakes.rerun_flips(_tables(spark, jobs, steps, attempts, runs)).orderBy("job", "first_seen").collect()
        told = [(r.job, r.step, [(o.attempt, o.conclusion) for o in r.outcomes], r.logs, r.failing_steps) for r in got]
        assert want in (None, told)
        want = told
    assert want == [
        ("lint", "", [(1, "failure"), (2, "success")], ["p10", "p11", "p20"], ["run"]),
        ("lint", "run", [(1, "failure"), (2, "success")], ["p10", "p11", "p20"], []),
        ("test", "odd", [(1, "cancelled"), (2, "success")], ["p13"], []),
    ]


def test_isolated(spark, monkeypatch):
    """Known strings, and a long series with gaps, rows of one time and without a time, against its neighbours one by one."""
    import random
    from datetime import datetime, timedelta

    told = {"S": "success", "F": "failure", "C": "cancelled", "T": "timed_out", "-": ""}
    known = {"SSFSS": [2], "SFSFS": [1, 3], "SSSFF": [], "FSS": [], "SSF": [], "SFFS": [], "S": [], "": [], "SCS": [1], "STS": [1], "SF-FS": []}
    for days in (1, 20, 70):  # neighbours in one month, in the next, and beyond an empty one
        rows = [(x, datetime(2026, 1, 1) + timedelta(days=days * i), i, told[c]) for x in known for i, c in enumerate(x)]
        got = flakes.isolated(spark.createDataFrame(rows, "k string, start timestamp, i int, conclusion string"), ["k"], ["start", "i"]).collect()
        assert sorted((r.k, r.i) for r in got) == sorted((x, i) for x, own in known.items() for i in own)
    monkeypatch.setattr(flakes, "STRETCH", 7)
    rng = random.Random(4)
    starts = [None] * 3 + [datetime(2026, 1, 1) + timedelta(days=rng.randrange(600)) for _ in range(400)]
    order = sorted(range(403), key=lambda i: (starts[i] is not None, starts[i] or 0, i))
    kind = {i: rng.choice("SSSFCG") for i in order}  # G: a gap
    place = [("h", "r", 1, None if i % 2 else "main", "j", "", i, starts[i]) for i in order]
    schema = "host string, repo string, workflow_id bigint, head_branch string, job string, step string, run_id bigint, start timestamp"
    # Rows of two branches, one of them without a name, are two series.
    want = [i for b in (0, 1) for own in [[i for i in order if i % 2 == b]] for before, i, after in zip(own, own[1:], own[2:], strict=False) if kind[i] in "FC" and kind[before] == kind[after] == "S"]
    df = spark.createDataFrame(place, schema)
    kinds = spark.createDataFrame([(i, told.get(c, "gap")) for i, c in kind.items()], "run_id bigint, conclusion string")
    runs, missing = (df.join(kinds.where(f"conclusion {x} 'gap'"), "run_id") for x in ("<>", "="))
    series = flakes.with_gap_counts(runs, missing)
    assert {r.gaps for r in series.where("head_branch is null").collect()} == {sum(kind[i] == "G" for i in order if i % 2)}
    assert sorted(r.run_id for r in flakes.isolated(series, flakes.SERIES, ["start", "run_id"], apart="gaps_before", stretch=F.col("stretch")).collect()) == sorted(want)
    assert series.select("stretch").distinct().count() > 20
    assert len(want) > 20


def test_pages_of_listings(spark):
    rows = [("good", 2, [(1,), (2,)]), ("short", 3, [(1,)]), ("twice", 2, [(1,), (1,)]), ("none", 1, [(None,)]), ("empty", 0, [])]
    pages = spark.createDataFrame(rows, "listing string, total_count int, items array<struct<id bigint>>")
    good, bad = ingest.check_pages(pages, "items")
    assert sorted((r.listing, r.id) for r in good.collect()) == [("good", 1), ("good", 2)]
    assert {r.listing: r.reason for r in bad.collect()} == {"short": "fewer than counted", "twice": "duplicate id", "none": "missing id"}


def test_log_loss(spark):
    rows = [(410, "2026-01-01 00:00:00", "expired"), (404, "2026-01-01 00:00:00", "deleted"), (404, "2026-01-02 00:00:00", "retry"), (500, "2026-01-01 00:00:00", "error")]
    df = spark.createDataFrame(rows, "s int, u string, w string").withColumn("u", F.col("u").cast("timestamp"))
    got = df.select("w", derive.log_loss(F.col("s"), F.lit("blob"), F.col("u"), "1 day", F.lit("2026-01-03 00:00:00").cast("timestamp")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_freshness(spark):
    rows = [("a", None, None, None, None), ("b", "x", "kind", None, None), ("c", "x", None, None, None), ("d", "x", None, "2026-01-01 00:00:00", None), ("e", "x", None, "2026-01-02 23:59:00", "bad"), ("f", "x", None, "2026-01-02 23:59:00", None)]
    repos = spark.createDataFrame(rows, "repo string, synced_at string, blocked string, last_ok string, config_error string").withColumns({"last_ok": F.col("last_ok").cast("timestamp"), "sync_interval": F.lit(600)})
    pending = spark.createDataFrame([("f", "2026-01-02 00:00:00")], "repo string, since string").withColumn("since", F.col("since").cast("timestamp"))
    got = {r.repo: r.warning for r in freshness.freshness(repos, pending, F.lit("2026-01-03 00:00:00").cast("timestamp")).collect()}
    assert got == {"a": "never synced", "b": "blocked", "c": "no success", "d": "stale", "e": "bad config", "f": "stuck"}


def test_lines_and_context(spark):
    files = spark.createDataFrame([("a", "﻿one\ntwo\nthree\n"), ("b", "x\x00y\nz"), ("c", "last"), ("d", "")], "path string, text string")
    all_lines = search.lines(files)
    assert sorted((r.path, r.line, r.text) for r in all_lines.collect()) == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("c", 1, "last")]
    near = search.with_context(all_lines, search.grep(all_lines, "^o"), 1)
    assert sorted((r.line, r.is_hit) for r in near.collect()) == [(1, True), (2, False)]


def test_hits(spark):
    known = spark.createDataFrame([("a/b:1.txt",), ("a/b",)], "path string")
    hits = spark.createDataFrame([("a/b:1.txt:7:text: more",), ("a/b-3-ctx",), ("a/b",), ("zzz:1:x",)], "hit string")
    got = {r.hit: (r.path, r.line, r.text) for r in where.parse_hits(hits, known).collect()}
    assert got == {"a/b:1.txt:7:text: more": ("a/b:1.txt", 7, "text: more"), "a/b-3-ctx": ("a/b", 3, "ctx"), "a/b": ("a/b", None, None), "zzz:1:x": (None, None, None)}


def test_hits_at_the_longest_path(spark):
    cases = [
        ("d:x/log.txt:123:text: more", ["d:x/log.txt"], ("d:x/log.txt", 123, "text: more")),
        ("d:x/log.txt:text: 12: more", ["d:x/log.txt"], ("d:x/log.txt", None, "text: 12: more")),
        ("d/log.txt:2231", ["d/log.txt"], ("d/log.txt", 2231, "")),
        ("p-q-12-", ["p", "p-q"], ("p-q", 12, "")),
        ("p-q-x", ["p"], ("p", None, "q-x")),
        ("p-12", ["p"], ("p", None, "12")),
        ("p:012:x", ["p"], ("p", None, "012:x")),
        ("p:+12", ["p"], ("p", None, "+12")),
        ("p:0:x", ["p"], ("p", None, "0:x")),
        ("p:12x:y", ["p"], ("p", None, "12x:y")),
        (":1:x", [], (None, None, None)),
        ("dir/:1:x", ["dir/"], (None, None, None)),
        ("q" * 4095 + ":1:x", ["q" * 4095], ("q" * 4095, 1, "x")),
        ("r" * 4096 + ":1:x", ["r" * 4096], (None, None, None)),
    ]
    for i, (hit, paths, want) in enumerate(cases):
        known = spark.createDataFrame([(p, p.endswith("/")) for p in paths], "path string, is_dir boolean")
        got = where.parse_hits(spark.createDataFrame([(hit,)], "hit string"), known).first()
        assert (got.path, got.line, got.text) == want, i


def test_output_of_a_search_tool(spark):
    rows = [("a:1:x\r",), ("--",), ("  ",), ('a/b: binary file matches (found "\\0" byte around offset 7)',), ("",)]
    hits = where.hit_lines(spark.createDataFrame(rows, "hit string"))
    assert {r.hit for r in hits.collect()} == {"a:1:x", rows[3][0]}
    known = spark.createDataFrame([("a/b",)], "path string")
    assert [r.path for r in where.binary_notices(hits, known).collect()] == ["a/b"]


def test_literals_and_word_edges(spark):
    cases = [(r"\x41bcd", "xABCDAbcd", True), (r"\bthe\b", "see the end", True), (r"\bthe\b", "then", False), (r"x*\bab", "ab", True), (r"a?\b-", "a-", True), (r"\p{Lu}abc", "Xabc", True), (r"\Qa.b\E", "a.b", True)]
    for pattern, text, fits in cases:
        assert spark.range(1).select(patterns.line_predicate(F.lit(text), pattern)).first()[0] is fits, pattern


def test_retention_is_written_horizons_first(spark, tmp_path):
    from datetime import date

    rows = [("r", i, f"d{i}", f"2026-01-0{i}", 10) for i in range(1, 5)]
    runs = spark.createDataFrame(rows, "repo string, run_id bigint, dir string, date_dir string, bytes bigint").withColumns({"date_dir": F.col("date_dir").cast("date"), "created_at": F.col("date_dir").cast("timestamp")})
    trees = spark.createDataFrame([("r", 3, "d3", t, 2) for t in ("x", "y", "z")], "repo string, run_id bigint, dir string, tree string, tree_bytes bigint")
    victims = retention.plan_retention(runs, date(2026, 1, 2), 27, trees=trees)
    assert sorted((r.phase, r.run_id, r.tree) for r in victims.collect()) == [(1, 1, None), (2, 3, "x"), (2, 3, "y")]
    assert retention.past_cap(victims).first().trees == 2
    victims = retention.plan_retention(runs, date(2026, 1, 2), 15, trees=trees)
    written = retention.execute(runs, victims, None, {"runs": runs}, str(tmp_path))
    # 24 bytes are left without the trees; one run of 10 goes.
    assert sorted(r.run_id for r in written["runs"].collect()) == [3, 4]
    assert str(written["horizons"].first().horizon) == "2026-01-02 00:00:00"


def test_retention_rules(spark):
    rows = [("r", i, f"d{i}", f"2026-01-0{i}", 10, 4 if i < 4 else 0) for i in range(1, 7)]
    runs = spark.createDataFrame(rows, "repo string, run_id bigint, dir string, date_dir string, bytes bigint, extracted_bytes bigint").withColumns({"date_dir": F.col("date_dir").cast("date"), "created_at": F.col("date_dir").cast("timestamp")})
    from datetime import date

    got = sorted((r.phase, r.run_id) for r in retention.plan_retention(runs, date(2026, 1, 2), 35).collect())
    # 50 bytes are kept: two trees go (46, 42), then runs 2 and 3 of 6 bytes (36, 30).
    assert got == [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3)]


def test_archives(spark):
    import io
    import stat
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("A.txt", "two")
        z.writestr("../x", "no")
        z.writestr("n.zip", inner.getvalue())
        link = zipfile.ZipInfo("link")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "a.txt")
    rows = spark.createDataFrame([("p", bytearray(outer.getvalue())), ("broken", bytearray(b"PK\x03\x04nonsense"))], "path string, content binary")
    got = archives.expand(rows)
    told = {(r.path, r.inner_path, r.status, r.reason) for r in got.collect()}
    assert ("p", "a.txt", "extracted", None) in told and ("p", "A.txt~1", "extracted", None) in told
    assert ("p", "n.zip.d/deep.txt", "extracted", None) in told
    assert ("p", "../x", "skipped", "outside") in told and ("p", "link", "skipped", "symlink") in told
    assert ("broken", None, "rejected", "artifact rejected") in told
    over = archives.expand(rows, archives.Limits(bytes=4)).where("path = 'p'").collect()
    assert [(r.status, r.reason) for r in over] == [("rejected", "artifact rejected")]
    assert archives.manifest(got).where("path = 'p'").first().extracted == 4


def test_damaged_and_deep_archives(spark):
    """Members before damage stay, what is an archive is told by its bytes, and what is too deep is named."""
    import io
    import tarfile
    import zipfile

    def zipped(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, mode in (("a", 0o4755), ("b" * 300, 0o644), ("/".join("d" * 40) + "/f", 0o644), ("c\x01d", 0o644)):
            info = tarfile.TarInfo(name)
            info.size, info.mode = 3, mode
            t.addfile(info, io.BytesIO(b"abc"))
    deep = b"core"
    for i in range(4):
        deep = zipped(f"level{i}.bin", deep)
    whole = tar.getvalue()
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"0" * 5_000_000)
    rows = [("tar", whole), ("cut", whole[:1536]), ("deep", deep), ("bomb", bomb.getvalue())]
    got = archives.expand(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), archives.Limits(bytes=1_000_000, nesting=2)).collect()
    of = lambda p: [(r.inner_path, r.status, r.reason, r.note) for r in got if r.path == p]
    assert ("a", "extracted", None, "setuid_dropped") in of("tar") and ("b" * 60, "extracted", None, "too_long") in of("tar") and ("c-d", "extracted", None, "invalid") in of("tar")
    assert any(note == "too_deep" and len(p.split("/")) == 32 for p, _, _, note in of("tar"))
    assert ("a", "extracted", None, "setuid_dropped") in of("cut") and (None, "not_expanded", "partial", None) in of("cut")
    assert {p for p, *_ in of("deep")} == {"level3.bin", "level3.bin.d/level2.bin", "level3.bin.d/level2.bin.d/level1.bin", None} and (None, "not_expanded", "nesting", None) in of("deep")
    assert of("bomb") == [(None, "rejected", "artifact rejected", None)]


def test_names_of_members():
    """One note a name, the first that applies; names that meet in one folder, folders included."""
    odd = "re\u200dport.txt"
    cases = {
        "./a": (["a"], "", ""), "a/": (["a"], "", ""), "a//b": (["a", "b"], "", "normalized"), "x/../a": (["a"], "", "normalized"), ".": (["none"], "", "invalid"), "/a": ([], "absolute", ""),
        "../a": ([], "outside", ""), "a/../../b": ([], "outside", ""), "..a": (["..a"], "", ""), odd: ([odd], "", ""), "a\nb": (["a-b"], "", "invalid"), "bad\udc80": (["bad"], "", "invalid"),
        ".gitignore": ([".gitignore~lg"], "", "rg_ignore_file"), "d/.IGNORE": (["d", ".IGNORE~lg"], "", "rg_ignore_file"), ".ignore/f": ([".ignore", "f"], "", ""), "a\\b": (["a\\b"], "", ""),
    }
    assert {k: archives._safe_parts(k) for k in cases} == cases
    assert archives._safe_parts("/".join("d" * 31), "n.zip.d")[0] == ["d"] * 31
    assert archives._safe_parts("/".join("d" * 32), "n.zip.d")[::2] == (["d"] * 30 + ["d-d"], "too_deep")
    long = "/".join(["x" * 190] * 3)
    parts, _, note = archives._safe_parts(long)
    assert note == "too_long" and parts == ["x" * 190] * 2 + ["x" * 60]
    taken = archives._Names()
    wanted = ["a.txt", "A.txt", "a.TXT", "manifest.json", "a.txt/b", "a.txt/c", "A.TXT/b", "n/x", "n", "n/y", "caf\u00e9", "cafe\u0301", "n~1"]
    given = ["a.txt", "A.txt~1", "a.TXT~2", "manifest.json~1", "a.txt~3/b", "a.txt~3/c", "A.TXT~4/b", "n/x", "n~1", "n/y", "caf\u00e9", "cafe\u0301~1", "n~1~1"]
    assert [taken.take(x.split("/")) for x in wanted] == given
    assert archives._Names("n.zip.d").take(["manifest.json"]) == "manifest.json"
