"""Forms and order of findings, hits and lists, on hand-made rows."""

import json
from datetime import datetime

import pyspark.sql.functions as F

from runlens.operators import ingest, paths, search
from runlens.schema import Tables
from runlens.sources import sinks

KEY = "host string, repo string, run_id bigint"


def _values(df):
    return [r.value for r in df.collect()]


def test_flips(spark):
    schema = f"{KEY}, head_sha string, job string, step string, outcomes array<struct<attempt int, conclusion string>>, logs array<string>, failing_steps array<string>, first_seen struct<attempt int, job_id bigint, pos int>"
    both = [(1, "failure"), (2, "success")]
    rows = [
        ("h", "r", 9, "1a51097b2", "a", "", both, [], [], (1, 5, -1)),
        ("h", "r", 7, "abc", 'un"it', "later", both, ["p"], [], (1, 4, 2)),
        ("h", "r", 7, "abc", 'un"it', "", both, ["p", "q"], ["zz first", "later"], (1, 4, -1)),
        ("h", "r", 7, "abc", 'un"it', "zz first", both, [], [], (1, 4, 1)),
    ]
    flips = spark.createDataFrame(rows, schema)
    assert _values(sinks.flip_text(flips)) == [
        'run 7 (sha abc): "un\\"it": 1:failure 2:success; failing steps: "zz first", "later"',
        'run 7 (sha abc): "un\\"it" / "zz first": 1:failure 2:success',
        'run 7 (sha abc): "un\\"it" / "later": 1:failure 2:success',
        'run 9 (sha 1a51097): "a": 1:failure 2:success',
    ]
    told = [json.loads(x) for x in _values(sinks.flip_json(flips))]
    assert [x["step"] for x in told] == [None, "zz first", "later", None]
    assert told[0] == {"kind": "rerun", "run_id": 7, "head_sha": "abc", "job": 'un"it', "step": None, "attempts": [1, 2], "conclusions": ["failure", "success"], "failing_steps": ["zz first", "later"], "logs": ["p", "q"]}
    assert told[3]["logs"] == [] and list(told[0]) == ["kind", "run_id", "head_sha", "job", "step", "attempts", "conclusions", "failing_steps", "logs"]


def test_failures_alone(spark):
    schema = (
        "host string, repo string, workflow_id bigint, head_branch string, job string, step string, workflow_name string, runs bigint, "
        "first_seen struct<start timestamp, run_id bigint, job_id bigint, pos int>, failures array<struct<start timestamp, run_id bigint, head_sha string, conclusion string, logs array<string>>>"
    )
    at = datetime(2026, 1, 2)
    rows = [
        ("h", "r", 3, "main", "test", "unit", "ci", 6, (at, 1, 1, 1), [(at, 18, "a1b2c3d4", "failure", ["x"]), (at, 19, "ff", "timed_out", None)]),
        ("h", "r", 3, "main", "test", "", "ci", 6, (at, 1, 1, -1), [(at, 18, "a1b2c3d4", "failure", ["x"])]),
        ("h", "r", 3, "dev", "z", "", "ci", 3, (at, 1, 1, -1), [(at, 20, None, "failure", ["y"])]),
    ]
    found = spark.createDataFrame(rows, schema)
    assert _values(sinks.intermittent_text(found)) == [
        'workflow "ci" on dev: "z": 1 of 3 runs failed alone: run 20 (sha ) failure',
        'workflow "ci" on main: "test": 1 of 6 runs failed alone: run 18 (sha a1b2c3d) failure',
        'workflow "ci" on main: "test" / "unit": 2 of 6 runs failed alone: run 18 (sha a1b2c3d) failure, run 19 (sha ff) timed_out',
    ]
    last = json.loads(_values(sinks.intermittent_json(found))[2])
    assert last == {
        "kind": "intermittent", "workflow_id": 3, "workflow": "ci", "branch": "main", "job": "test", "step": "unit", "runs": 6, "logs": ["x"],
        "failures": [{"run_id": 18, "head_sha": "a1b2c3d4", "conclusion": "failure"}, {"run_id": 19, "head_sha": "ff", "conclusion": "timed_out"}],
    }


def test_hits_and_path_lists(spark, tmp_path):
    hits = spark.createDataFrame([("a/log.txt", 3, "x: y"), ("odd\nname", 1, "z")], "path string, line bigint, text string")
    assert _values(sinks.hit_text(hits)) == ["a/log.txt:3:x: y"]
    sinks.json_lines(hits.where("line = 3").withColumn("more", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert _values(spark.read.text(str(tmp_path / "out"))) == ['{"path":"a/log.txt","line":3,"text":"x: y","more":null}']
    fine, odd = paths.split_by_line_feed(hits)
    assert [r.path for r in fine.collect()] == ["a/log.txt"] and [r.path for r in odd.collect()] == ["odd\nname"]


def test_orders(spark):
    at = lambda d: datetime(2026, 1, d)
    rows = [(at(2), 1, 1, 5, "e"), (at(1), 2, 2, 7, "d"), (at(1), 2, 1, 9, "c"), (at(1), 2, None, None, "b"), (None, 3, 1, 1, "a"), (at(1), 2, 2, 6, "cc")]
    found = spark.createDataFrame(rows, "unit_time timestamp, run_id bigint, attempt int, id bigint, path string")
    assert [r.path for r in paths.oldest_first(found).collect()] == ["a", "b", "c", "cc", "d", "e"]
    listed = spark.createDataFrame([(at(2), 1), (at(1), 9), (at(1), 3)], "created_at timestamp, run_id bigint")
    assert [r.run_id for r in ingest.oldest_first(listed).collect()] == [3, 9, 1]
    made = spark.createDataFrame([(at(1), "r", 1, 5), (at(3), "r", 2, 6)], "created_at timestamp, repo string, run_id bigint, artifact_id bigint")
    tries = spark.createDataFrame([(at(3), "r", 2, 1), (at(1), "r", 1, 2)], "created_at timestamp, repo string, run_id bigint, attempt int")
    assert [(r.phase, r.run_id, r.unit) for r in ingest.work_order(tries, made).orderBy("phase", "priority").collect()] == [(0, 2, 6), (0, 1, 5), (1, 1, 2), (1, 2, 1)]


def test_files_that_no_line_came_from(spark):
    wanted = spark.createDataFrame([("read",), ("gone",), ("binary",), ("empty",), ("read",)], "path string")
    lines = spark.createDataFrame([("read", 1, "x")], "path string, line bigint, text string")
    files = spark.createDataFrame([("read", 5), ("binary", 7), ("empty", 0)], "path string, length bigint")
    assert sorted((r.path, r.reason) for r in search.unreadable(wanted, lines, files).collect()) == [("binary", "binary"), ("gone", "missing")]


def test_enriched_hits(spark):
    base = "h.example/o/r/runs/2026-10-03/12_wf_main"
    key = ("h.example", "o/r", 12)
    tables = Tables(
        spark.createDataFrame([(*key, "wf", "main", "abc", "push", [4], 1, datetime(2026, 10, 3))], f"{KEY}, workflow_name string, head_branch string, head_sha string, event string, pr_numbers array<int>, latest_attempt int, created_at timestamp"),
        spark.createDataFrame([(*key, 1, "failure", "url1")], f"{KEY}, attempt int, conclusion string, html_url string"),
        spark.createDataFrame([(*key, 1, 7, "unit", "failure", "ran", True, "p", "url7")], f"{KEY}, attempt int, job_id bigint, name string, conclusion string, kind string, has_log boolean, path string, html_url string"),
        artifacts=spark.createDataFrame([(*key, 9, "out", 1)], f"{KEY}, artifact_id bigint, name string, attributed_attempt int"),
    )
    hits = spark.createDataFrame([(f"{base}/attempt-1/jobs/7_unit/log.txt", 2, "bad"), (f"{base}/artifacts/9_out/extracted/a/b", 1, "x"), ("elsewhere", 1, "y")], "path string, line bigint, text string")
    got = {r.text: r for r in search.enriched_hits(hits, tables).collect()}
    assert (got["bad"].job, got["bad"].conclusion, got["bad"].html_url, got["bad"].line, got["bad"].head_sha) == ("unit", "failure", "url7", 2, "abc")
    assert (got["x"].artifact, got["x"].inner_path, got["x"].html_url) == ("out", "a/b", "url1")
    assert got["y"].path_reason == "not in a run dir" and got["y"].run_id is None


def test_artifacts_without_a_time(spark):
    rows = [("good", 1, [(1, "t")]), ("untimed", 2, [(1, "t"), (2, None)]), ("zero", 1, [(0, "t")]), ("nothing", 0, [])]
    pages = spark.createDataFrame(rows, "listing string, total_count int, items array<struct<id bigint, created_at string>>")
    good, bad = ingest.check_pages(pages, "items", needed=("created_at",))
    assert [(r.listing, r.id) for r in good.collect()] == [("good", 1)]
    assert {r.listing: r.reason for r in bad.collect()} == {"untimed": "missing created_at", "zero": "missing id"}


def test_pruned_state(spark):
    at = lambda d: datetime(2026, 1, d)
    state = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("a", at(9), 3), ("b", at(5), 4), ("b", None, 5)], "repo string, created_at timestamp, run_id bigint")
    horizons = spark.createDataFrame([("a", at(5))], "repo string, horizon timestamp")
    assert sorted(r.run_id for r in ingest.pruned(state, F.to_date(F.lit("2026-01-02")), horizons).collect()) == [3, 4, 5]
