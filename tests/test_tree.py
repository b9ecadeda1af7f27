"""A small tree of units, read in one go and as a stream."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from runlens.operators import search
from runlens.schema import RUN
from runlens.sources import units
from runlens.sources.store import Store
from runlens.streaming import ingest_stream

RUN_DIR = "h.example/o/r/runs/2026-01-02/7_wf_main"


def _write(root, path, content):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    repo = {"id": 1, "full_name": "o/r"}
    for n, start in ((1, "2026-01-02T00:00:00Z"), (2, "2026-01-02T05:00:00Z")):
        own = f"{RUN_DIR}/attempt-{n}"
        facts = {"id": 7, "name": "wf", "head_branch": "main", "head_sha": "abc", "created_at": "2026-01-02T00:00:00Z", "run_started_at": start, "updated_at": start, "status": "completed"}
        _write(root, f"{own}/attempt.json", facts | {"conclusion": "failure" if n == 1 else "success", "run_attempt": n, "workflow_id": 3, "event": "push", "repository": repo, "head_repository": repo, "pull_requests": [{"number": 4}], "extra": 1})
        job = {"id": 10 * n, "name": "job one", "status": "completed", "conclusion": "failure" if n == 1 else "success", "started_at": start, "runner_name": "x", "labels": [], "steps": [{"number": 1, "name": "s", "conclusion": "failure" if n == 1 else "success"}]}
        old = {"id": 11 * n, "name": "kept", "status": "completed", "conclusion": "success", "started_at": "2026-01-02T00:00:00Z", "runner_name": "x", "steps": []}
        _write(root, f"{own}/jobs.json", [job, old])
        _write(root, f"{own}/artifacts.json", [{"id": 90}] if n == 2 else [])
        _write(root, f"{own}/fetch.json", {"run_id": 7, "run_created_at": "2026-01-02T00:00:00Z", "run_attempt_at_fetch": n, "attempt": n, "commit_pr_numbers": [2]})
        _write(root, f"{own}/jobs/{10 * n}_job-one/log.txt", "﻿2026-01-02T00:00:00.1234567Z ##[error]bad\nsecond\n")
    _write(root, f"{RUN_DIR}/artifacts/90_out/artifact.json", {"id": 90, "name": "out", "size_in_bytes": 5, "expired": False, "created_at": "2026-01-02T05:01:00Z", "workflow_run": {"repository_id": 1, "head_repository_id": 1}})
    _write(root, f"{RUN_DIR}/artifacts/90_out/fetch.json", {"run_id": 7, "fetched_at": "2026-01-02T06:00:00Z", "pr_numbers": [9], "workflow_name": "wf"})
    _write(root, f"{RUN_DIR}/artifacts/90_out/artifact.zip.tombstone", {"tombstoned_at": "2026-01-03T00:00:00Z", "target": "artifact.zip", "reason": "expired", "http_status": 410})
    _write(root, "h.example/o/r/runs/2026-01-03/8_wf_main/attempt-1/attempt.json", "{broken")
    return root


def test_tables(spark, root):
    t, rejected = units.build_tables(spark, str(root))
    run = t.runs.collect()
    assert [(r.run_id, r.latest_attempt, r.workflow_name, r.from_fork, r.pr_numbers) for r in run] == [(7, 2, "wf", False, [2, 4, 9])]
    assert {(r.job_id, r.attempt, r.kind, r.original_job_id, r.has_log) for r in t.jobs.collect()} == {(10, 1, "ran", None, True), (20, 2, "ran", None, True), (11, 1, "ran", None, False), (22, 2, "carried_forward", 11, False)}
    assert t.steps.count() == 2
    assert [(r.artifact_id, r.attributed_attempt, r.attribution) for r in t.artifacts.collect()] == [(90, 2, "listing-diff")]
    assert [(r.reason, r.http_status) for r in t.tombstones.collect()] == [("expired", 410)]
    assert [r.path.split("/")[-2] for r in rejected.collect()] == ["attempt-1"]


def test_logs(spark, root):
    lines = units.log_lines(spark, str(root))
    assert sorted((r.attempt, r.line, r.text[-3:]) for r in lines.collect()) == [(1, 1, "bad"), (1, 2, "ond"), (2, 1, "bad"), (2, 2, "ond")]
    top = search.top_lines(search.grep(lines, "##[error]", fixed=True)).collect()
    assert [(r.text, r.n) for r in top] == [("##[error]bad", 2)]


def test_units_and_store(spark, root, tmp_path):
    found = units.units(units.listing(spark, str(root)))
    assert found.count() == 4
    runs = spark.createDataFrame([("h", "o/r", 7, "2026-01-02", "push")], "host string, repo string, run_id bigint, date_dir string, event string").withColumn("date_dir", F.col("date_dir").cast("date"))
    kept = Store(spark, str(tmp_path / "store"))
    keys = runs.select(*RUN, "date_dir")
    base = kept.commit({"runs": runs})
    other = runs.withColumn("run_id", F.lit(9).cast("bigint"))
    base = kept.commit({"runs": other}, other.select(*RUN, "date_dir"), base)
    base = kept.commit({"runs": runs.withColumn("event", F.lit("again"))}, keys, base)
    assert sorted((r.run_id, r.event) for r in kept.read("runs", base).collect()) == [(7, "again"), (9, "push")]


def test_stream_takes_each_run_once(spark, root, tmp_path):
    seen = []
    stream = ingest_stream.unit_stream(spark, str(root))
    for _ in range(2):
        ingest_stream.keep_current(stream, lambda runs: seen.append(sorted(r.run_id for r in runs.collect())), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert [x for x in seen if x] == [[7, 8]]


def _copy_run(data, day, run_id, **facts):
    """A run of one attempt like run 7's first, on another day."""
    own = data / f"h.example/o/r/runs/{day}/{run_id}_wf_main/attempt-1"
    shutil.copytree(data / RUN_DIR / "attempt-1", own)
    told = json.loads((own / "attempt.json").read_text()) | {"id": run_id, "created_at": f"{day}T00:00:00Z", "run_attempt": 1} | facts
    (own / "attempt.json").write_text(json.dumps(told))
    (own / "fetch.json").write_text(json.dumps({"run_id": run_id, "run_created_at": told["created_at"], "run_attempt_at_fetch": 1, "attempt": 1}))
    return own


def _rows(df):
    columns = sorted(c for c in df.columns if c != "date_dir")
    return sorted(str(r) for r in df.select(*columns).collect())


def _as_built_anew(spark, data, store):
    """The store's tables hold what a build from all files gives."""
    kept = Store(spark, store)
    base = kept.current()
    tables, rejected = units.build_tables(spark, str(data))
    for name in ("runs", "attempts", "jobs", "steps", "artifacts", "tombstones"):
        assert _rows(kept.read(name, base)) == _rows(getattr(tables, name)), name
    assert _rows(kept.read("rejected", base)) == _rows(rejected)
    spark.catalog.clearCache()


def test_store_follows_the_files(spark, root, tmp_path):
    """Built from all files, then only what changed; a removed run and its day go."""
    data, store = tmp_path / "data", str(tmp_path / "store")
    shutil.copytree(root, data)
    _copy_run(data, "2026-01-05", 9)
    told = lambda: sorted((r.run_id, r.change) for r in ingest_stream.refresh(spark, str(data), store).collect())
    runs = lambda: sorted((r.run_id, r.event, str(r.date_dir)) for r in Store(spark, store).read("runs", Store(spark, store).current()).collect())
    assert (7, "changed") in told() and runs() == [(7, "push", "2026-01-02"), (9, "push", "2026-01-05")]
    # A broken unit is tried again each time; nothing else is.
    assert told() == [(8, "changed")]
    shutil.rmtree(data / "h.example/o/r/runs/2026-01-05")
    file = data / RUN_DIR / "attempt-2/attempt.json"
    file.write_text(json.dumps(json.loads(file.read_text()) | {"event": "schedule"}))
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert [x for x in told() if x[0] in (7, 9)] == [(7, "changed"), (9, "removed")]
    assert runs() == [(7, "schedule", "2026-01-02")]
    assert "2026-01-05" not in Store(spark, store).current().days["jobs"]
    _as_built_anew(spark, data, store)


def test_only_changed_runs_are_read(spark, root, tmp_path):
    """The other runs' documents are spoiled, with their times kept: whoever reads them finds them broken."""
    data, store = tmp_path / "data", str(tmp_path / "store")
    shutil.copytree(root, data)
    shutil.rmtree(data / "h.example/o/r/runs/2026-01-03")
    quiet, same_day = _copy_run(data, "2026-01-05", 9), _copy_run(data, "2026-01-02", 6)
    ingest_stream.refresh(spark, str(data), store)
    before = Store(spark, store).current()
    for own in (quiet, same_day):
        for file in own.glob("*.json"):
            at = os.stat(file)
            file.write_text("{" * at.st_size)
            os.utime(file, ns=(at.st_atime_ns, at.st_mtime_ns))
    file = data / RUN_DIR / "attempt-2/attempt.json"
    file.write_text(json.dumps(json.loads(file.read_text()) | {"event": "schedule"}))
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert [(r.run_id, r.change) for r in ingest_stream.refresh(spark, str(data), store).collect()] == [(7, "changed")]
    kept = Store(spark, store)
    after = kept.current()
    assert sorted((r.run_id, r.event) for r in kept.read("runs", after).collect()) == [(6, "push"), (7, "schedule"), (9, "push")]
    assert kept.read("rejected", after).count() == 0
    # The day on which nothing changed is the file that it was.
    assert {t: v["2026-01-05"] for t, v in after.days.items() if "2026-01-05" in v} == {t: v["2026-01-05"] for t, v in before.days.items() if "2026-01-05" in v}
    assert ingest_stream.refresh(spark, str(data), store).count() == 0 and kept.current().version == after.version


def test_a_fault_between_tables_leaves_the_old_state(spark, tmp_path, monkeypatch):
    row = lambda i, day, event: ("h", "o/r", i, day, event)
    df = lambda rows: spark.createDataFrame(rows, "host string, repo string, run_id bigint, date_dir string, event string").withColumn("date_dir", F.col("date_dir").cast("date"))
    kept = Store(spark, str(tmp_path / "store"))
    rows = df([row(1, None, "a"), row(2, None, "b"), row(3, "2026-01-02", "c"), row(4, "2026-01-03", "d")])
    base = kept.commit({"runs": rows, "jobs": rows})
    told = lambda table: sorted((r.run_id, str(r.date_dir), r.event) for r in kept.read(table, kept.current()).collect())
    whole = told("runs")
    assert whole == [(1, "None", "a"), (2, "None", "b"), (3, "2026-01-02", "c"), (4, "2026-01-03", "d")]
    new = df([row(1, None, "again"), row(3, "2026-01-04", "moved")])
    touched = df([row(1, None, ""), row(3, "2026-01-02", ""), row(3, "2026-01-04", "")]).drop("event")
    with pytest.raises(Exception, match="stopped"):  # the second table fails in its tasks, after the first is written
        kept.commit({"runs": new, "jobs": new.withColumn("event", F.raise_error(F.lit("stopped")))}, touched, base)
    assert told("runs") == told("jobs") == whole and kept.current().version == 1
    base = kept.commit({"runs": new, "jobs": new}, touched, base)
    assert told("runs") == told("jobs") == [(1, "None", "again"), (2, "None", "b"), (3, "2026-01-04", "moved"), (4, "2026-01-03", "d")]
    with pytest.raises(ValueError, match="no longer current"):
        kept.commit({"runs": new}, touched, kept._snapshot(1))
    # A run that goes takes its day with it; old versions can be swept away.
    base = kept.commit({"runs": new.limit(0), "jobs": new.limit(0)}, df([row(4, "2026-01-03", "")]).drop("event"), base)
    assert "2026-01-03" not in base.days["runs"] and [x[0] for x in told("runs")] == [1, 2, 3]
    assert any("version=1/date_dir=2026-01-02" in x for x in kept.vacuum(keep=1))
    assert [x[0] for x in told("jobs")] == [1, 2, 3] and kept.vacuum(keep=1) == []
    monkeypatch.setattr("runlens.sources.store.FORMAT_VERSION", 99)
    assert kept.current() is None


def test_a_late_rerun_through_the_stream(spark, root, tmp_path):
    """A second attempt, published days after the first was taken in, lands at its run's date with all the run's rows."""
    data, store = tmp_path / "data", str(tmp_path / "store")
    shutil.copytree(root, data)
    shutil.rmtree(data / RUN_DIR / "attempt-2")
    shutil.rmtree(data / RUN_DIR / "artifacts")
    shutil.rmtree(data / "h.example/o/r/runs/2026-01-03")
    _copy_run(data, "2026-01-05", 9)
    stream = ingest_stream.unit_stream(spark, str(data))
    take = lambda: ingest_stream.keep_current(stream, ingest_stream.follow(spark, str(data), store), str(tmp_path / "checkpoint")).awaitTermination(180)
    kept = Store(spark, store)
    runs = lambda: sorted((r.run_id, r.latest_attempt, str(r.date_dir)) for r in kept.read("runs", kept.current()).collect())
    take()
    assert runs() == [(7, 1, "2026-01-02"), (9, 1, "2026-01-05")]
    shutil.copytree(root / RUN_DIR / "attempt-2", data / RUN_DIR / "attempt-2")
    take()
    assert runs() == [(7, 2, "2026-01-02"), (9, 1, "2026-01-05")]
    _as_built_anew(spark, data, store)
    assert kept.current().version == 2


def test_watched_runs(spark):
    state = lambda rows: spark.createDataFrame(rows, "run_id bigint, status string")
    left = ingest_stream.watch(state([(1, "queued"), (2, "queued")]), state([(2, "completed"), (3, "in_progress"), (4, "completed")]), ["run_id"])
    assert sorted((r.run_id, r.status) for r in left.collect()) == [(1, "queued"), (3, "in_progress")]


def test_listings_that_overlap(spark, tmp_path):
    rows = [("2026-01-01 00:00:00", 1), ("2026-01-01 00:30:00", 2), ("2026-01-01 00:30:00", 2), ("2026-01-01 00:00:00", 1)]
    spark.createDataFrame(rows, "at string, run_id bigint").selectExpr("cast(at as timestamp) created_at", "run_id").write.parquet(str(tmp_path / "in"))
    stream = ingest_stream.without_repeats(spark.readStream.schema("created_at timestamp, run_id bigint").parquet(str(tmp_path / "in")), ["run_id"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
