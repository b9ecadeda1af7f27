"""Logs read in byte ranges have the lines and numbers of a whole read."""

import random

import pytest

from runlens.operators import search
from runlens.sources import logs, units


def whole(raw: bytes) -> list[bytes]:
    if b"\0" in raw[:8192]:
        return []
    lines = raw.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


@pytest.fixture
def small_ranges(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "700b"), ("spark.sql.files.openCostInBytes", "100b"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


FILES = {
    "long": b"\xef\xbb\xbf" + b"\n".join(f"line {i} " .encode() + b"x" * (i * 37 % 90) for i in range(900)) + b"\n",
    "open": b"first\r\n\nthird \xef\xbb\xbf\rsame\n" + b"y" * 3000 + b"\nlast without an end",
    "empty": b"",
    "one": b"\n",
    "mark": b"\xef\xbb\xbf",
    "bytes": b"a\xff\xfeb\n\xc3\n" * 200,
    "null_inside": b"x" * 8190 + b"\n\0needle",
    "null_at_end": b"x" * 8191 + b"\n\0needle\n",
    "null_later": b"needle\n" + b"x" * 9000 + b"\0\n",
    "null_first": b"\0",
    "many_short": b"a\n" * 5000 + b"\0",
    "null_in_short": b"a\n" * 4000 + b"b\0\n" + b"a\n" * 500,
}


def test_as_a_whole_read(spark, small_ranges, tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).write_bytes(raw)
    read = logs.text_lines(spark, str(tmp_path))
    got = {}
    for r in read.selectExpr("file", "line", "cast(text as binary) text").collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line, bytes(r.text)))
    for name, raw in FILES.items():
        assert sorted(got.get(name, [])) == list(enumerate(whole(raw), 1)), name
    assert logs._blocks(spark, str(tmp_path), "*").select("file", "block").distinct().where("file like '%/long'").count() > 40


def test_a_search_in_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(1)
    at = "h.example/o/r/runs/2026-01-02/7_wf_main"
    want = []
    for job in (10, 11):
        own = tmp_path / at / f"attempt-1/jobs/{job}_job+one"
        own.mkdir(parents=True)
        text = [f"2026-01-02T00:00:00Z {'##[error]' if rng.random() < 0.02 else ''} step {i}" for i in range(1500)]
        (own / "log.txt").write_text("﻿" + "\n".join(text))
        want += [(job, i) for i, x in enumerate(text, 1) if "##[error]" in x]
    tree = tmp_path / at / "artifacts/90_out/extracted/deep"
    tree.mkdir(parents=True)
    (tree / "log.txt").write_text("a\n##[error] in a file\n")
    (tree.parent / "manifest.json").write_text("##[error]")
    lines = units.log_lines(spark, str(tmp_path))
    hits = search.grep(lines, r"^\S+ ##\[error\]")
    assert sorted((r.job_id, r.line) for r in hits.collect()) == want
    more = search.grep(units.extracted_lines(spark, str(tmp_path)), "##[error]", fixed=True).collect()
    assert [(r.artifact_id, r.path.rpartition("/extracted/")[2], r.line) for r in more] == [(90, "deep/log.txt", 2)]
    assert units.log_lines(spark, str(tmp_path), []).count() == 0
    assert units.log_lines(spark, str(tmp_path), [at]).count() == 3000
