"""Queries on tables whose keys and groups are those of large inputs."""

import re
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens import queries, state_queries  # noqa: F401
from runlens.operators import flakes
from runlens.operators.texts import first_lines
from runlens.plans import ci_view
from runlens.plans.filters import Filter, matching_jobs
from runlens.schema import ATTEMPT

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with order keys of a table sixty times sf0.1 and beyond."""
    folder = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT * REPLACE ({key} + 9000000 AS {key}) FROM '{SF}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["J15_U3_retry_set", "T7_rebuilt_pending"])
def test_keys_beyond_32_bits(spark, far, name):
    con, folder = far
    df = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


@pytest.mark.parametrize("view", ["ci_runs", "ci_jobs", "ci_attempts"])
def test_tasks_follow_the_bytes_of_files(spark, monkeypatch, view):
    monkeypatch.setattr(ci_view, "TASK_BYTES", 4000)
    assert ci_view.ci_view(spark, SF, view).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_flips_read_steps_once(spark, tmp_path):
    tables = ci_view.ci_tables(spark, SF)
    tables.steps.write.parquet(str(tmp_path / "steps"))
    plan = flakes.rerun_flips(replace(tables, steps=spark.read.parquet(str(tmp_path / "steps"))))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation .*\bnumber#", plan)) == 1


def test_many_globs_meet_names_once(spark):
    rows = [(1, "job0"), (2, "job0"), (3, "xob2"), (4, "job1"), (5, None)]
    found = matching_jobs(spark.createDataFrame(rows, "id int, name string"), Filter(jobs=tuple(f"other-{i}*" for i in range(50)) + ("job0", "?ob2")))
    assert found.columns == ["id", "name"] and sorted(r.id for r in found.collect()) == [1, 2, 3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate")


def test_words_travel_without_their_lines(spark):
    lines = spark.createDataFrame([("a", 1, "one two three four"), ("a", 2, "xone two threex"), ("a", 3, "zero one two three"), ("b", 1, "two")], "path string, line int, text string")
    asked = spark.createDataFrame([("a", "one two three"), ("a", "four"), ("a", "three two one"), ("b", "two"), ("b", None)], "path string, text string")
    found = first_lines(asked, lines)
    assert sorted(map(tuple, found.collect())) == [("a", "four", 1), ("a", "one two three", 1), ("b", "two", 1)]
    plan = found._jdf.queryExecution().analyzed().toString().splitlines()
    exploded = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert "found#" not in plan[exploded - 1]


def test_joins_by_attempt_move_nothing_again(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables, others = ci_view.ci_tables(spark, SF), ci_view.ci_tables(spark, SF)
        both = tables.jobs.join(others.jobs.select(*ATTEMPT, "job_id", F.col("name").alias("other")), [*ATTEMPT, "job_id"])
        assert "ENSURE_REQUIREMENTS" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_series_read_attempts_a_few_times(spark, tmp_path):
    tables = ci_view.ci_tables(spark, SF)
    tables.attempts.write.parquet(str(tmp_path / "attempts"))
    tables = replace(tables, attempts=spark.read.parquet(str(tmp_path / "attempts")))
    for f, most in ((Filter(branches=("main",)), 4), (Filter(since=queries.SINCE), 5)):
        plan = flakes.intermittent_failures(tables, f)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation .*\brun_started_at#", plan)) <= most


def test_attribution_reads_jobs_a_few_times(spark):
    plan = queries.QUERIES["J10_J11_attribution"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation .*\bl_orderkey#", plan)) <= 7
