"""Run history seen in the sales tables: the same text in Spark's and DuckDB's dialect, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Tables
from ..sources.sinks import bytes_below, exists

#: Bytes of Parquet files of jobs and of runs that one task takes.
TASK_BYTES = 1 << 20
#: Spark's setting by which a join that has more keys than its sides are dealt by moves both sides again.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

_VIEWS = {
    "ci_runs": """
SELECT 'ci.example' AS host, concat('acme/app', o_custkey % 3) AS repo, o_orderkey AS run_id, o_custkey % 12 AS workflow_id,
  CASE WHEN o_custkey % 4 = 0 AND o_orderdate < TIMESTAMP{ntz} '1998-01-01 00:00:00' THEN concat('old-wf', o_custkey % 12) ELSE concat('wf', o_custkey % 12) END AS workflow_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'release-3' WHEN 1 THEN 'feat/retry-upload' ELSE 'main' END AS head_branch,
  md5(concat('', o_orderkey)) AS head_sha, o_orderkey % 11 = 0 AS from_fork,
  CASE WHEN o_orderstatus = 'P' THEN 'pull_request' WHEN o_orderpriority = '5-LOW' THEN 'schedule' ELSE 'push' END AS event,
  o_orderdate + {sec}(o_orderkey % 86400{end} AS created_at, CAST(o_orderdate AS DATE) AS date_dir,
  concat('ci.example/acme/app', o_custkey % 3, '/runs/', CAST(o_orderdate AS DATE), '/', o_orderkey, '_wf_main') AS path,
  CASE WHEN o_orderstatus = 'P' THEN o_custkey % 40 END AS pr, floor(o_totalprice) AS price, o_custkey AS custkey
FROM orders""",
    "ci_jobs": """
SELECT r.host, r.repo, l.run_id, l.job_id, l.attempt, l.name, l.fail_at, l.conclusion, l.kind, l.runner_name,
  r.created_at + {sec}(l.minute * 60{end} AS started_at, concat(r.path, '/attempt-', l.attempt, '/jobs/', l.job_id, '_job') AS path
FROM (SELECT l_orderkey AS run_id,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS job_id,
  1 + l_linenumber % 3 AS attempt, concat('job', l_partkey % 3) AS name, l_suppkey % 3 AS fail_at, l_partkey % 2 AS minute, concat('runner', l_suppkey % 2) AS runner_name,
  CASE WHEN l_returnflag = 'R' THEN 'failure' WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN 'success' ELSE 'skipped' END AS conclusion,
  CASE WHEN l_linenumber % 3 > 0 AND l_suppkey % 7 = 0 THEN 'carried_forward' WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_partkey % 2 = 0 THEN 'not_applicable' ELSE 'ran' END AS kind
  FROM lineitem) l JOIN ci_runs r ON r.run_id = l.run_id""",
    "ci_steps": """
SELECT host, repo, run_id, attempt, job_id, n + 1 AS number, concat('step', n) AS name,
  CASE WHEN conclusion = 'failure' AND n = fail_at THEN 'failure' WHEN conclusion = 'failure' AND n > fail_at THEN 'skipped' ELSE 'success' END AS conclusion
FROM ci_jobs JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) s ON conclusion <> 'skipped'""",
    "ci_attempts": """
SELECT j.host, j.repo, j.run_id, j.attempt, r.created_at + {sec}((j.attempt - 1) * 3600{end} AS run_started_at, concat(r.path, '/attempt-', j.attempt) AS path,
  CASE WHEN j.run_id % 13 = 0 AND j.attempt = j.latest THEN 'cancelled' WHEN j.failed > 0 THEN 'failure' ELSE 'success' END AS conclusion, j.latest
FROM (SELECT host, repo, run_id, attempt, max(max(attempt)) OVER (PARTITION BY run_id) AS latest, sum(CASE WHEN conclusion = 'failure' THEN 1 ELSE 0 END) AS failed
  FROM ci_jobs GROUP BY host, repo, run_id, attempt) j JOIN ci_runs r ON r.run_id = j.run_id""",
    "ci_artifacts": """
SELECT j.host, j.repo, j.run_id, j.job_id AS artifact_id, concat('out-', j.name) AS name, j.fail_at * 1000 AS size, a.run_started_at + {sec}(60{end} AS created_at,
  j.attempt AS made_in, concat(r.path, '/artifacts/', j.job_id, '_out') AS path
FROM ci_jobs j JOIN ci_attempts a ON a.run_id = j.run_id AND a.attempt = j.attempt JOIN ci_runs r ON r.run_id = j.run_id""",
}


def _text(view: str, duckdb: bool) -> str:
    kind = {"ntz": "", "sec": "to_seconds", "end": ")"} if duckdb else {"ntz": "_NTZ", "sec": "make_dt_interval", "end": ")"}
    text = _VIEWS[view]
    if not duckdb:  # make_dt_interval takes days, hours and minutes first
        text = text.replace("{sec}(", "make_dt_interval(0, 0, 0, ")
    for k, v in kind.items():
        text = text.replace("{" + k + "}", v)
    return text


def with_views(sql: str) -> str:
    """DuckDB SQL over the views."""
    return "WITH " + ",\n".join(f"{name} AS ({_text(name, True)})" for name in _VIEWS) + "\n" + sql


def ci_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; read where write_views has written it beside the tables.

    Both tables are dealt by the run's key to as many tasks as their files ask for, since shuffled bytes, by which Spark would size them, are compressed
    far more than rows in memory. All views keep that, so joins by run, or by run and more (attempt, job), move nothing again: for the latter, the session is told
    that a part of a join's keys may deal its rows.
    """
    spark.conf.set(CO_PARTITION, "false")
    files = {t: f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem")}
    parts = max(spark.sparkContext.defaultParallelism, -(-max(bytes_below(spark, f) for f in files.values()) // TASK_BYTES))
    frames: dict[str, DataFrame] = {t: spark.read.parquet(f).repartition(parts, f"{t[0]}_orderkey") for t, f in files.items()}

    def build(view: str) -> DataFrame:
        if view not in frames and exists(spark, f"{sf_dir}/{view}.parquet"):
            frames[view] = spark.read.parquet(f"{sf_dir}/{view}.parquet")
        if view not in frames:
            text = _text(view, False)
            for other in [*_VIEWS, "orders", "lineitem"]:
                if f" {other}" in text and other != view:
                    build(other)
                    text = text.replace(f"FROM {other}", f"FROM {{{other}}}").replace(f"JOIN {other} ", f"JOIN {{{other}}} ")
            used = {k: v for k, v in frames.items() if f"{{{k}}}" in text}
            frames[view] = spark.sql(text, **used)
        return frames[view]

    return build(name)


def write_views(spark: SparkSession, sf_dir: str, to: str) -> None:
    """Writes all views below a folder, as an index that is built once and asked often."""
    for name in _VIEWS:
        ci_view(spark, sf_dir, name).write.parquet(f"{to}/{name}.parquet")


def ci_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The views as the tables that operators take."""
    views = {name: ci_view(spark, sf_dir, name) for name in _VIEWS}
    latest = views["ci_jobs"].groupBy("run_id").agg(F.max("attempt").alias("latest_attempt"))
    numbers = F.when(F.col("pr").isNotNull(), F.array(F.col("pr").cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = views["ci_runs"].join(latest, "run_id", "left").withColumns({"pr_numbers": numbers, "display_title": F.concat(F.lit("run "), "run_id")})
    jobs = views["ci_jobs"].withColumn("has_log", F.col("kind") == "ran")
    return Tables(runs.drop("pr", "price", "custkey"), views["ci_attempts"].drop("latest"), jobs, views["ci_steps"], views["ci_artifacts"].withColumn("attributed_attempt", F.col("made_in")))
