"""Writers of tables, findings and path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted, short_sha
from ..operators.paths import split_by_line_feed


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """Hadoop's path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path is there, in any store that Spark reads."""
    own, store = _file_system(spark, path)
    return store.exists(own)


def bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    own, store = _file_system(spark, path)
    return store.getContentSummary(own).getLength()


def json_lines(findings: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON document a row with all fields, null ones too; written if a path is given."""
    told = findings.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if path is not None:
        told.write.text(path)
    return told


#: Order of a report: jobs before their steps, steps as they first ran.
FLIP_ORDER, SERIES_ORDER = ["run_id", "job", "first_seen"], ["head_branch", "workflow_id", "job", "first_seen"]


def in_order(found: DataFrame) -> DataFrame:
    """Flips or failures alone in the order of a report; hosts and repositories follow each other."""
    return found.orderBy("host", "repo", *(SERIES_ORDER if "head_branch" in found.columns else FLIP_ORDER))


def _job_and_step() -> Column:
    return F.concat_ws(" / ", quoted(F.col("job")), F.when(F.col("step") != "", quoted(F.col("step"))))


def _run_and_sha(run_id: Column, sha: Column) -> Column:
    return F.concat(F.lit("run "), run_id.cast("string"), F.lit(" (sha "), F.coalesce(short_sha(sha), F.lit("")), F.lit(")"))


def flip_text(flips: DataFrame) -> DataFrame:
    """One line a flip, in order: run, commit, job and step, outcomes, failing steps. Null names are empty."""
    told = F.array_join(F.transform("outcomes", lambda x: F.concat(x["attempt"].cast("string"), F.lit(":"), x["conclusion"])), " ")
    steps = F.when(F.size("failing_steps") > 0, F.concat(F.lit("; failing steps: "), F.array_join(F.transform("failing_steps", quoted), ", "))).otherwise("")
    line = F.concat(_run_and_sha(F.col("run_id"), F.col("head_sha")), F.lit(": "), _job_and_step(), F.lit(": "), told, steps)
    return in_order(flips).select(line.alias("value"))


def flip_json(flips: DataFrame) -> DataFrame:
    """One document a flip, in order; a job's own flip has a null step."""
    # The names of the fields.
    fields = in_order(flips).select(
        F.lit("rerun").alias("kind"), "run_id", "head_sha", "job", F.nullif("step", F.lit("")).alias("step"), F.col("outcomes.attempt").alias("attempts"), F.col("outcomes.conclusion").alias("conclusions"), "failing_steps", "logs"
    )
    return json_lines(fields)


def intermittent_text(found: DataFrame) -> DataFrame:
    """One line a series with failures alone between successes, in order: workflow, branch, job and step, how many of its runs, and these."""
    each = F.transform("failures", lambda x: F.concat(_run_and_sha(x["run_id"], x["head_sha"]), F.lit(" "), x["conclusion"]))
    counted = F.concat(F.size("failures").cast("string"), F.lit(" of "), F.col("runs").cast("string"), F.lit(" runs failed alone: "))
    line = F.concat(F.lit("workflow "), quoted(F.col("workflow_name")), F.lit(" on "), F.coalesce("head_branch", F.lit("")), F.lit(": "), _job_and_step(), F.lit(": "), counted, F.array_join(each, ", "))
    return in_order(found).select(line.alias("value"))


def intermittent_json(found: DataFrame) -> DataFrame:
    """One document a series, in order; logs of all its failures in one list."""
    # The names of the fields.
    failures = F.transform("failures", lambda x: F.struct(x["run_id"].alias("run_id"), x["head_sha"].alias("head_sha"), x["conclusion"].alias("conclusion")))
    logs = F.flatten(F.transform("failures", lambda x: F.coalesce(x["logs"], F.array().cast("array<string>"))))
    fields = in_order(found).select(
        F.lit("intermittent").alias("kind"), "workflow_id", F.col("workflow_name").alias("workflow"), F.col("head_branch").alias("branch"), "job", F.nullif("step", F.lit("")).alias("step"), "runs", failures.alias("failures"), logs.alias("logs")
    )
    return json_lines(fields)


def hit_text(hits: DataFrame) -> DataFrame:
    """path:line:text. Hits in paths that hold a line feed can't stand in lines and are left out; `paths.split_by_line_feed` names them."""
    return split_by_line_feed(hits)[0].select(F.concat_ws(":", F.col("path").cast("string"), F.col("line").cast("string"), F.col("text")).alias("value"))


def write_extracted(files: DataFrame, path: str) -> None:
    """Expanded members by date."""
    files.write.mode("append").partitionBy("date_dir").parquet(path)
