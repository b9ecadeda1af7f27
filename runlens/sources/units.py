"""Readers of the file tree of units: attempts, artifacts, tombstones, logs and what lies below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import parse_location, slug
from ..operators.derive import attribute_artifacts, from_fork, job_kind, match_originals, pr_numbers, run_facts
from ..operators.paths import MANIFEST
from ..schema import ATTEMPT, RUN, Tables
from .logs import text_lines

_REPO = "struct<id bigint, full_name string>"
ATTEMPT_JSON = (
    "id bigint, name string, path string, head_branch string, head_sha string, created_at timestamp, run_started_at timestamp, updated_at timestamp, status string, conclusion string, "
    f"run_attempt int, workflow_id bigint, event string, display_title string, html_url string, pull_requests array<struct<number int>>, repository {_REPO}, head_repository {_REPO}, _corrupt_record string"
)
JOB_JSON = (
    "id bigint, name string, status string, conclusion string, started_at timestamp, completed_at timestamp, runner_name string, labels array<string>, html_url string, "
    "steps array<struct<number int, name string, conclusion string, started_at timestamp, completed_at timestamp>>, _corrupt_record string"
)
ARTIFACT_JSON = (
    "id bigint, name string, size_in_bytes bigint, expired boolean, created_at timestamp, expires_at timestamp, digest string, "
    "workflow_run struct<repository_id bigint, head_repository_id bigint, head_branch string, head_sha string>, _corrupt_record string"
)
FETCH_JSON = (
    "host string, repo string, run_id bigint, run_created_at timestamp, run_attempt_at_fetch int, run_status_at_fetch string, fetched_at timestamp, attempt int, commit_pr_numbers array<int>, carried_forward_jobs array<bigint>, "
    "sources map<string, struct<url string, status int, pages int, bytes bigint, sha256 string>>, workflow_id bigint, workflow_name string, event string, pr_numbers array<int>, display_title string, _corrupt_record string"
)
TOMBSTONE_JSON = "tombstoned_at timestamp, target string, url string, http_status int, reason string, message string, _corrupt_record string"


def _relative(root: str, file: Column | None = None) -> Column:
    """Path below the root, as the tree names it, of a file as its reader names it."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path") if file is None else file, r"\+", "%2B")), r"^.*?\Q" + base + r"\E/", "")


def _places(root: str, run_dirs: list[str] | None) -> str | list[str]:
    """What readers load: the whole tree, or the folders of some runs."""
    return root if run_dirs is None else [f"{root.rstrip('/')}/{d}" for d in run_dirs]


def _json(spark: SparkSession, root: str, name: str, schema: str, run_dirs: list[str] | None = None) -> DataFrame:
    """Documents of a name, or a pattern of names, with the parts of their path; a broken one has only _corrupt_record."""
    if run_dirs == []:
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("_path")).withColumn("_at", parse_location(F.col("_path"))).where("_at.reason is null")
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(_places(root, run_dirs))
    return read.select("*", _relative(root).alias("_path")).withColumn("_at", parse_location(F.col("_path"))).where("_at.reason is null")


def _of_attempts(spark: SparkSession, root: str, name: str, schema: str, run_dirs: list[str] | None = None) -> DataFrame:
    return _json(spark, root, name, schema, run_dirs).where((F.col("_at.file") == name) & F.col("_at.attempt").isNotNull() & F.col("_at.job_id").isNull())


def _of_artifacts(spark: SparkSession, root: str, name: str, schema: str, run_dirs: list[str] | None = None) -> DataFrame:
    return _json(spark, root, name, schema, run_dirs).where((F.col("_at.file") == name) & F.col("_at.artifact_id").isNotNull())


def listing(spark: SparkSession, root: str, glob: str = "*", run_dirs: list[str] | None = None) -> DataFrame:
    """(run, run_dir, attempt, job_id, artifact_id, file, path, length, modified) of all files below the runs, or below some of them; reads no content."""
    if run_dirs == []:
        return listing(spark, root, glob).limit(0)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(_places(root, run_dirs))
    placed = files.select(_relative(root).alias("path"), "length", F.col("modificationTime").alias("modified")).withColumn("_at", parse_location(F.col("path")))
    at = F.col("_at")
    return placed.where("_at.reason is null").select(*[at[c].alias(c) for c in (*RUN, "run_dir", "attempt", "job_id", "artifact_id", "file")], "path", "length", "modified")


def units(files: DataFrame) -> DataFrame:
    """(run, path, modified): each attempt, artifact and extracted tree with its newest change."""
    extracted = F.contains("path", F.lit("/extracted/")) & F.col("artifact_id").isNotNull()
    unit = F.when(extracted, F.concat_ws("/", "run_dir", F.lit("artifacts"), F.col("artifact_id"), F.lit("extracted"))).when(F.col("artifact_id").isNotNull(), F.concat_ws("/", "run_dir", F.lit("artifacts"), F.col("artifact_id"))).when(
        F.col("attempt").isNotNull(), F.concat(F.col("run_dir"), F.lit("/attempt-"), F.col("attempt"))
    )
    return files.withColumn("unit", unit).where("unit is not null").groupBy(*RUN, F.col("unit").alias("path")).agg(F.max("modified").alias("modified"))


def tombstones(spark: SparkSession, root: str, run_dirs: list[str] | None = None) -> DataFrame:
    """(run, path, target, reason, http_status, tombstoned_at) of lost files; path is the file that will not come."""
    read = _json(spark, root, "*.tombstone", TOMBSTONE_JSON, run_dirs)
    return read.select(*[F.col(f"_at.{c}").alias(c) for c in RUN], F.regexp_replace("_path", r"\.tombstone$", "").alias("path"), "target", "reason", "http_status", "tombstoned_at")


def _placed_lines(spark: SparkSession, root: str, glob: str, wanted: str, keys: list[str], run_dirs: list[str] | None) -> DataFrame:
    """Lines of the files that `wanted` takes by the parts of their path. Paths are taken apart once a file, not once a line."""
    if run_dirs == []:
        return _placed_lines(spark, root, glob, wanted, keys, None).limit(0)
    read = text_lines(spark, _places(root, run_dirs), glob)
    paths = listing(spark, root, glob, run_dirs).where(wanted).select(*keys, "path")
    relative = _relative(root, F.col("file")).alias("path")
    return read.select(relative, F.col("line").cast("int").alias("line"), "text").join(paths, "path").select(*keys, "path", "line", "text")


def log_lines(spark: SparkSession, root: str, run_dirs: list[str] | None = None) -> DataFrame:
    """(run, attempt, job_id, path, line, text) of all logs, or those of some runs' folders; see text_lines."""
    return _placed_lines(spark, root, "log.txt", "job_id is not null and file = 'log.txt'", [*ATTEMPT, "job_id"], run_dirs)


def extracted_lines(spark: SparkSession, root: str, run_dirs: list[str] | None = None) -> DataFrame:
    """(run, artifact_id, path, line, text) of the files in extracted trees but their manifests."""
    return _placed_lines(spark, root, "*", f"artifact_id is not null and file like 'extracted/%' and file <> 'extracted/{MANIFEST}'", [*RUN, "artifact_id"], run_dirs)


def build_tables(spark: SparkSession, root: str, run_dirs: list[str] | None = None, held: list[DataFrame] | None = None) -> tuple[Tables, DataFrame]:
    """All tables from the files alone, and rejects (run, path, reason): documents that don't parse, whose units are left out.

    run_dirs: folders of runs below the root; no other file is read then. Parsed documents are persisted, as several tables read them; they
    are added to `held`, for the caller to unpersist once the tables are written.
    """

    def keep(df: DataFrame) -> DataFrame:
        if held is not None:
            held.append(df)
        return df.persist()

    at = lambda c: F.col(f"_at.{c}").alias(c)
    raw = keep(_of_attempts(spark, root, "attempt.json", ATTEMPT_JSON, run_dirs))
    jobs_raw = keep(_of_attempts(spark, root, "jobs.json", JOB_JSON, run_dirs))
    listed_raw = keep(_of_attempts(spark, root, "artifacts.json", ARTIFACT_JSON, run_dirs))
    fetch_raw = keep(_of_attempts(spark, root, "fetch.json", FETCH_JSON, run_dirs))
    artifact_raw = keep(_of_artifacts(spark, root, "artifact.json", ARTIFACT_JSON, run_dirs))
    artifact_fetch = keep(_of_artifacts(spark, root, "fetch.json", FETCH_JSON, run_dirs))
    bad = "_corrupt_record is not null"
    broken = [x.where(bad).select(*[at(c) for c in ATTEMPT], "_path") for x in (raw, jobs_raw, listed_raw, fetch_raw)]
    rejected = broken[0]
    for more in broken[1:]:
        rejected = rejected.unionByName(more)
    bad_units = rejected.select(*ATTEMPT).distinct()

    def good(df: DataFrame) -> DataFrame:
        own = df.where(f"not ({bad})").select(*[at(c) for c in ATTEMPT], *[c for c in df.columns if c not in ("_at", "_corrupt_record", "repo", "host", "run_id", "attempt")])
        return own.join(bad_units, ATTEMPT, "left_anti")

    files = keep(listing(spark, root, run_dirs=run_dirs).select("path", F.col("length").alias("bytes"), "file", *ATTEMPT, "job_id", "artifact_id"))
    attempts_raw, fetches = good(raw), good(fetch_raw)
    attempts = attempts_raw.select(
        *ATTEMPT, F.regexp_replace("_path", "/attempt.json$", "").alias("path"), "status", "conclusion", "run_started_at", F.col("updated_at").alias("completed_at"), "html_url"
    )
    jobs = good(jobs_raw).join(attempts.select(*ATTEMPT, "run_started_at", F.col("path").alias("attempt_path")), ATTEMPT)
    jobs = jobs.select(
        *ATTEMPT, F.col("id").alias("job_id"), "name", slug(F.col("name")).alias("slug"),
        job_kind(F.col("started_at"), F.col("run_started_at"), F.coalesce(F.size("steps"), F.lit(0)), F.col("runner_name")).alias("kind"),
        "conclusion", "started_at", "completed_at", "runner_name", "labels", "html_url", "steps", F.concat("attempt_path", F.lit("/jobs/"), "id", F.lit("_"), slug(F.col("name"))).alias("path"),
    )
    logs = files.where("file = 'log.txt' and job_id is not null").select(*ATTEMPT, "job_id", F.col("bytes").alias("log_bytes"))
    full = jobs.join(match_originals(jobs), [*RUN, "job_id"], "left").join(logs, [*ATTEMPT, "job_id"], "left").withColumn("has_log", F.col("log_bytes").isNotNull())
    steps = jobs.select(*ATTEMPT, "job_id", "path", F.explode("steps").alias("s")).select(*ATTEMPT, "job_id", "path", "s.*")

    artifacts = artifact_raw.where(f"not ({bad})").select(*[at(c) for c in RUN], F.col("id").alias("artifact_id"), "name", F.col("size_in_bytes").alias("size"), "created_at", "expired", "workflow_run", F.regexp_replace("_path", "/artifact.json$", "").alias("path"))
    have = files.where("artifact_id is not null").groupBy(*RUN, "artifact_id").agg(F.bool_or(F.col("file") == "artifact.zip").alias("has_zip"), F.bool_or(F.col("file").startswith("extracted/")).alias("extracted"))
    shots = good(listed_raw).groupBy(*ATTEMPT).agg(F.collect_set("id").alias("artifact_ids"))
    during = fetches.select(*ATTEMPT, (F.col("run_attempt_at_fetch") == F.col("attempt")).alias("own"))
    shots = attempts.select(*ATTEMPT).join(shots, ATTEMPT, "left").join(during, ATTEMPT, "left")
    shots = shots.select(*ATTEMPT, F.coalesce("artifact_ids", F.array().cast("array<bigint>")).alias("artifact_ids"), F.coalesce("own", F.lit(False)).alias("own"))
    artifacts = artifacts.join(attribute_artifacts(artifacts, attempts, shots), [*RUN, "artifact_id"]).join(have, [*RUN, "artifact_id"], "left")

    facts = ["created_at", "workflow_id", "workflow_name", "head_branch", "head_sha", "from_fork", "event", "display_title"]
    first = attempts_raw.join(fetches.select(*ATTEMPT, "run_created_at"), ATTEMPT, "left").select(
        *ATTEMPT, F.coalesce("run_created_at", "created_at").alias("created_at"), "workflow_id", F.col("name").alias("workflow_name"), "head_branch", "head_sha",
        from_fork(F.col("head_repository.id"), F.col("repository.id")).alias("from_fork"), "event", "display_title",
    )
    second = artifact_fetch.where(f"not ({bad})").select(*[at(c) for c in (*RUN, "artifact_id")], F.col("run_created_at").alias("created_at"), "workflow_id", "workflow_name", "event", "display_title", "fetched_at", "pr_numbers")
    made = artifacts.select(*RUN, "artifact_id", F.col("workflow_run.head_branch").alias("head_branch"), F.col("workflow_run.head_sha").alias("head_sha"), (F.col("workflow_run.head_repository_id") != F.col("workflow_run.repository_id")).alias("from_fork"))
    runs = run_facts(first, second.join(made, [*RUN, "artifact_id"]), facts)
    none = F.array().cast("array<int>")
    numbers = (
        attempts_raw.select(*RUN, F.transform("pull_requests", lambda x: x["number"]).alias("numbers"))
        .unionByName(fetches.select(*RUN, F.col("commit_pr_numbers").alias("numbers")))
        .unionByName(second.select(*RUN, F.col("pr_numbers").alias("numbers")))
        .withColumn("numbers", F.coalesce("numbers", none))
    )
    runs = runs.join(pr_numbers(numbers), RUN, "left").withColumns({"pr_numbers": F.coalesce("pr_numbers", none), "date_dir": F.to_date("created_at")})
    where = raw.select(*[at(c) for c in RUN], F.col("_at.run_dir").alias("path")).unionByName(artifact_raw.select(*[at(c) for c in RUN], F.col("_at.run_dir").alias("path"))).groupBy(*RUN).agg(F.min("path").alias("path"))
    tables = Tables(runs.join(where, RUN), attempts, full.drop("steps"), steps, artifacts.drop("workflow_run"), tombstones(spark, root, run_dirs))
    return tables, rejected.select(*RUN, F.col("_path").alias("path"), F.lit("not a document").alias("reason"))
