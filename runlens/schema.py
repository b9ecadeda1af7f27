"""Tables of run history, their schemas as DDL, and the keys that join them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FORMAT_VERSION = 1

#: A run, on every table; run_id alone is not unique across repositories.
RUN = ["host", "repo", "run_id"]
ATTEMPT = [*RUN, "attempt"]

_run = "host string, repo string, run_id bigint"
RUNS = (
    f"{_run}, created_at timestamp, date_dir date, path string, workflow_id bigint, workflow_name string, head_branch string, head_sha string, "
    "from_fork boolean, event string, pr_numbers array<int>, display_title string, latest_attempt int"
)
ATTEMPTS = f"{_run}, attempt int, path string, status string, conclusion string, run_started_at timestamp, completed_at timestamp, html_url string"
JOBS = (
    f"{_run}, attempt int, job_id bigint, name string, slug string, kind string, original_job_id bigint, conclusion string, started_at timestamp, "
    "completed_at timestamp, runner_name string, labels array<string>, has_log boolean, log_bytes bigint, path string, html_url string"
)
STEPS = f"{_run}, attempt int, job_id bigint, number int, name string, conclusion string, started_at timestamp, completed_at timestamp, path string"
ARTIFACTS = (
    f"{_run}, attributed_attempt int, attribution string, artifact_id bigint, name string, size bigint, created_at timestamp, expired boolean, has_zip boolean, extracted boolean, path string"
)
TOMBSTONES = f"{_run}, path string, target string, reason string, http_status int, tombstoned_at timestamp"
FILES = f"{_run}, attempt int, job_id bigint, artifact_id bigint, path string, file string, length bigint"
UNITS = f"{_run}, path string, modified timestamp"


@dataclass(frozen=True)
class Tables:
    """The derived tables; operators read those they need."""

    runs: DataFrame
    attempts: DataFrame | None = None
    jobs: DataFrame | None = None
    steps: DataFrame | None = None
    artifacts: DataFrame | None = None
    tombstones: DataFrame | None = None
    log_lines: DataFrame | None = None
    files: DataFrame | None = None
    repos: DataFrame | None = None
