"""Columns and links derived from raw records of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RUN


def job_kind(started_at: Column, run_started_at: Column, n_steps: Column, runner: Column) -> Column:
    """carried_forward if it started before its attempt, not_applicable with neither steps nor a runner, else ran."""
    return F.when(started_at < run_started_at, "carried_forward").when((n_steps == 0) & runner.isNull(), "not_applicable").otherwise("ran")


def from_fork(head_repo: Column, repo: Column) -> Column:
    """True if the head repository is missing or another one."""
    return ~F.coalesce(head_repo == repo, F.lit(False))


def artifact_action(expired: Column, size: Column, most: int) -> Column:
    """expired, too_large or download."""
    return F.when(expired, "expired").when(size > most, "too_large").otherwise("download")


def digest_sha256(digest: Column) -> Column:
    """Struct of sha256 and malformed: 64 hex digits in lower case; empty for other algorithms or none. The algorithm's name has no case."""
    text = F.coalesce(digest, F.lit(""))
    hex_ = F.regexp_extract(text, r"(?i)^sha256:([0-9a-f]{64})\z", 1)
    formed = text.rlike(r"^[a-zA-Z0-9]+:[0-9a-fA-F]+\z") & ~(text.rlike("(?i)^sha256:") & (hex_ == ""))
    return F.struct(F.lower(hex_).alias("sha256"), ((text != "") & ~formed).alias("malformed"))


def digest_holds(content: Column, sha256: Column) -> Column:
    """True if bytes have the digest, or none is asked."""
    return (sha256 == "") | (F.sha2(content, 256) == sha256)


def log_loss(status: Column, hop: Column, updated_at: Column, grace: str, now: Column) -> Column:
    """What a failed log fetch means: expired, deleted, retry or error. hop: api or blob."""
    later = now > updated_at + F.expr(f"interval {grace}")
    return F.when(status == 410, "expired").when((status == 404) & later, "deleted").when(status == 404, "retry").otherwise("error")


def zip_loss(status: Column, hop: Column, created_at: Column, grace: str, now: Column) -> Column:
    """What a failed archive fetch means; the interface's own 404 is final at once."""
    later = now > created_at + F.expr(f"interval {grace}")
    return F.when(status == 410, "expired").when((status == 404) & ((hop == "api") | later), "deleted").when(status == 404, "retry").otherwise("error")


def run_facts(attempts: DataFrame, artifacts: DataFrame, facts: list[str]) -> DataFrame:
    """Facts of each run: from its highest attempt, else from the artifact fetched last, the higher id at a tie."""
    first = attempts.groupBy(*RUN).agg(F.max_by(F.struct(*facts), "attempt").alias("a"), F.max("attempt").alias("latest_attempt"))
    second = artifacts.groupBy(*RUN).agg(F.max_by(F.struct(*facts), F.struct("fetched_at", "artifact_id")).alias("b"))
    both = first.join(second, RUN, "full_outer")
    return both.select(*RUN, "latest_attempt", *[F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in facts])


def pr_numbers(parts: DataFrame, column: str = "numbers") -> DataFrame:
    """Sorted distinct numbers over all arrays of a run."""
    return parts.groupBy(*RUN).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("pr_numbers"))


def match_originals(jobs: DataFrame) -> DataFrame:
    """(run, job_id, original_job_id) of carried-forward jobs: the job of the latest earlier attempt that is not carried forward and has
    the same name, times and runner, missing ones included; the first by id within an attempt."""
    same = [c for c in ("started_at", "completed_at", "runner_name") if c in jobs.columns]
    key = [F.col(c) for c in (*RUN, "name")]
    carried = jobs.where("kind = 'carried_forward'").select(*key, "attempt", "job_id", *same).alias("c")
    others = jobs.where("kind <> 'carried_forward'").select(*key, "attempt", "job_id", *same).alias("o")
    alike = [F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*RUN, "name", *same)]
    on = F.col("o.attempt") < F.col("c.attempt")
    for x in alike:
        on = on & x
    found = carried.join(others, on, "left").groupBy(*[F.col(f"c.{c}") for c in RUN], F.col("c.job_id"))
    return found.agg(F.max(F.when(F.col("o.job_id").isNotNull(), F.struct(F.col("o.attempt"), -F.col("o.job_id"))))["col2"].alias("negative")).select(*RUN, "job_id", (-F.col("negative")).alias("original_job_id"))


def listing_attempts(listed: DataFrame) -> DataFrame:
    """(run, artifact_id, attempt): the first attempt N that lists an artifact which N - 1, there as well, does not list.

    listed: (run, attempt, artifact_ids, own), own telling whether the attempt was listed while it was the latest.
    """
    w = Window.partitionBy(*RUN).orderBy("attempt")
    both = listed.withColumns({"before": F.lag("attempt").over(w), "ids_before": F.lag("artifact_ids").over(w), "own_before": F.lag("own").over(w)})
    new = both.where("before = attempt - 1 and own and own_before").select(*RUN, "attempt", F.explode(F.array_except("artifact_ids", "ids_before")).alias("artifact_id"))
    return new.groupBy(*RUN, "artifact_id").agg(F.min("attempt").alias("attempt"))


def with_started(artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """artifacts with t, the attempt that was under way when an artifact was made; the next one must be known, unless there is none.

    A run's attempts are few: they come as one row, so artifacts are read and joined once.
    """
    own = attempts.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("attempt", "run_started_at"))).alias("_spans"))

    def inside(x: Column, i: Column) -> Column:
        later = F.get("_spans", i + 1)
        return (F.col("created_at") >= x["run_started_at"]) & (later.isNull() | ((later["attempt"] == x["attempt"] + 1) & (F.col("created_at") < later["run_started_at"])))

    under_way = F.array_max(F.transform(F.filter("_spans", inside), lambda x: x["attempt"]))
    return artifacts.join(own, RUN, "left").withColumn("t", under_way).drop("_spans")


def attribute_artifacts(artifacts: DataFrame, attempts: DataFrame, listed: DataFrame) -> DataFrame:
    """(run, artifact_id, attributed_attempt, attribution): by listing-diff, else timestamp, else unknown with no attempt."""
    by_list = listing_attempts(listed).withColumnRenamed("attempt", "l")
    both = with_started(artifacts.select(*RUN, "artifact_id", "created_at"), attempts).join(by_list, [*RUN, "artifact_id"], "left")
    how = F.when(F.col("l").isNotNull(), "listing-diff").when(F.col("t").isNotNull(), "timestamp").otherwise("unknown")
    return both.select(*RUN, "artifact_id", F.coalesce("l", "t").alias("attributed_attempt"), how.alias("attribution"))


def match_pulls(runs: DataFrame, pulls: DataFrame) -> DataFrame:
    """(run, pr_numbers): pull requests that list a run's commit, with its branch as head, from the same repository; one
    without a repository fits runs from forks only. pulls: (head_sha, number, head_ref, head_repo_id)."""
    same = F.when(F.col("p.head_repo_id").isNull(), F.col("r.from_fork")).otherwise(F.col("p.head_repo_id") == F.col("r.head_repo_id"))
    met = runs.alias("r").join(pulls.dropDuplicates(["head_sha", "number"]).alias("p"), F.expr("r.head_sha = p.head_sha and r.head_branch = p.head_ref"))
    return met.where(same).groupBy(*[F.col(f"r.{c}") for c in RUN]).agg(F.array_sort(F.collect_set("number")).alias("pr_numbers"))
