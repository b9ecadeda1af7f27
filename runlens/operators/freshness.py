"""How current the tables are: pending units, lag, and warnings, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ["repo", "run_id", "unit"]


def pending_since(pending: DataFrame, previous: DataFrame, finished: Column) -> DataFrame:
    """Each pending unit once, with its first error and since when: as before, unless that is unknown or after `finished`.

    pending: unit columns, pos, error. previous: unit columns, since.
    """
    first = pending.groupBy(*UNIT).agg(F.min_by("error", "pos").alias("error"))
    known = previous.where("since is not null").groupBy(*UNIT).agg(F.max("since").alias("last"))
    since = F.when(F.col("last").isNull() | (F.col("last") > finished), finished).otherwise(F.col("last"))
    return first.join(known, UNIT, "left").select(*UNIT, F.trim(F.regexp_replace("error", r"[\p{Cntrl}\s]+", " ")).alias("error"), since.alias("since"))


def carried_pending(previous: DataFrame, now: DataFrame, published: DataFrame, completed: bool) -> DataFrame:
    """Units pending before that the cycle may have skipped, and neither names again nor has published. After a cycle that
    ran to its end, only units of runs that it left pending as a whole (unit '')."""
    kept = previous
    if completed:
        kept = kept.join(now.where("unit = ''").select("repo", "run_id").distinct(), ["repo", "run_id"], "left_semi")
    return kept.join(published.select(*UNIT), UNIT, "left_anti").join(now.select(*UNIT), UNIT, "left_anti")


def published_units(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(repo, run_id, unit) of all that is on disk: `attempt n` and `artifact id`."""
    first = attempts.select("repo", "run_id", F.concat(F.lit("attempt "), F.col("attempt").cast("string")).alias("unit"))
    return first.unionByName(artifacts.select("repo", "run_id", F.concat(F.lit("artifact "), F.col("artifact_id").cast("string")).alias("unit")))


def stuck(pending: DataFrame, repos: DataFrame, now: Column) -> DataFrame:
    """(repo, stuck, oldest): units pending for more than twice the interval."""
    late = pending.join(repos.select("repo", "sync_interval"), "repo").where(F.unix_micros(now) - F.unix_micros("since") > F.lit(2_000_000).cast("bigint") * F.col("sync_interval"))
    return late.groupBy("repo").agg(F.count("*").alias("stuck"), F.min("since").alias("oldest"))


def lag_seconds(finished: Column, newest: Column) -> Column:
    """Seconds from the newest completed run to the end of the last cycle."""
    return F.unix_seconds(finished) - F.unix_seconds(newest)


def freshness(repos: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """Per repository the first that applies: never synced, blocked, no success, stale, stuck, bad config; else empty.

    repos: repo, synced_at, blocked, last_ok, sync_interval (seconds), config_error.
    """
    both = repos.join(stuck(pending, repos, now), "repo", "left")
    old = F.unix_micros(now) - F.unix_micros("last_ok") > F.lit(2_000_000).cast("bigint") * F.col("sync_interval")
    warning = (
        F.when(F.col("synced_at").isNull(), "never synced")
        .when(F.col("blocked").isNotNull(), "blocked")
        .when(F.col("last_ok").isNull(), "no success")
        .when(old, "stale")
        .when(F.coalesce("stuck", F.lit(0)) > 0, "stuck")
        .when(F.col("config_error").isNotNull(), "bad config")
        .otherwise("")
    )
    return both.withColumn("warning", warning)


def blocked_since(previous: DataFrame, cycle: DataFrame) -> DataFrame:
    """(repo, kind, since): what blocks a repository, since the earlier block if it was blocked before; a cancelled cycle keeps it.

    previous: repo, kind, since. cycle: repo, blocked_kind, cancelled, started.
    """
    both = cycle.join(previous, "repo", "left")
    kept = F.col("cancelled") & F.col("blocked_kind").isNull()
    kind = F.when(kept, F.col("kind")).otherwise(F.col("blocked_kind"))
    since = F.when(kept, F.col("since")).when(F.col("blocked_kind").isNotNull(), F.coalesce("since", "started"))
    return both.select("repo", kind.alias("kind"), since.alias("since"))


MEASURED = ["runs", "attempts", "bytes", "newest_completed", "horizon"]


def next_pending(previous: DataFrame, pending: DataFrame, published: DataFrame, completed: bool, finished: Column) -> DataFrame:
    """(repo, run_id, unit, error, since) after a cycle: what it left, and what was pending before and it may have skipped."""
    now = pending_since(pending, previous, finished)
    return now.unionByName(carried_pending(previous, now, published, completed).select(*now.columns))


def next_status(previous: DataFrame, cycle: DataFrame, measure: DataFrame, pending: DataFrame) -> DataFrame:
    """A row per repository after a cycle; repositories are matched whatever the case of their names.

    previous: repo, cycle, last_ok, kind, since, default_branch. cycle: repo, started, finished, completed, cancelled,
    blocked_kind, default_branch, sync_interval, config_error. measure: repo and MEASURED. pending: as after the cycle.
    """
    key = F.lower("repo").alias("_key")
    last = previous.select(key, F.col("cycle").alias("_cycle"), F.col("last_ok").alias("_ok"), F.col("default_branch").alias("_branch"), F.col("kind"), F.col("since"))
    disk = measure.select(key, *MEASURED)
    left = pending.groupBy(key).agg(F.count("*").alias("pending_units"))
    both = cycle.withColumn("_key", F.lower("repo")).join(last, "_key", "left").join(disk, "_key", "left").join(left, "_key", "left")
    kept = F.col("cancelled") & F.col("blocked_kind").isNull()
    kind = F.when(F.col("completed"), None).when(kept, F.col("kind")).otherwise(F.col("blocked_kind"))
    since = F.when(F.col("completed"), None).when(kept, F.col("since")).when(F.col("blocked_kind").isNotNull(), F.coalesce("since", "started"))
    return both.select(
        "repo",
        (F.coalesce("_cycle", F.lit(0)) + 1).alias("cycle"),
        "started",
        "finished",
        F.when(F.col("completed"), F.col("finished")).otherwise(F.col("_ok")).alias("last_ok"),
        kind.alias("kind"),
        since.alias("since"),
        F.coalesce(F.nullif(F.col("default_branch"), F.lit("")), "_branch").alias("default_branch"),
        "sync_interval",
        "config_error",
        F.coalesce("pending_units", F.lit(0)).alias("pending_units"),
        *MEASURED,
        lag_seconds(F.col("finished"), F.col("newest_completed")).alias("lag_seconds"),
    )


def remeasured(status: DataFrame, measure: DataFrame) -> DataFrame:
    """Status rows with what repositories hold now; lag stays as of the last cycle's end. No repository is added."""
    new = measure.select(F.lower("repo").alias("_key"), *MEASURED)
    own = status.drop(*MEASURED, "lag_seconds").withColumn("_key", F.lower("repo")).join(new, "_key", "left").drop("_key")
    return own.withColumn("lag_seconds", lag_seconds(F.col("finished"), F.col("newest_completed"))).select(*status.columns)


def status_report(status: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """One row per repository: its status, the units that are stuck, and the warning that applies."""
    told = status.withColumns({"synced_at": F.col("finished"), "blocked": F.col("kind")})
    return freshness(told, pending, now).drop("synced_at", "blocked")


def reconcile(on_disk: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of runs whose units differ: changed, or removed if no unit is left. Units: keys, path, modified."""
    disk = on_disk.select(*keys, "path", F.col("modified").alias("now")).withColumn("here", F.lit(True))
    old = indexed.select(*keys, "path", F.col("modified").alias("then"))
    both = disk.join(old, [*keys, "path"], "full_outer")
    per_run = both.groupBy(*keys).agg(F.bool_or(~F.col("now").eqNullSafe(F.col("then"))).alias("differs"), F.bool_or(F.coalesce("here", F.lit(False))).alias("here"))
    return per_run.where("differs").select(*keys, F.when(F.col("here"), "changed").otherwise("removed").alias("change"))
