"""What to fetch next, planned over landed listings and the state of earlier cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of runs that are not over.
NON_TERMINAL = ("in_progress", "queued", "requested", "waiting", "pending", "action_required")

#: Days in which a run can be run again.
RERUN_DAYS = 30


def merge_listings(listings: list[DataFrame], keys: list[str], pos: str = "pos") -> DataFrame:
    """Rows of several listings, the earlier listing's row for a key first, then its earlier position. One aggregation."""
    columns = [c for c in listings[0].columns if c not in (*keys, pos)]
    rows = reduce(DataFrame.unionByName, [x.select(*keys, *columns, pos).withColumn("_listing", F.lit(i)) for i, x in enumerate(listings)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("_listing", pos)).alias("best"))
    return best.select(*keys, "best.*")


def missing_attempts(listed: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt): completed attempts of listed runs that are not on disk; the latest counts once the run is completed.

    listed: keys, run_attempt (0 counts as 1), status.
    """
    latest = F.greatest(F.col("run_attempt"), F.lit(1)) - F.when(F.col("status") == "completed", 0).otherwise(1)
    wanted = listed.withColumn("latest", latest).where("latest >= 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("latest"))).alias("attempt"))
    return wanted.join(attempts.select(*keys, "attempt"), [*keys, "attempt"], "left_anti")


def retry_artifacts(listing: DataFrame, pending: DataFrame, snapshots: DataFrame, on_disk: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts without a directory, from the listing, else what is pending, else snapshots with the oldest attempt first."""
    columns = [*keys, "artifact_id", "name", "size"]
    order = F.struct(F.lit(0).alias("attempt"), F.col("pos").alias("pos"))
    by_attempt = F.struct(F.col("attempt").cast("int").alias("attempt"), F.col("pos").alias("pos"))
    found = merge_listings([listing.select(*columns, order.alias("pos")), pending.select(*columns, order.alias("pos")), snapshots.select(*columns, by_attempt.alias("pos"))], [*keys, "artifact_id"])
    return found.join(on_disk.select(*keys, "artifact_id"), [*keys, "artifact_id"], "left_anti")


def discover(listings: list[DataFrame], cutoff: Column, horizons: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs to look at, rejects): listings merged, without expired runs and those behind a horizon; rejects have no creation time."""
    merged = merge_listings(listings, keys)
    bad = merged.where("created_at is null")
    fresh = merged.where(F.col("created_at").isNotNull() & (F.to_date("created_at") >= cutoff)).join(horizons, "repo", "left")
    return fresh.where(F.col("horizon").isNull() | (F.col("created_at") > F.col("horizon"))).drop("horizon"), bad


def rescan(listed: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Listed runs that are on disk, for re-runs of old ones."""
    return listed.join(runs.select(*keys), keys, "left_semi")


def unlisted(state: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a state table that no listing names."""
    return state.join(listed.select(*keys), keys, "left_anti")


def pending_after(state: DataFrame, seen: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Pending artifacts after some runs were looked at: what is left of those replaces what stood for them."""
    return state.join(seen.select(*keys).distinct(), keys, "left_anti").unionByName(left.select(*state.columns))


def pruned(state: DataFrame, cutoff: Column, horizons: DataFrame) -> DataFrame:
    """A state table (repo, created_at, ...) without runs that retention removes or a horizon passes."""
    both = state.join(horizons.select("repo", F.col("horizon").alias("_horizon")), "repo", "left")
    gone = (F.to_date("created_at") < cutoff) | (F.col("created_at") <= F.col("_horizon"))
    return both.where(~F.coalesce(gone, F.lit(False))).select(*state.columns)


def rebuilt_pending(snapshots: DataFrame, on_disk: DataFrame, keys: list[str]) -> DataFrame:
    """Pending artifacts from the attempts' listings alone, where the state is lost."""
    none = snapshots.limit(0)
    return retry_artifacts(none, none, snapshots, on_disk, keys)


def publishable(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complete): whether all jobs of an attempt are completed."""
    return jobs.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("complete"))


def listing_windows(repos: DataFrame, now: Column) -> DataFrame:
    """Per repository, the begin of its next listing: the backfill's days ago, or an hour before the end of the last complete one if
    that is earlier, never before the oldest retained day."""
    oldest = F.date_trunc("day", now - F.make_dt_interval(F.col("retention_days")))
    back = now - F.make_dt_interval(F.col("backfill_days"))
    return repos.withColumn("list_from", F.greatest(oldest, F.least(back, F.col("listed_until") - F.expr("interval 1 hour"))))


def rescan_windows(repos: DataFrame, now: Column) -> DataFrame:
    """Repositories with rescan_from and rescan_to: runs that a re-run can still change and the backfill doesn't list.

    Repositories whose backfill covers these are left out, and those rescanned less than an hour ago; a record from the future counts as none.
    """
    back = F.least(F.lit(RERUN_DAYS), F.col("retention_days"))
    since = F.unix_micros(now) - F.unix_micros("rescanned_at")
    due = repos.where((F.col("backfill_days") < back) & ~F.coalesce(since.between(0, 3_600_000_000 - 1), F.lit(False)))
    return due.withColumns({"rescan_from": now - F.make_dt_interval(back), "rescan_to": now - F.make_dt_interval(F.col("backfill_days"))})


def oldest_dates(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo, oldest): the oldest date of runs on disk inside each repository's window; only those days' partitions count."""
    met = runs.select("repo", "date_dir").join(windows.select("repo", "rescan_from", "rescan_to"), "repo")
    inside = F.col("date_dir").between(F.to_date("rescan_from"), F.to_date("rescan_to"))
    return met.where(inside).groupBy("repo").agg(F.min("date_dir").alias("oldest"))


def same_repo(a: Column, b: Column) -> Column:
    """True for one repository's name, whatever its case."""
    return F.lower(a) == F.lower(b)


def oldest_first(merged: DataFrame, id_: str = "run_id") -> DataFrame:
    """Merged listings in the order in which runs are worked on."""
    return merged.orderBy("created_at", id_)


def discovery_set(windows: list[DataFrame], statuses: DataFrame, rescanned: DataFrame, watched: DataFrame, pending: DataFrame, cutoff: Column, horizons: DataFrame, runs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs to look at, rejects) of a cycle, each run as the first source that names it tells it.

    Sources in order: listings by creation, listings of runs that are not over, rescanned runs as far as they are on disk, watched
    runs, and runs with pending artifacts. Statuses other than NON_TERMINAL ones say nothing and are left out.
    """
    live = statuses.where(F.col("status").isin(*NON_TERMINAL))
    found, bad = discover([*windows, live.select(*windows[0].columns)], cutoff, horizons, keys)
    columns = [c for c in windows[0].columns if c != "pos"]
    listed = found.select(*columns)
    for more in (rescan(rescanned, runs, keys), watched, pending):
        listed = listed.unionByName(more.select(*columns).join(listed.select(*keys), keys, "left_anti"))
    return listed, bad


def check_pages(pages: DataFrame, items: str, id_: str = "id", needed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(elements, rejected listings) of landed pages: listing, total_count, and the array `items`.

    A listing is rejected if it has fewer elements than it counts, an element without an id (or one below 1), one id twice, or an element that lacks one of
    the `needed` fields, as artifacts need created_at.
    """
    each = pages.select("listing", "total_count", F.posexplode_outer(items).alias("pos", "item"))
    known = F.when(F.col(f"item.{id_}") > 0, F.col(f"item.{id_}"))
    lacks = [F.count_if(F.col("item").isNotNull() & F.col(f"item.{c}").isNull()).alias(f"without_{c}") for c in needed]
    numbers = each.groupBy("listing").agg(F.max("total_count").alias("total"), F.count("item").alias("n"), F.count(known).alias("with_id"), F.count_distinct(known).alias("distinct_ids"), *lacks)
    why = F.when(F.col("with_id") < F.col("n"), "missing id").when(F.col("distinct_ids") < F.col("n"), "duplicate id").when(F.col("n") < F.col("total"), "fewer than counted")
    for c in needed:
        why = why.when(F.col(f"without_{c}") > 0, f"missing {c}")
    judged = numbers.withColumn("reason", why)
    good = each.where("item is not null").join(judged.where("reason is null").select("listing"), "listing", "left_semi")
    return good.select("listing", "pos", "item.*"), judged.where("reason is not null").select("listing", "reason", "n", "total")


def work_order(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One table of work: artifacts of the newest run first, then attempts of the oldest run first."""
    first = artifacts.select(F.lit(0).alias("phase"), (-F.unix_micros("created_at")).alias("priority"), "repo", "run_id", F.col("artifact_id").alias("unit"))
    second = attempts.select(F.lit(1).alias("phase"), F.unix_micros("created_at").alias("priority"), "repo", "run_id", F.col("attempt").cast("bigint").alias("unit"))
    return first.unionByName(second)


def once_per_commit(runs: DataFrame) -> DataFrame:
    """Commits to look up, each once."""
    return runs.select("repo", "head_sha").where("head_sha is not null").distinct()
