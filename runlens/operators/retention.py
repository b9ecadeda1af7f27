"""What retention removes: runs past their age, then extracted trees and whole runs, oldest first, until a cap holds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["run_id", "dir"]


def running_before(df: DataFrame, value: str, day: str = "date_dir", order: tuple[str, ...] = ("run_id", "dir")) -> DataFrame:
    """df with `before`: the sum of value over all rows that come earlier by day and order.

    One ordered pass over everything would be one task. Days are summed first and their few sums run up; inside a day
    rows run up in parallel by day. The table of days is joined back by day.
    """
    days = df.groupBy(day).agg(F.sum(value).alias("_day")).withColumn("_offset", F.coalesce(F.sum("_day").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(days.drop("_day"), day).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_inside", "_offset")


def cutoff(now: Column, retention_days: Column) -> Column:
    """The first date that stays."""
    return F.date_sub(F.to_date(now), retention_days)


def expired(runs: DataFrame, cut: date) -> DataFrame:
    """Runs of days before the cutoff; prunes partitions."""
    return runs.where(F.col("date_dir") < F.lit(cut))


def evicted_trees(kept: DataFrame, trees: DataFrame, cap: Column | int) -> DataFrame:
    """Extracted trees that go, one by one by date, run and name: those before which the kept bytes are still over the cap.

    kept: with bytes. trees: repo, run_id, dir, date_dir, tree, tree_bytes of kept runs.
    """
    sums = kept.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))  # one row
    ordered = running_before(trees.where("tree_bytes > 0"), "tree_bytes", order=("run_id", "dir", "tree")).crossJoin(F.broadcast(sums))
    return ordered.where(F.col("_total") - F.col("before") > cap).drop("_total", "before")


def plan_retention(runs: DataFrame, cut: date, cap: int, horizons: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """(repo, run_id, dir, phase, bytes, tree) of victims: 1 expired, 2 extracted trees, 3 evicted, 4 passed by a horizon.

    runs: repo, run_id, dir, date_dir, created_at, bytes (extracted ones included), and extracted_bytes if `trees` is not given: then a run has
    one tree. trees: repo, run_id, dir, tree, tree_bytes. Expired runs leave the total before
    the cap counts; trees go before any run. Evicted runs raise their repository's horizon, and kept runs at or before a
    horizon go as well, without raising it.
    """
    old = expired(runs, cut).withColumn("phase", F.lit(1))
    kept = runs.where(F.col("date_dir") >= F.lit(cut))
    if trees is None:
        own = kept.select("repo", "run_id", "dir", "date_dir", F.lit("extracted").alias("tree"), F.col("extracted_bytes").alias("tree_bytes"))
    else:
        own = trees.join(kept.select("repo", "run_id", "dir", "date_dir"), ["repo", "run_id", "dir"])
    trees = evicted_trees(kept, own, cap)
    gone = trees.groupBy("repo", "run_id", "dir").agg(F.sum("tree_bytes").alias("gone_bytes"))
    left = kept.join(gone, ["repo", "run_id", "dir"], "left").withColumn("left_bytes", F.col("bytes") - F.coalesce("gone_bytes", F.lit(0)))
    total = left.agg(F.coalesce(F.sum("left_bytes"), F.lit(0)).alias("_total"))  # one row
    ordered = running_before(left, "left_bytes").crossJoin(F.broadcast(total))
    over = F.col("_total") - F.col("before") > cap
    evicted = ordered.where(over)
    raised = raise_horizons(evicted, horizons)
    rest = ordered.where(~over).join(raised, "repo").where(F.col("created_at") <= F.col("horizon"))
    columns, no_tree = ["repo", "run_id", "dir", "phase"], F.lit(None).cast("string").alias("tree")
    return (
        old.select(*columns, F.col("bytes").cast("bigint").alias("bytes"), no_tree)
        .unionByName(trees.withColumn("phase", F.lit(2)).select(*columns, F.col("tree_bytes").cast("bigint").alias("bytes"), "tree"))
        .unionByName(evicted.withColumn("phase", F.lit(3)).select(*columns, F.col("left_bytes").cast("bigint").alias("bytes"), no_tree))
        .unionByName(rest.withColumn("phase", F.lit(4)).select(*columns, F.col("left_bytes").cast("bigint").alias("bytes"), no_tree))
    )


def raise_horizons(evicted: DataFrame, horizons: DataFrame | None = None) -> DataFrame:
    """(repo, horizon): the newest creation of evicted runs, or what was stored if that is later."""
    new = evicted.groupBy("repo").agg(F.max("created_at").alias("new")).where("new is not null")
    if horizons is None:
        return new.select("repo", F.col("new").alias("horizon"))
    return horizons.join(new, "repo", "full_outer").select("repo", F.greatest("horizon", "new").alias("horizon"))


def skipped_by_horizon(runs: DataFrame, horizons: DataFrame) -> DataFrame:
    """Runs created at or before their repository's horizon; a run without a time is none."""
    return runs.join(horizons, "repo").where(F.col("created_at") <= F.col("horizon")).drop("horizon")


def apply_retention(table: DataFrame, victims: DataFrame) -> DataFrame:
    """Rows of a table that stay: those of no victim run."""
    return table.join(victims.where("phase <> 2").select("repo", "run_id").distinct(), ["repo", "run_id"], "left_anti")


def execute(runs: DataFrame, victims: DataFrame, horizons: DataFrame | None, tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Writes raised horizons first and then, per table, the rows that stay, below `root`; returns what was written, read again.

    A failure between the two leaves horizons that are too late by nothing: the runs that they pass are victims of the next plan.
    victims: as planned over runs (with created_at).
    """
    spark = runs.sparkSession
    evicted = victims.where("phase = 3").select("repo", "run_id").join(runs.select("repo", "run_id", "created_at"), ["repo", "run_id"])
    raise_horizons(evicted, horizons).write.mode("overwrite").parquet(f"{root}/horizons")
    written = {"horizons": spark.read.parquet(f"{root}/horizons")}
    for name, table in tables.items():
        apply_retention(table, victims).write.mode("overwrite").parquet(f"{root}/{name}")
        written[name] = spark.read.parquet(f"{root}/{name}")
    return written


def past_cap(victims: DataFrame) -> DataFrame:
    """One row (trees, bytes) for a notice after archives are expanded: extracted trees that the next cycle removes; no row if none."""
    return victims.where("phase = 2").agg(F.count("*").alias("trees"), F.sum("bytes").alias("bytes")).where("trees > 0")


def run_bytes(listing: DataFrame) -> DataFrame:
    """(repo, run_id, bytes, extracted_bytes) from a file listing with path parts and length."""
    return listing.groupBy("repo", "run_id").agg(F.sum("length").alias("bytes"), F.coalesce(F.sum(F.when(F.contains("path", F.lit("/extracted/")), F.col("length"))), F.lit(0)).alias("extracted_bytes"))


def store_measure(runs: DataFrame, attempts: DataFrame, horizons: DataFrame | None = None) -> DataFrame:
    """Per repository: runs, attempts, bytes, the newest run with an attempt, and the horizon."""
    per_run = attempts.groupBy("repo", "run_id").agg(F.count("*").alias("attempts"))
    found = runs.join(per_run, ["repo", "run_id"], "left").groupBy("repo").agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.max(F.when(F.col("attempts") > 0, F.col("created_at"))).alias("newest_completed"),
    )
    return found if horizons is None else found.join(horizons, "repo", "left")
