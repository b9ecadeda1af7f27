"""Keeping the tables current with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import parse_location
from ..operators.freshness import reconcile
from ..schema import RUN
from ..sources.store import Snapshot, Store
from ..sources.units import build_tables, listing, units

#: Folders of changed runs that are named to the readers one by one; with more, the whole tree is read.
MOST_FOLDERS = 20_000
RUN_CHANGE = "host string, repo string, run_id bigint, change string"


def unit_stream(spark: SparkSession, root: str, glob: str = "attempt.json") -> DataFrame:
    """(run, run_dir, path, modified) of unit files as they are published; files never change once visible."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    placed = files.select(relative.alias("path"), F.col("modificationTime").alias("modified")).withColumn("_at", parse_location(F.col("path")))
    return placed.where("_at.reason is null").select(*[F.col(f"_at.{c}").alias(c) for c in (*RUN, "run_dir")], "path", "modified")


def keep_current(stream: DataFrame, derive: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """For each batch of units, derives the runs (run, run_dir) they belong to as a whole; a late re-run so lands at its run's date.

    every: a processing interval for a standing query; without it, what is there is taken in and the query ends.
    """

    def batch(units: DataFrame, _: int) -> None:
        derive(units.select(*RUN, "run_dir").distinct())

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _of_run(path: str) -> Column:
    """The folder of the run in which a unit or a file of a unit stands."""
    return F.regexp_replace(path, r"/(?:attempt-[^/]*|artifacts/[^/]*)(?:/.*)?$", "")


def derive_runs(spark: SparkSession, root: str, store: Store, changed: DataFrame, gone: DataFrame, base: Snapshot | None, found: DataFrame) -> Snapshot:
    """Derives runs anew from their own files and commits them with the removal of others.

    changed: (run, run_dir), gone: (run), found: (run, path, modified) of units on disk. Up to MOST_FOLDERS folders are named to the readers, which then open no
    other file; beyond, or without a base, the whole tree is read and its other runs are left out. Units with a broken document
    are not listed as built, so that they are tried again.
    """
    held: list[DataFrame] = []
    folders = None
    if base is not None:
        named = [r[0] for r in changed.select("run_dir").distinct().limit(MOST_FOLDERS + 1).collect()]
        folders = named if len(named) <= MOST_FOLDERS else None
    try:
        tables, rejected = build_tables(spark, root, folders, held)
        keys = changed.select(*RUN).distinct()
        own = (lambda df: df) if base is None else (lambda df: df.join(keys, RUN, "left_semi"))
        days = own(tables.runs).select(*RUN, "date_dir")
        bad = rejected.select(*RUN, F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
        units_ = found.select(*RUN, "path", "modified").join(bad, [*RUN, "path"], "left_anti")
        parts = {"attempts": tables.attempts, "jobs": tables.jobs, "steps": tables.steps, "artifacts": tables.artifacts, "tombstones": tables.tombstones, "units": units_, "rejected": rejected}
        rows = {"runs": own(tables.runs)} | {name: own(df).join(days, RUN, "left") for name, df in parts.items()}
        if base is None:
            return store.commit(rows)
        places = store.read("units", base).select(*RUN, "date_dir").unionByName(store.read("rejected", base).select(*RUN, "date_dir"))
        touched = keys.unionByName(gone.select(*RUN))
        before = touched.join(places.distinct(), RUN, "left").select(*RUN, "date_dir")
        after = keys.join(days, RUN, "left").select(*RUN, "date_dir")
        return store.commit(rows, before.unionByName(after).distinct(), base)
    finally:
        for df in held:
            df.unpersist()


def refresh(spark: SparkSession, root: str, store: str) -> DataFrame:
    """Brings written tables up to date with the files: (run, change) of the runs derived anew or removed.

    Units on disk are held against those that the store was built from. Only the files of changed runs are read; their rows replace the old ones, and
    rows of removed runs go, on the days where they stand, all at once. A store of another format, or none, is built from all files. Nothing is
    written where nothing has changed.
    """
    kept = Store(spark, store)
    base = kept.current()
    found = units(listing(spark, root)).select(*RUN, "path", "modified").persist()
    told = f"{kept.root}/changes/after={base.version if base else 0}"
    try:
        indexed = found.limit(0) if base is None else kept.read("units", base).select(*RUN, "path", "modified")
        reconcile(found, indexed, RUN).write.mode("overwrite").parquet(told)
        change = spark.read.schema(RUN_CHANGE).parquet(told)
        if base is None or not change.isEmpty():
            folders = found.select(*RUN, _of_run("path").alias("run_dir")).distinct()
            derive_runs(spark, root, kept, change.where("change = 'changed'").join(folders, RUN), change.where("change = 'removed'"), base, found)
        return change
    finally:
        found.unpersist()


def follow(spark: SparkSession, root: str, store: str) -> Callable[[DataFrame], None]:
    """What keep_current calls with each batch of new units: derives their runs from all files they have by then, a late re-run included.

    The first batch builds the store. A batch that is run again after a failure derives the same rows.
    """
    kept = Store(spark, store)

    def derive(runs: DataFrame) -> None:
        if runs.isEmpty():
            return
        base = kept.current()
        if base is None:
            found = units(listing(spark, root)).select(*RUN, "path", "modified")
            derive_runs(spark, root, kept, runs, runs.limit(0), None, found)
            return
        named = [r[0] for r in runs.select("run_dir").distinct().limit(MOST_FOLDERS + 1).collect()]
        found = units(listing(spark, root, run_dirs=named if len(named) <= MOST_FOLDERS else None)).select(*RUN, "path", "modified")
        derive_runs(spark, root, kept, runs, runs.limit(0), base, found)

    return derive


def without_repeats(listings: DataFrame, keys: list[str], created: str = "created_at", overlap: str = "1 hour") -> DataFrame:
    """A stream of landed listings, which overlap by an hour, with each run once."""
    return listings.withWatermark(created, overlap).dropDuplicatesWithinWatermark(keys)


def watch(previous: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Runs still to watch: those known and those seen, at their last status, that are not over. For a keyed table
    rewritten in each batch."""
    rows = previous.select(*keys, "status", F.lit(0).alias("_turn")).unionByName(seen.select(*keys, "status", F.lit(1).alias("_turn")))
    last = rows.groupBy(*keys).agg(F.max_by("status", "_turn").alias("status"))
    return last.where("status <> 'completed'")
