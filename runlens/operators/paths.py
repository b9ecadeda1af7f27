"""Files that a filter selects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import parse_location
from ..plans.filters import Filter, units
from ..schema import RUN, Tables

#: Name of the manifest at the top of an extracted tree.
MANIFEST = "manifest.json"
# Files that belong to a unit.
ATTEMPT_FILES = ("attempt.json", "jobs.json", "artifacts.json", "fetch.json")
ORDER = ["unit_time", "run_id", "attempt", "id", "path"]


def extracted_files(files: DataFrame, manifest: str = MANIFEST) -> DataFrame:
    """Files below extracted trees but the manifest at their top."""
    return files.where(F.col("artifact_id").isNotNull() & F.col("file").startswith("extracted/") & (F.col("file") != f"extracted/{manifest}"))


def run_json(files: DataFrame) -> DataFrame:
    """JSON documents of runs outside extracted trees."""
    return files.where(F.col("path").endswith(".json") & ~(F.col("artifact_id").isNotNull() & F.col("file").startswith("extracted/")))


def unit_paths(tables: Tables, f: Filter, unit: str = "job") -> DataFrame:
    """(unit_time, run_id, attempt, id, path) of the selected units' files: run, attempt, job, log, artifact or extracted.

    The files of a run are its JSON documents outside extracted trees, those of `extracted` the files in the trees of the selected
    artifacts; both are read from tables.files. Without that table, a run has its directory.
    """
    null = F.lit(None).cast("bigint")
    if unit == "run" and tables.files is not None:
        own = units(tables, f, "run").select(*RUN, "unit_time").join(run_json(tables.files).select(*RUN, "path"), RUN)
        return own.select("unit_time", "run_id", F.lit(None).cast("int").alias("attempt"), null.alias("id"), "path")
    if unit == "extracted":
        if tables.files is None:
            raise ValueError("extracted files need tables.files")
        own = units(tables, f, "artifact").select(*RUN, "artifact_id", "unit_time", F.col("attributed_attempt").cast("int").alias("attempt"))
        return own.join(extracted_files(tables.files).select(*RUN, "artifact_id", "path"), [*RUN, "artifact_id"]).select("unit_time", "run_id", "attempt", F.col("artifact_id").alias("id"), "path")
    if unit == "run":
        return units(tables, f, "run").select("unit_time", "run_id", F.lit(None).cast("int").alias("attempt"), null.alias("id"), "path")
    if unit == "attempt":
        files = F.explode(F.array(*[F.lit(x) for x in ATTEMPT_FILES]))
        own = units(tables, f, "attempt").select("unit_time", "run_id", F.col("attempt").cast("int").alias("attempt"), null.alias("id"), "path", files.alias("file"))
        return own.select("unit_time", "run_id", "attempt", "id", F.concat_ws("/", "path", "file").alias("path"))
    if unit in ("job", "log"):
        own = units(tables, f, "job")
        file = "log.txt" if unit == "log" else "job.json"
        own = own.where("has_log") if unit == "log" else own
        return own.select("unit_time", "run_id", F.col("attempt").cast("int").alias("attempt"), F.col("job_id").alias("id"), F.concat_ws("/", "path", F.lit(file)).alias("path"))
    own = units(tables, f, "artifact")
    return own.select("unit_time", "run_id", F.col("attributed_attempt").cast("int").alias("attempt"), F.col("artifact_id").alias("id"), F.concat_ws("/", "path", F.lit("artifact.zip")).alias("path"))


def paths(tables: Tables, f: Filter, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Paths of several kinds of units in one table; without kinds logs and, where tables.files has them, extracted files.

    With tables.files only those stand that are there."""
    kinds = kinds or (("log", "extracted") if tables.files is not None else ("log",))
    found = reduce(DataFrame.unionByName, [unit_paths(tables, f, k) for k in kinds])
    return found if tables.files is None else on_disk(found, tables.files)


def oldest_first(found: DataFrame) -> DataFrame:
    """Paths in the order of a report."""
    return found.orderBy(*ORDER)


def select_artifacts(tables: Tables, f: Filter, within: DataFrame | None = None) -> DataFrame:
    """Artifacts to expand: of the filter or, given paths, those that hold one; without those expanded before or whose archive is lost.

    Columns: run, artifact_id, path (of the archive).
    """
    chosen = units(tables, f, "artifact").select(*RUN, "artifact_id", "path")
    if within is not None:
        named = within.withColumn("_at", parse_location(F.col("path"))).select(*[F.col(f"_at.{c}").alias(c) for c in (*RUN, "artifact_id")]).where("artifact_id is not null").distinct()
        chosen = tables.artifacts.select(*RUN, "artifact_id", "path").join(named, [*RUN, "artifact_id"], "left_semi")
    chosen = chosen.withColumn("path", F.concat("path", F.lit("/artifact.zip")))
    if "extracted" in tables.artifacts.columns:
        chosen = chosen.join(tables.artifacts.where("extracted").select(*RUN, "artifact_id"), [*RUN, "artifact_id"], "left_anti")
    return chosen if tables.tombstones is None else chosen.join(tables.tombstones.select("path"), "path", "left_anti")


def on_disk(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths that a listing holds as files."""
    return expected.join(listing.select("path").distinct(), "path", "left_semi")


def split_by_line_feed(paths_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths that can stand in a list, one a line, and those that hold a line feed."""
    odd = F.contains("path", F.lit("\n"))
    return paths_.where(~odd), paths_.where(odd)
