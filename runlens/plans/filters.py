"""The filter that every query takes, and what it selects for each kind of unit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import glob_match
from ..schema import ATTEMPT, RUN, Tables

#: Values of a field up to which they stand in the plan; more are joined.
MOST_LITERALS = 1000
#: Globs up to which each row's name is held against them; with more, each distinct name once.
MOST_GLOBS = 16


@dataclass(frozen=True)
class Filter:
    """Values of a field are alternatives, fields all hold, and an empty field does not restrict."""

    branches: tuple[str, ...] = ()
    shas: tuple[str, ...] = ()
    prs: tuple[int, ...] = ()
    workflows: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    conclusions: tuple[str, ...] = ()
    jobs: tuple[str, ...] = ()
    since: datetime | None = None
    until: datetime | None = None


def whole_second_up(t: datetime) -> datetime:
    """t, or the next whole second."""
    return t if t.microsecond == 0 else t.replace(microsecond=0) + timedelta(seconds=1)


def is_in(df: DataFrame, column: str, values: tuple) -> DataFrame:
    """Rows with one of the values, of which there may be very many."""
    if len(values) <= MOST_LITERALS:
        return df.where(F.col(column).isin(list(values)))
    kind = df.schema[column].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], f"`{column}` {kind.simpleString()}")
    return df.join(wanted, column, "left_semi")


def holding(runs: DataFrame, values: Column, wanted: list, kind: str) -> DataFrame:
    """Runs of which one of an array of values is wanted; many wanted ones are joined."""
    if len(wanted) <= MOST_LITERALS:
        return runs.where(F.arrays_overlap(values, F.lit(wanted).cast(f"array<{kind}>")))
    asked = runs.sparkSession.createDataFrame([(v,) for v in wanted], f"value {kind}")
    found = runs.select(*RUN, F.explode(values).alias("value")).join(asked, "value", "left_semi").select(*RUN).distinct()
    return runs.join(found, RUN, "left_semi")


def of_runs(runs: DataFrame, f: Filter, all_runs: DataFrame | None = None) -> DataFrame:
    """Runs that the fields about runs select. A branch never selects a run from a fork; a workflow's name selects its
    id under whatever name; a commit's beginning is compared without ASCII case."""
    if f.branches:
        runs = is_in(runs.where(~F.col("from_fork")), "head_branch", f.branches)
    if f.shas:
        shas = sorted({s.lower() for s in f.shas})
        beginnings = F.transform(F.array(*[F.lit(n) for n in sorted({len(s) for s in shas})]), lambda n: F.lower(F.col("head_sha")).substr(F.lit(1), n))
        runs = holding(runs, F.array_distinct(beginnings), shas, "string")
    if f.prs:
        runs = holding(runs, F.col("pr_numbers"), sorted({int(n) for n in f.prs}), "int")
    if f.workflows:
        named = is_in(all_runs if all_runs is not None else runs, "workflow_name", f.workflows).select("host", "repo", "workflow_id").distinct()
        runs = runs.join(named, ["host", "repo", "workflow_id"], "left_semi")
    if f.events:
        runs = is_in(runs, "event", f.events)
    return runs


def in_time(df: DataFrame, f: Filter, when: str) -> DataFrame:
    """Rows between since, rounded up to a second, and until, cut to one; both belong."""
    if f.since is not None:
        df = df.where(F.col(when) >= F.lit(whole_second_up(f.since)))
    if f.until is not None:
        df = df.where(F.col(when) <= F.lit(f.until.replace(microsecond=0)))
    return df


def matching_jobs(jobs: DataFrame, f: Filter) -> DataFrame:
    """Jobs whose whole name matches one of the globs."""
    if len(f.jobs) <= MOST_GLOBS:
        return jobs.where(glob_match(F.col("name"), list(f.jobs))) if f.jobs else jobs
    # The count keeps the condition behind the grouping; otherwise it goes before it, to every row.
    names = jobs.groupBy("name").agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 0, glob_match(F.col("name"), list(f.jobs))))
    return jobs.join(names, "name", "left_semi").select(*jobs.columns)


def latest_conclusion(tables: Tables) -> DataFrame:
    """(run, latest_conclusion): how the latest attempt of each run concluded; null if it is not there."""
    last = tables.attempts.select(*RUN, F.col("attempt").alias("latest_attempt"), F.col("conclusion").alias("latest_conclusion"))
    return tables.runs.select(*RUN, "latest_attempt").join(last, [*RUN, "latest_attempt"], "left").select(*RUN, "latest_conclusion")


def units(tables: Tables, f: Filter, unit: str) -> DataFrame:
    """Selected rows of a unit, with the run's columns joined: run, attempt, job or artifact.

    Conclusions are those of the job, of the attempt, or of the run's latest attempt; for an artifact as for its run. The time
    is the run's creation, the start of the attempt (also for jobs), or the artifact's creation. Jobs by name are
    those jobs, or what has one in its attempt or run.
    """
    runs = of_runs(tables.runs, f, tables.runs)
    jobs = matching_jobs(tables.jobs, f) if f.jobs else None
    about = [c for c in ("created_at", "head_branch", "head_sha", "workflow_id", "workflow_name", "event") if c in runs.columns]
    run = runs.select(*RUN, *about)
    if unit in ("run", "artifact"):
        chosen = run
        if f.conclusions:
            chosen = is_in(run.join(latest_conclusion(tables), RUN), "latest_conclusion", f.conclusions).drop("latest_conclusion")
        if jobs is not None:
            chosen = chosen.join(jobs.select(*RUN).distinct(), RUN, "left_semi")
        if unit == "run":
            return in_time(chosen.withColumn("unit_time", F.col("created_at")), f, "unit_time").join(tables.runs.select(*RUN, "path"), RUN)
        own = tables.artifacts.select(*RUN, "artifact_id", "name", "path", F.col("created_at").alias("unit_time"), "attributed_attempt")
        return in_time(own, f, "unit_time").join(chosen, RUN)
    attempts = tables.attempts.select(*ATTEMPT, F.col("run_started_at").alias("unit_time"), "conclusion", "path")
    if unit == "attempt":
        own = in_time(is_in(attempts, "conclusion", f.conclusions) if f.conclusions else attempts, f, "unit_time")
        if jobs is not None:
            own = own.join(jobs.select(*ATTEMPT).distinct(), ATTEMPT, "left_semi")
        return own.join(run, RUN)
    if unit != "job":
        raise ValueError(f"{unit!r} is no unit")
    own = jobs if jobs is not None else tables.jobs
    own = is_in(own, "conclusion", f.conclusions) if f.conclusions else own
    return own.join(in_time(attempts, f, "unit_time").drop("conclusion", "path"), ATTEMPT).join(run, RUN)
