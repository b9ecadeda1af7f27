"""Jobs and steps that flip on a re-run, or fail alone between successes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import Filter, in_time, is_in, matching_jobs, of_runs
from ..schema import ATTEMPT, RUN, Tables

# Conclusions that count as a failure; events of pull requests.
FAILING = ("failure", "cancelled", "timed_out")
PULL_REQUESTS = ("pull_request", "pull_request_target")
#: Runs of a workflow and branch that are looked at together.
STRETCH = 4096
SERIES = ["host", "repo", "workflow_id", "head_branch", "job", "step"]


def failing(conclusion: Column) -> Column:
    """True for a failure."""
    return F.coalesce(conclusion.isin(*FAILING), F.lit(False))


def observations(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """A row per job (step '', pos -1) and per step of it (pos its number): how it concluded. Jobs without steps stay."""
    kept = [c for c in jobs.columns if c not in ("name", "conclusion")]
    job = jobs.select(*kept, F.col("name").alias("job"), F.lit("").alias("step"), F.lit(-1).alias("pos"), "conclusion")
    own = steps.select(*ATTEMPT, "job_id", F.col("name").alias("step"), F.col("number").alias("pos"), "conclusion")
    return job.unionByName(job.drop("step", "pos", "conclusion").join(own, [*ATTEMPT, "job_id"]))


def outcomes(seen: DataFrame) -> DataFrame:
    """Per run, job, step and attempt: outcome (the first failing conclusion by job id and position, else success, else null),
    logs of the jobs that give one, and the first place where it ran.

    Only jobs that ran count; a success is void where the attempt carries forward a failure of the same name.
    """
    ran, carried = F.col("kind") == "ran", F.col("kind") == "carried_forward"
    failed, ok = ran & failing(F.col("conclusion")), ran & (F.col("conclusion") == "success")
    place = F.struct("job_id", "pos")
    log = F.struct("job_id", "path")
    grouped = seen.where(ran | carried).groupBy(*ATTEMPT, "job", "step").agg(
        F.min(F.when(failed, F.struct("job_id", "pos", "conclusion"))).alias("failure"),
        F.bool_or(ok).alias("ok"),
        F.bool_or(carried & failing(F.col("conclusion"))).alias("void"),
        F.collect_set(F.when(failed, log)).alias("failed_logs"),
        F.collect_set(F.when(ok, log)).alias("ok_logs"),
        F.min(F.when(ran, place)).alias("place"),
        F.min(F.when(failed, place)).alias("failed_at"),
    )
    success = F.col("ok") & ~F.col("void")
    return grouped.select(
        *ATTEMPT,
        "job",
        "step",
        F.coalesce("failure.conclusion", F.when(success, "success")).alias("outcome"),
        F.when(success, F.array_union("failed_logs", "ok_logs")).otherwise(F.col("failed_logs")).alias("logs"),
        F.when(F.col("place").isNotNull(), F.struct("attempt", "place.job_id", "place.pos")).alias("seen_at"),
        F.when(F.col("failed_at").isNotNull(), F.struct("attempt", "failed_at.job_id", "failed_at.pos")).alias("failed_at"),
    )


def rerun_flips(tables: Tables, f: Filter = Filter()) -> DataFrame:
    """Jobs and steps of a run with a failing outcome in one attempt and success in another.

    Columns: run, head_sha, job, step, outcomes (attempt, conclusion), logs, failing_steps (of a job), first_seen. Order
    by run, job, first_seen for the order of a report. A run needs a second attempt, and one attempt row that fits
    conclusions and time; then all its attempts count.
    """
    runs = of_runs(tables.runs, f, tables.runs).where("latest_attempt > 1").select(*RUN, "head_sha")
    if f.conclusions or f.since or f.until:
        fit = in_time(is_in(tables.attempts, "conclusion", f.conclusions) if f.conclusions else tables.attempts, f, "run_started_at")
        runs = runs.join(fit.select(*RUN).distinct(), RUN, "left_semi")
    jobs = matching_jobs(tables.jobs, f).select(*ATTEMPT, "job_id", "name", "conclusion", "kind", F.when(F.col("has_log"), F.col("path")).alias("path"))
    if f != Filter(jobs=f.jobs):
        jobs = jobs.join(runs, RUN, "left_semi")
    name = [*RUN, "job", "step"]
    # Only what ran under one name in two attempts can flip, which jobs tell before their steps are read; steps are read once.
    same, ran = Window.partitionBy(*RUN, "name"), F.when(F.col("kind") == "ran", F.col("attempt"))
    jobs = jobs.withColumns({"_least": F.min(ran).over(same), "_most": F.max(ran).over(same)}).where("_least < _most").drop("_least", "_most")
    # One exchange by run serves all that follows.
    by_attempt = outcomes(observations(jobs, tables.steps).repartition(*RUN))
    flips = by_attempt.groupBy(*name).agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome").isNotNull(), F.struct("attempt", F.col("outcome").alias("conclusion"))))).alias("outcomes"),
        F.collect_list(F.transform("logs", lambda x: F.struct("attempt", x["job_id"].alias("job_id"), x["path"].alias("path")))).alias("logs"),
        F.min("seen_at").alias("first_seen"),
        F.min("failed_at").alias("failed_at"),
        F.bool_or(failing(F.col("outcome"))).alias("failed"),
        F.bool_or(F.col("outcome") == "success").alias("passed"),
    )
    failed_step = F.when((F.col("step") != "") & F.col("failed_at").isNotNull(), F.struct("failed_at", "step"))
    flips = flips.withColumn("failing_steps", F.transform(F.array_sort(F.collect_list(failed_step).over(Window.partitionBy(*RUN, "job"))), lambda x: x["step"]))
    none = F.array().cast("array<string>")
    logs = F.transform(F.array_sort(F.filter(F.flatten("logs"), lambda x: x["path"].isNotNull())), lambda x: x["path"])
    found = flips.where("failed and passed").join(runs, RUN)
    return found.select(*RUN, "head_sha", "job", "step", "outcomes", logs.alias("logs"), F.when(F.col("step") == "", F.col("failing_steps")).otherwise(none).alias("failing_steps"), "first_seen")


def _with_first(tables: Tables, f: Filter) -> DataFrame:
    """Counted runs with first, their first attempt (null if it is missing). Runs and attempts are read once; a run's attempts are few."""
    runs = of_runs(tables.runs, Filter(branches=f.branches, workflows=f.workflows, events=f.events), tables.runs)
    own = tables.attempts.groupBy(*RUN).agg(F.collect_list(F.struct("attempt", "conclusion", "run_started_at")).alias("_attempts"))
    both = runs.where(F.coalesce(~F.col("event").isin(*PULL_REQUESTS), F.lit(False))).join(own, RUN, "left")
    nth = lambda n: F.get(F.filter("_attempts", lambda x: x["attempt"] == n), F.lit(0))
    return both.withColumns({"first": nth(F.lit(1)), "_latest": nth(F.col("latest_attempt"))}).where(~F.col("_latest.conclusion").eqNullSafe("cancelled")).drop("_attempts", "_latest")


def counted_runs(tables: Tables, f: Filter) -> DataFrame:
    """Runs that intermittent detection counts: no pull requests, and the latest attempt not cancelled."""
    return _with_first(tables, f).drop("first")


def gaps(tables: Tables, f: Filter = Filter()) -> DataFrame:
    """Counted runs whose first attempt is missing."""
    return _with_first(tables, f).where("first is null").drop("first")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equality join for which nulls are equal; the right side's keys go."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(named[f"_{c}"]) for c in keys]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return left.join(named, condition, how).drop(*[f"_{c}" for c in keys])


def _span(start: str) -> Column:
    """The month of a start: a long series is dealt to tasks by its months. Rows without a start are first."""
    return F.date_trunc("month", start)


def with_gap_counts(runs: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """runs with gaps_before, how many missing runs of the same workflow and branch come before each by (start, run_id), gaps, how many there are,
    and stretch: which STRETCH runs of the workflow and branch it is one of.

    missing: the missing runs, or None if they are among runs, marked by _gap. Counts are made within a month and added up over the months, so a branch with very
    many runs is no group in one task.
    """
    keys = SERIES[:4]
    if missing is not None:
        runs = runs.withColumn("_gap", F.lit(False)).unionByName(missing.select(*keys, "run_id", "start", F.lit(True).alias("_gap")), allowMissingColumns=True)
    both = runs.withColumn("_span", _span("start"))
    inside = Window.partitionBy(*keys, "_span").orderBy("start", "run_id")
    spans = both.groupBy(*keys, "_span").agg(F.count_if("_gap").alias("_n"), F.count("*").alias("_all"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_all")], F.sum("_n").over(Window.partitionBy(*keys)).alias("gaps"))
    counted = _on(both.withColumns({"_inside": F.count_if("_gap").over(inside), "_nth": F.row_number().over(inside)}), spans, [*keys, "_span"]).where("not _gap")
    counted = counted.withColumns({"gaps_before": F.col("_inside") + F.col("_n_before"), "stretch": F.floor((F.col("_nth") + F.col("_all_before")) / STRETCH)})
    return counted.drop("_gap", "_span", "_inside", "_nth", "_n_before", "_all_before")


def first_attempt_series(tables: Tables, f: Filter = Filter()) -> DataFrame:
    """A row per series (workflow, branch, job, step) and run: conclusion, start, logs of failures, and the gaps of the workflow and branch.

    A gap is a run without a first attempt. It stands in every series of its workflow and branch, so it is no row here: each row has the number of gaps before it
    (gaps_before) and of all (gaps), and two rows with a gap between them differ in the former.
    """
    counted = _with_first(tables, f).where(~F.col("first.conclusion").eqNullSafe("cancelled"))
    gap, about = F.col("first").isNull(), ["workflow_id", "workflow_name", "head_branch", "head_sha"]
    runs = with_gap_counts(counted.select(*RUN, *about, F.when(gap, F.col("created_at")).otherwise(F.col("first.run_started_at")).alias("start"), gap.alias("_gap")))
    told = F.struct(*[c for c in runs.columns if c not in RUN]).alias("run")
    jobs = matching_jobs(tables.jobs, f).where("attempt = 1 and kind = 'ran'").select(*ATTEMPT, "job_id", "name", "conclusion", "kind", F.when(F.col("has_log"), F.col("path")).alias("path"))
    # What a run's rows need of it goes along with them, so that runs are counted once.
    seen = observations(jobs.join(runs.select(*RUN, told), RUN), tables.steps)
    concluded = failing(F.col("conclusion")) | (F.col("conclusion") == "success")
    bad = failing(F.col("conclusion"))
    by_run = seen.where(concluded).groupBy(*RUN, "job", "step").agg(
        F.coalesce(F.min(F.when(bad, F.struct("job_id", "pos", "conclusion")))["conclusion"], F.lit("success")).alias("conclusion"),
        F.array_sort(F.collect_set(F.when(bad, F.struct("job_id", "path")))).alias("logs"),
        F.min(F.struct("job_id", "pos")).alias("place"),
        F.first("run").alias("run"),
    ).select("*", "run.*")
    logs = F.transform(F.filter("logs", lambda x: x["path"].isNotNull()), lambda x: x["path"])
    return by_run.select(
        *SERIES, "run_id", "workflow_name", "head_sha", "start", "conclusion", logs.alias("logs"), F.struct("start", "run_id", "place.job_id", "place.pos").alias("seen_at"), "gaps_before", "gaps", "stretch"
    )


def stretches(df: DataFrame, keys: list[str], order: list[str], stretch: Column, conclusion: str = "conclusion", apart: str | None = None) -> DataFrame:
    """(keys, _stretch, rows, alone): the rows of each stretch of a series in their order, and of these the failures whose neighbours in the series succeed.

    stretch: what deals a series to tasks; it must not fall along the order, and bounds the rows that are held at once. Neighbours beyond a stretch are the last
    and the first row of those around it. apart: a column in which neighbours must be equal, as there is a gap between them otherwise.
    """
    rest = [c for c in df.columns if c not in (*keys, *order)]
    each = df.groupBy(*keys, stretch.alias("_stretch")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))
    w = Window.partitionBy(*keys).orderBy("_stretch")
    around = each.withColumns({"_earlier": F.lag(F.element_at("rows", -1)).over(w), "_later": F.lead(F.element_at("rows", 1)).over(w)})
    last = F.size("rows") - 1

    def alone(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("_earlier")).otherwise(F.get("rows", i - 1))
        after = F.when(i == last, F.col("_later")).otherwise(F.get("rows", i + 1))
        near = [F.coalesce((y[conclusion] == "success") & (y[apart].eqNullSafe(x[apart]) if apart else F.lit(True)), F.lit(False)) for y in (before, after)]
        return failing(x[conclusion]) & near[0] & near[1]

    return around.select(*keys, "_stretch", "rows", F.filter("rows", alone).alias("alone"))


def isolated(df: DataFrame, keys: list[str], order: list[str], conclusion: str = "conclusion", apart: str | None = None, stretch: Column | None = None) -> DataFrame:
    """Rows whose conclusion fails while the rows next to it, by order in their keys, succeed. Without a stretch, the first of order is a time, and series are dealt by months."""
    told = stretches(df, keys, order, _span(order[0]) if stretch is None else stretch, conclusion, apart)
    return told.select(*keys, F.explode("alone").alias("x")).select(*keys, "x.*").select(*df.columns)


def intermittent_failures(tables: Tables, f: Filter = Filter()) -> DataFrame:
    """Series with failures in first attempts between two successes: name of the workflow, runs in the series with its gaps, failures.

    Branches, workflows, events and job names make the series; commits, pull requests, conclusions and time select
    failures only. A missing start sorts first. Observations are read once: stretches of series carry what the report says of a whole series.
    """
    series = first_attempt_series(tables, f)
    # Of a success, the report needs no more than that it is there.
    bad = failing(F.col("conclusion"))
    lean = series.withColumns({c: F.when(bad, F.col(c)) for c in ("head_sha", "logs")})
    told = stretches(lean, SERIES, ["start", "run_id"], F.col("stretch"), apart="gaps_before")
    w = Window.partitionBy(*SERIES)
    newest = F.array_max(F.transform("rows", lambda x: F.struct(x["seen_at"], x["workflow_name"])))
    told = told.withColumns({
        "workflow_name": F.max(newest).over(w)["workflow_name"], "runs": F.sum(F.size("rows").cast("bigint")).over(w) + F.max(F.col("rows")[0]["gaps"]).over(w),
        "first_seen": F.min(F.array_min(F.transform("rows", lambda x: x["seen_at"]))).over(w),
    })
    found = told.where(F.size("alone") > 0).select(*SERIES, "workflow_name", "runs", "first_seen", F.explode("alone").alias("x"))
    if f.shas or f.prs or f.conclusions or f.since or f.until:
        attempts = in_time(is_in(tables.attempts, "conclusion", f.conclusions) if f.conclusions else tables.attempts, f, "run_started_at")
        chosen = attempts.select(*RUN).distinct()
        if f.shas or f.prs:
            chosen = of_runs(tables.runs, Filter(shas=f.shas, prs=f.prs), tables.runs).select(*RUN).join(chosen, RUN, "left_semi")
        found = found.withColumn("run_id", F.col("x.run_id")).join(chosen, RUN, "left_semi")
    failure = F.struct("x.start", "x.run_id", "x.head_sha", "x.conclusion", "x.logs")
    return found.groupBy(*SERIES, "workflow_name", "runs", "first_seen").agg(F.array_sort(F.collect_list(failure)).alias("failures"))


def default_branch_runs(tables: Tables, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs on each repository's default branch, or on the one given; and repositories that have neither."""
    named = tables.repos.withColumn("branch", F.coalesce(F.lit(branch), "default_branch"))
    runs = tables.runs.join(named.select("host", "repo", "branch"), ["host", "repo"]).where("head_branch = branch and not from_fork").drop("branch")
    return runs, named.where("branch is null").select("host", "repo")


def findings(tables: Tables, f: Filter = Filter()) -> DataFrame:
    """Both kinds of findings in one table: kind, run or series, job, step, conclusion and the number of outcomes."""
    rerun = rerun_flips(tables, f).select(F.lit("rerun").alias("kind"), "host", "repo", "job", "step", "run_id", F.size("outcomes").cast("bigint").alias("outcomes"))
    alone = intermittent_failures(tables, f).select(F.lit("intermittent").alias("kind"), "host", "repo", "job", "step", F.explode("failures").alias("x"), F.col("runs").alias("outcomes"))
    return rerun.unionByName(alone.select("kind", "host", "repo", "job", "step", F.col("x.run_id").alias("run_id"), "outcomes"))
