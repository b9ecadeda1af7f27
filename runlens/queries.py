"""A query per operator over the given tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import derive, flakes, freshness, ingest, paths, retention, search
from .plans.ci_view import ci_tables, ci_view, with_views
from .plans.filters import Filter, latest_conclusion, units
from .schema import RUN
from .sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SINCE, UNTIL = datetime(1994, 3, 1, 0, 0, 0, 500), datetime(1996, 6, 30, 12, 0, 0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL over the views or the tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql) if "ci_" in sql else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Filters -------------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str, f: Filter) -> DataFrame:
    return units(ci_tables(spark, sf_dir), f, "run").select("repo", "run_id")


@query("SELECT repo, run_id FROM ci_runs WHERE head_branch IN ('main', 'release-3') AND NOT from_fork")
def F1_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two branches."""
    return _runs(spark, sf_dir, Filter(branches=("main", "release-3")))


@query("SELECT repo, run_id FROM ci_runs WHERE starts_with(head_sha, 'ab') OR starts_with(head_sha, '01f')")
def F2_sha_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the beginning of a commit, in any case."""
    return _runs(spark, sf_dir, Filter(shas=("AB", "01f")))


@query("SELECT repo, run_id FROM ci_runs WHERE pr IN (3, 17)")
def F3_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two pull requests."""
    return _runs(spark, sf_dir, Filter(prs=(3, 17)))


@query("SELECT repo, run_id FROM ci_runs r WHERE EXISTS (SELECT 1 FROM ci_runs o WHERE o.repo = r.repo AND o.workflow_id = r.workflow_id AND o.workflow_name = 'old-wf4')")
def F4_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the workflow that ever had a name."""
    return _runs(spark, sf_dir, Filter(workflows=("old-wf4",)))


@query("SELECT repo, run_id FROM ci_runs WHERE event IN ('schedule', 'pull_request')")
def F5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by event."""
    return _runs(spark, sf_dir, Filter(events=("schedule", "pull_request")))


@query("SELECT r.repo, r.run_id FROM ci_runs r JOIN ci_attempts a ON a.run_id = r.run_id AND a.attempt = a.latest WHERE a.conclusion IN ('cancelled', 'success')")
def F6_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose latest attempt concluded so."""
    return _runs(spark, sf_dir, Filter(conclusions=("cancelled", "success")))


@query("SELECT run_id, job_id FROM ci_jobs WHERE name GLOB 'job[!12]' OR name GLOB '*b1'")
def F7_job_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by globs on their names."""
    return units(ci_tables(spark, sf_dir), Filter(jobs=("job[^12]", "*b1")), "job").select("run_id", "job_id")


@query(
    "SELECT run_id, attempt FROM ci_attempts WHERE run_started_at >= TIMESTAMP '1994-03-01 00:00:01' AND run_started_at <= TIMESTAMP '1996-06-30 12:00:00' "
    "AND EXISTS (SELECT 1 FROM ci_jobs j WHERE j.run_id = ci_attempts.run_id AND j.attempt = ci_attempts.attempt AND j.name = 'job1')"
)
def F8_F9_F10_attempt_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that started in a span and hold a job."""
    return units(ci_tables(spark, sf_dir), Filter(jobs=("job1",), since=SINCE, until=UNTIL), "attempt").select("run_id", "attempt")


@query("SELECT repo, run_id FROM ci_runs WHERE workflow_id % 3 = 1")
def F13_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by more values than stand in a plan."""
    return _runs(spark, sf_dir, Filter(workflows=tuple(f"wf{i}" for i in range(1, 6000, 3))))


@query(
    "SELECT r.repo, r.run_id, a.conclusion AS latest_conclusion FROM ci_runs r LEFT JOIN ci_attempts a ON a.run_id = r.run_id AND a.attempt = a.latest"
)
def P10_latest_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each run's latest attempt concluded."""
    return latest_conclusion(ci_tables(spark, sf_dir)).select("repo", "run_id", "latest_conclusion")


@query(
    "SELECT repo, run_id FROM ci_runs WHERE event NOT IN ('pull_request', 'pull_request_target') AND NOT EXISTS (SELECT 1 FROM ci_attempts a WHERE a.run_id = ci_runs.run_id AND a.attempt = a.latest AND a.conclusion = 'cancelled')"
)
def F14_counted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that intermittent detection counts."""
    return flakes.counted_runs(ci_tables(spark, sf_dir), Filter()).select("repo", "run_id")


# Paths ---------------------------------------------------------------------------------------------------------------


@query(
    "SELECT concat(j.path, '/log.txt') AS path FROM ci_jobs j JOIN ci_runs r ON r.run_id = j.run_id JOIN ci_attempts a ON a.run_id = j.run_id AND a.attempt = j.attempt "
    "WHERE j.kind = 'ran' AND j.conclusion = 'failure' AND r.head_branch = 'main' AND NOT r.from_fork AND a.run_started_at >= TIMESTAMP '1994-03-01 00:00:01' "
    "UNION ALL SELECT concat(f.path, '/artifact.zip') FROM ci_artifacts f JOIN ci_runs r ON r.run_id = f.run_id JOIN ci_attempts a ON a.run_id = r.run_id AND a.attempt = a.latest "
    "WHERE a.conclusion = 'failure' AND r.head_branch = 'main' AND NOT r.from_fork AND f.created_at >= TIMESTAMP '1994-03-01 00:00:01'"
)
def Q1_U1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs and archives that a filter selects."""
    return paths.paths(ci_tables(spark, sf_dir), Filter(branches=("main",), conclusions=("failure",), since=SINCE), ("log", "artifact")).select("path")


@query("SELECT concat(path, '/', f) AS path FROM ci_attempts, (VALUES ('attempt.json'), ('jobs.json'), ('artifacts.json'), ('fetch.json')) t(f) WHERE conclusion = 'cancelled'")
def S8_attempt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the cancelled attempts."""
    return paths.paths(ci_tables(spark, sf_dir), Filter(conclusions=("cancelled",)), ("attempt",)).select("path")


# Flakes --------------------------------------------------------------------------------------------------------------

_SEEN = """
, seen AS (SELECT run_id, attempt, job_id, name AS job, '' AS step, -1 AS pos, conclusion, kind FROM ci_jobs
  UNION ALL SELECT s.run_id, s.attempt, s.job_id, j.name, s.name, s.number, s.conclusion, j.kind FROM ci_steps s JOIN ci_jobs j ON j.job_id = s.job_id),
marked AS (SELECT *, kind = 'ran' AND conclusion IN ('failure', 'cancelled', 'timed_out') AS bad, kind = 'ran' AND conclusion = 'success' AS good,
  kind = 'carried_forward' AND conclusion IN ('failure', 'cancelled', 'timed_out') AS void FROM seen),
outcome AS (SELECT run_id, job, step, attempt, CASE WHEN bool_or(bad) THEN arg_min(conclusion, job_id * 10 + pos) FILTER (bad) WHEN bool_or(good) AND NOT bool_or(void) THEN 'success' END AS outcome
  FROM marked WHERE kind IN ('ran', 'carried_forward') GROUP BY ALL)
"""


def _sql(text: str, extra: str = _SEEN) -> str:
    return with_views("@@" + text).replace("\n@@", extra)


@query()
def A1_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each job and step of an attempt."""
    t = ci_tables(spark, sf_dir)
    return flakes.outcomes(flakes.observations(t.jobs, t.steps)).where("outcome is not null").select("run_id", "job", "step", "attempt", "outcome")


ORACLE_SQL["A1_outcomes"] = _sql("SELECT run_id, job, step, attempt, outcome FROM outcome WHERE outcome IS NOT NULL")


@query()
def Q2_A2_rerun_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and steps that flip on a re-run, with outcomes, failing steps and the number of logs."""
    found = flakes.rerun_flips(ci_tables(spark, sf_dir))
    told = F.array_join(F.transform("outcomes", lambda x: F.concat(x["attempt"], F.lit(":"), x["conclusion"])), " ")
    return found.select("repo", "run_id", "head_sha", "job", "step", told.alias("outcomes"), F.array_join("failing_steps", ",").alias("failing_steps"), F.size("logs").alias("n_logs"))


ORACLE_SQL["Q2_A2_rerun_flips"] = _sql("""
, flips AS (SELECT run_id, job, step, string_agg(concat(attempt, ':', outcome), ' ' ORDER BY attempt) AS outcomes FROM outcome WHERE outcome IS NOT NULL
  GROUP BY ALL HAVING bool_or(outcome = 'success') AND bool_or(outcome <> 'success')),
bad_steps AS (SELECT run_id, job, string_agg(step, ',' ORDER BY a, k) AS failing_steps FROM
  (SELECT run_id, job, step, min(attempt) AS a, min(attempt * 1000000000000 + job_id * 10 + pos) AS k FROM marked WHERE bad AND step <> '' GROUP BY ALL) GROUP BY ALL),
logs AS (SELECT m.run_id, m.job, m.step, count(DISTINCT m.job_id) AS n_logs FROM marked m JOIN outcome o ON o.run_id = m.run_id AND o.job = m.job AND o.step = m.step AND o.attempt = m.attempt
  JOIN (SELECT run_id, job, step, attempt, bool_or(void) AS void FROM marked GROUP BY ALL) v ON v.run_id = m.run_id AND v.job = m.job AND v.step = m.step AND v.attempt = m.attempt
  WHERE m.bad OR (m.good AND NOT v.void) GROUP BY ALL)
SELECT r.repo, f.run_id, r.head_sha, f.job, f.step, f.outcomes, CASE WHEN f.step = '' THEN coalesce(b.failing_steps, '') ELSE '' END AS failing_steps, CAST(l.n_logs AS INTEGER) AS n_logs
FROM flips f JOIN ci_runs r ON r.run_id = f.run_id LEFT JOIN bad_steps b ON b.run_id = f.run_id AND b.job = f.job LEFT JOIN logs l ON l.run_id = f.run_id AND l.job = f.job AND l.step = f.step
""")

@query()
def K3_O2_flip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report on flips."""
    return sinks.flip_text(flakes.rerun_flips(ci_tables(spark, sf_dir)))


ORACLE_SQL["K3_O2_flip_text"] = (
    "SELECT concat('run ', run_id, ' (sha ', substring(head_sha, 1, 7), '): \"', job, '\"', CASE WHEN step <> '' THEN concat(' / \"', step, '\"') ELSE '' END, ': ', outcomes, "
    f"CASE WHEN failing_steps <> '' THEN concat('; failing steps: \"', replace(failing_steps, ',', '\", \"'), '\"') ELSE '' END) AS value FROM ({ORACLE_SQL['Q2_A2_rerun_flips']}) AS flip"
)

_SERIES = """
, counted AS (SELECT r.* FROM ci_runs r LEFT JOIN ci_attempts a ON a.run_id = r.run_id AND a.attempt = a.latest WHERE r.event NOT IN ('pull_request', 'pull_request_target') AND r.head_branch = 'main' AND NOT r.from_fork AND a.conclusion IS DISTINCT FROM 'cancelled'),
seen AS (SELECT run_id, attempt, job_id, name AS job, '' AS step, -1 AS pos, conclusion, kind FROM ci_jobs
  UNION ALL SELECT s.run_id, s.attempt, s.job_id, j.name, s.name, s.number, s.conclusion, j.kind FROM ci_steps s JOIN ci_jobs j ON j.job_id = s.job_id),
firsts AS (SELECT c.repo, c.workflow_id, c.head_branch, c.workflow_name, s.job, s.step, s.run_id, a.run_started_at AS start, s.conclusion, s.job_id, s.pos FROM seen s JOIN counted c ON c.run_id = s.run_id
  JOIN ci_attempts a ON a.run_id = s.run_id AND a.attempt = 1 AND a.conclusion <> 'cancelled' WHERE s.attempt = 1 AND s.kind = 'ran' AND s.conclusion IN ('success', 'failure', 'cancelled', 'timed_out')),
own AS (SELECT repo, workflow_id, head_branch, job, step, run_id, start, CASE WHEN bool_or(conclusion <> 'success') THEN arg_min(conclusion, job_id * 10 + pos) FILTER (conclusion <> 'success') ELSE 'success' END AS conclusion FROM firsts GROUP BY ALL),
missing AS (SELECT c.* FROM counted c WHERE NOT EXISTS (SELECT 1 FROM ci_attempts a WHERE a.run_id = c.run_id AND a.attempt = 1)),
series AS (SELECT * FROM own UNION ALL SELECT k.repo, k.workflow_id, k.head_branch, k.job, k.step, m.run_id, m.created_at, '' FROM (SELECT DISTINCT repo, workflow_id, head_branch, job, step FROM own) k
  JOIN missing m ON m.repo = k.repo AND m.workflow_id = k.workflow_id AND m.head_branch = k.head_branch),
around AS (SELECT *, lag(conclusion) OVER w AS b, lead(conclusion) OVER w AS a, count(*) OVER (PARTITION BY repo, workflow_id, head_branch, job, step) AS runs FROM series
  WINDOW w AS (PARTITION BY repo, workflow_id, head_branch, job, step ORDER BY start, run_id))
"""


@query()
def J8_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted runs on main whose first attempt is missing."""
    return flakes.gaps(ci_tables(spark, sf_dir), Filter(branches=("main",))).select("repo", "run_id", "created_at")


ORACLE_SQL["J8_gaps"] = _sql("SELECT repo, run_id, created_at FROM missing", _SERIES)


@query()
def A5_A7_J22_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each series on main and its failures."""
    s = flakes.first_attempt_series(ci_tables(spark, sf_dir), Filter(branches=("main",)))
    return s.groupBy("repo", "workflow_id", "job", "step").agg((F.count("*") + F.max("gaps")).alias("runs"), F.count_if(flakes.failing(F.col("conclusion"))).alias("failures"), F.max("gaps").alias("gaps"))


ORACLE_SQL["A5_A7_J22_series"] = _sql("SELECT repo, workflow_id, job, step, count(*) AS runs, count(*) FILTER (conclusion NOT IN ('success', '')) AS failures, count(*) FILTER (conclusion = '') AS gaps FROM series GROUP BY ALL", _SERIES)


@query()
def Q3_W1_W2_intermittent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures alone between successes on main, since a time."""
    found = flakes.intermittent_failures(ci_tables(spark, sf_dir), Filter(branches=("main",), since=SINCE)).select("repo", "workflow_id", "workflow_name", "job", "step", "runs", F.explode("failures").alias("x"))
    return found.select("repo", "workflow_id", "workflow_name", "job", "step", "runs", F.col("x.run_id").alias("run_id"), F.col("x.conclusion").alias("conclusion"))


ORACLE_SQL["Q3_W1_W2_intermittent"] = _sql(
    """
SELECT x.repo, x.workflow_id, n.workflow_name, x.job, x.step, x.runs, x.run_id, x.conclusion FROM around x
JOIN (SELECT repo, workflow_id, job, step, arg_max(workflow_name, struct_pack(s := start, r := run_id, j := job_id, p := pos)) AS workflow_name FROM firsts GROUP BY ALL) n
  ON n.repo = x.repo AND n.workflow_id = x.workflow_id AND n.job = x.job AND n.step = x.step
WHERE x.conclusion NOT IN ('success', '') AND x.b = 'success' AND x.a = 'success'
  AND EXISTS (SELECT 1 FROM ci_attempts t WHERE t.run_id = x.run_id AND t.run_started_at >= TIMESTAMP '1994-03-01 00:00:01')""",
    _SERIES,
)


@query(
    "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS b, lead(event_type) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error' AND b <> 'error' AND a <> 'error'"
)
def W1_isolated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user alone between other events."""
    e = _table(spark, sf_dir, "events").withColumn("conclusion", F.when(F.col("event_type") == "error", "failure").otherwise("success"))
    return flakes.isolated(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query()
def Q4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of findings on main."""
    return flakes.findings(ci_tables(spark, sf_dir), Filter(branches=("main",))).groupBy("kind", "job").agg(F.count("*").alias("n"))


ORACLE_SQL["Q4_findings"] = with_views(
    "SELECT * FROM (WITH " + _SEEN.strip()[1:] + """
SELECT 'rerun' AS kind, f.job, count(*) AS n FROM (SELECT run_id, job, step FROM outcome WHERE outcome IS NOT NULL GROUP BY ALL HAVING bool_or(outcome = 'success') AND bool_or(outcome <> 'success')) f
  JOIN ci_runs r ON r.run_id = f.run_id WHERE r.head_branch = 'main' AND NOT r.from_fork GROUP BY ALL)
UNION ALL SELECT * FROM (WITH """ + _SERIES.strip()[1:] + """
SELECT 'intermittent' AS kind, job, count(*) AS n FROM around WHERE conclusion NOT IN ('success', '') AND b = 'success' AND a = 'success' GROUP BY ALL)"""
)


@query("SELECT kind, conclusion, count(*) AS n FROM ci_jobs GROUP BY ALL")
def A14_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by kind and conclusion."""
    return ci_tables(spark, sf_dir).jobs.groupBy("kind", "conclusion").agg(F.count("*").alias("n"))


@query("SELECT r.head_sha, count(*) AS attempts, count(*) FILTER (a.conclusion = 'failure') AS failed FROM ci_attempts a JOIN ci_runs r ON r.run_id = a.run_id GROUP BY ALL")
def A19_attempts_per_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each commit."""
    t = ci_tables(spark, sf_dir)
    return t.attempts.join(t.runs.select(*RUN, "head_sha"), RUN).groupBy("head_sha").agg(F.count("*").alias("attempts"), F.count_if(F.col("conclusion") == "failure").alias("failed"))


# Names ---------------------------------------------------------------------------------------------------------------

_SLUG = "CASE WHEN regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9.]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')[1:60], '[-.]+$', '') = '' THEN 'none' ELSE regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9.]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')[1:60], '[-.]+$', '') END"


@query(f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def N1_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of documents."""
    return _table(spark, sf_dir, "documents").select("doc_id", names.slug(F.col("text")).alias("slug"))


@query("SELECT job_id, run_id AS p_run, attempt AS p_attempt, job_id AS p_job, repo AS p_repo, 'log.txt' AS p_file FROM ci_jobs")
def N8_parse_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each log's path."""
    at = names.parse_location(F.concat_ws("/", "path", F.lit("log.txt")))
    return ci_tables(spark, sf_dir).jobs.select("job_id", at.alias("p")).select("job_id", F.col("p.run_id").alias("p_run"), F.col("p.attempt").alias("p_attempt"), F.col("p.job_id").alias("p_job"), F.col("p.repo").alias("p_repo"), F.col("p.file").alias("p_file"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[[:cntrl:]\t\n\x0B\f\r ]+', ' ', 'g'), ' ') AS line FROM documents")
def N18_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on one line."""
    return _table(spark, sf_dir, "documents").select("doc_id", names.one_line(F.col("text")).alias("line"))


# Search --------------------------------------------------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id AS path, lang, source, unnest(x) AS text, generate_subscripts(x, 1) AS line FROM (SELECT *, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS x FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents)))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id"))
    return search.lines(search.spread(docs.select("path", "lang", "source", "text")), "text", ("path", "lang", "source"))


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines")
def S5_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines."""
    return _lines(spark, sf_dir).select("path", "line", "text")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE regexp_matches(text, '(?i)error|license|\\bthe\\b.*[0-9]{{3,}}')")
def G1_G4_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match an expression."""
    return search.grep(_lines(spark, sf_dir), r"(?i)error|license|\bthe\b.*[0-9]{3,}").select("path", "line", "text")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE regexp_matches(text, '^[[:upper:]][a-c&&b\\p{{Greek}}ë-ü]{{1,2}}\\w*(?i:Th|st)[^[:^alpha:]]?[\\s,.]')")
def G4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match an expression with classes of every kind, and with case ignored in a part."""
    return search.grep(_lines(spark, sf_dir), r"^[[:upper:]][a-c&&b\p{Greek}ë-ü]{1,2}\w*(?i:Th|st)[^[:^alpha:]]?[\s,.]").select("path", "line", "text")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE regexp_matches(text, '(?i)(licen[sc]ed under|copyright|(?:permission is hereby )+granted)[^.]*')")
def G8_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match one of several branches, whose literals are looked for first in any case."""
    return search.grep(_lines(spark, sf_dir), r"(?i)(licen[sc]ed under|copyright|(?:permission is hereby )+granted)[^.]*").select("path", "line", "text")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE contains(text, 'of the.')")
def G2_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a string."""
    return search.grep(_lines(spark, sf_dir), "of the.", fixed=True).select("path", "line", "text")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE contains(lower(text), 'apache license')")
def G3_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a string in any case."""
    return search.grep(_lines(spark, sf_dir), "APACHE license", fixed=True, ignore_case=True).select("path", "line", "text")


@query(f"WITH {_LINES} SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '[0-9]{{3,}}')")
def G7_files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a match."""
    return search.files_with_matches(search.grep(_lines(spark, sf_dir), "[0-9]{3,}"))


@query(
    f"WITH {_LINES}, hits AS (SELECT path, line FROM lines WHERE regexp_matches(text, '[0-9]{{3,}}')), near AS (SELECT path, l AS line, bool_or(l = line) AS is_hit FROM (SELECT path, line, unnest(range(line - 1, line + 2)) AS l FROM hits) GROUP BY ALL) "
    "SELECT n.path, CAST(n.line AS INTEGER) AS line, n.is_hit, l.text FROM near n JOIN lines l ON l.path = n.path AND l.line = n.line"
)
def G11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the lines around them."""
    all_lines = _lines(spark, sf_dir)
    return search.with_context(all_lines, search.grep(all_lines, "[0-9]{3,}"), 1).select("path", "line", "is_hit", "text")


@query(f"WITH {_LINES} SELECT text, count(*) AS n FROM lines WHERE contains(text, ' the ') GROUP BY ALL ORDER BY n DESC, text LIMIT 20")
def A15_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent matching lines."""
    return search.top_lines(search.grep(_lines(spark, sf_dir), " the ", fixed=True), 20)


@query(f"WITH {_LINES} SELECT source, min(path) AS first_seen, max(path) AS last_seen, count(DISTINCT lang) AS runs FROM lines WHERE contains(text, 'License') GROUP BY ALL")
def A16_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last match per source."""
    return search.first_and_last_seen(search.grep(_lines(spark, sf_dir), "License", fixed=True), "source", "path", "lang")


@query(f"WITH {_LINES}, f AS (SELECT path, count(*) FILTER (regexp_matches(text, 'ing[.]$')) AS hits FROM lines GROUP BY ALL) SELECT count(*) AS files, count(*) FILTER (hits > 0) AS files_with_hits, CAST(sum(hits) AS BIGINT) AS hits, sum(hits) = 0 AS no_match FROM f")
def A17_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a search."""
    return search.summary(_lines(spark, sf_dir), "ing[.]$")


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, CAST(line AS INTEGER) AS verified_line FROM lines WHERE regexp_matches(text, '[0-9]{{3,}}') AND line > 1")
def G12_verify_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits found at their lines again."""
    all_lines = _lines(spark, sf_dir)
    hits = search.grep(all_lines, "[0-9]{3,}").where("line > 1").select("path", "line", "text")
    return search.verified(hits, all_lines).select("path", "line", "verified_line")


# Derivations ---------------------------------------------------------------------------------------------------------


@query(
    "SELECT job_id, CASE WHEN s < r THEN 'carried_forward' WHEN n = 0 AND runner IS NULL THEN 'not_applicable' ELSE 'ran' END AS kind FROM (SELECT j.job_id, j.started_at AS s, a.run_started_at AS r, "
    "(SELECT count(*) FROM ci_steps x WHERE x.job_id = j.job_id) AS n, CASE WHEN j.runner_name = 'runner1' THEN j.runner_name END AS runner FROM ci_jobs j JOIN ci_attempts a ON a.run_id = j.run_id AND a.attempt = j.attempt)"
)
def P5_job_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each job from its times, steps and runner."""
    t = ci_tables(spark, sf_dir)
    steps = t.steps.groupBy("job_id").agg(F.count("*").alias("n"))
    both = t.jobs.join(t.attempts.select(*RUN, "attempt", "run_started_at"), [*RUN, "attempt"]).join(steps, "job_id", "left")
    runner = F.when(F.col("runner_name") == "runner1", F.col("runner_name"))
    return both.select("job_id", derive.job_kind(F.col("started_at"), F.col("run_started_at"), F.coalesce("n", F.lit(0)), runner).alias("kind"))


@query("SELECT run_id, artifact_id, CASE WHEN artifact_id % 5 = 0 THEN 'expired' WHEN size > 1500 THEN 'too_large' ELSE 'download' END AS action FROM ci_artifacts")
def P7_artifact_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each artifact."""
    return ci_tables(spark, sf_dir).artifacts.select("run_id", "artifact_id", derive.artifact_action(F.col("artifact_id") % 5 == 0, F.col("size"), 1500).alias("action"))


@query(
    "SELECT c.run_id, c.job_id, (SELECT arg_max(o.job_id, o.attempt * 1000000000000 - o.job_id) FROM ci_jobs o WHERE o.run_id = c.run_id AND o.name = c.name AND o.kind <> 'carried_forward' AND o.attempt < c.attempt "
    "AND o.started_at IS NOT DISTINCT FROM c.started_at AND o.runner_name IS NOT DISTINCT FROM c.runner_name) AS original_job_id FROM ci_jobs c WHERE c.kind = 'carried_forward'"
)
def J9_match_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original of each job carried forward."""
    return derive.match_originals(ci_tables(spark, sf_dir).jobs).select("run_id", "job_id", "original_job_id")


@query()
def J10_J11_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt that made each artifact, and how that is known."""
    t = ci_tables(spark, sf_dir)
    made = t.artifacts.where("run_id % 2 = 0")
    both = t.attempts.where("run_id % 2 = 0").select(*RUN, "attempt").join(made.select(*RUN, "artifact_id", "made_in"), RUN, "left")
    listed = both.groupBy(*RUN, "attempt").agg(F.collect_list(F.when(F.col("made_in") <= F.col("attempt"), F.col("artifact_id"))).alias("artifact_ids")).withColumn("own", F.lit(True))
    return derive.attribute_artifacts(t.artifacts, t.attempts, listed).select("run_id", "artifact_id", "attributed_attempt", "attribution")


ORACLE_SQL["J10_J11_attribution"] = with_views("""
, arts AS MATERIALIZED (SELECT run_id, artifact_id, created_at, made_in FROM ci_artifacts),
known AS MATERIALIZED (SELECT run_id, attempt, run_started_at, lag(attempt) OVER w AS prev, lead(attempt) OVER w AS nxt, lead(run_started_at) OVER w AS until FROM ci_attempts WINDOW w AS (PARTITION BY run_id ORDER BY attempt)),
a AS (SELECT f.run_id, f.artifact_id, CASE WHEN f.run_id % 2 = 0 AND k.prev = k.attempt - 1 THEN k.attempt END AS l FROM arts f JOIN known k ON k.run_id = f.run_id AND k.attempt = f.made_in),
t AS (SELECT f.run_id, f.artifact_id, max(k.attempt) AS t FROM arts f JOIN known k ON k.run_id = f.run_id AND f.created_at >= k.run_started_at AND (k.nxt IS NULL OR (k.nxt = k.attempt + 1 AND f.created_at < k.until)) GROUP BY ALL)
SELECT a.run_id, a.artifact_id, coalesce(a.l, t.t) AS attributed_attempt, CASE WHEN a.l IS NOT NULL THEN 'listing-diff' WHEN t.t IS NOT NULL THEN 'timestamp' ELSE 'unknown' END AS attribution
FROM a LEFT JOIN t ON t.run_id = a.run_id AND t.artifact_id = a.artifact_id""")


@query(
    "SELECT r.run_id, string_agg(DISTINCT CAST(p.number AS VARCHAR), ',' ORDER BY CAST(p.number AS VARCHAR)) AS numbers FROM ci_runs r JOIN (SELECT md5(concat('', c_custkey * 3)) AS head_sha, c_custkey % 50 AS number, 'main' AS head_ref, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS head_repo_id FROM customer) p "
    "ON p.head_sha = r.head_sha AND p.head_ref = r.head_branch WHERE CASE WHEN p.head_repo_id IS NULL THEN r.from_fork ELSE p.head_repo_id = 1 + r.run_id % 3 END GROUP BY r.run_id"
)
def J12_match_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of each run by its commit."""
    key = F.col("c_custkey")
    pulls = _table(spark, sf_dir, "customer").select(F.md5((key * 3).cast("string").cast("binary")).alias("head_sha"), (key % 50).alias("number"), F.lit("main").alias("head_ref"), F.when(key % 4 > 0, key % 4).alias("head_repo_id"))
    runs = ci_tables(spark, sf_dir).runs.withColumn("head_repo_id", 1 + F.col("run_id") % 3)
    found = derive.match_pulls(runs, pulls)
    return found.select("run_id", F.array_join(F.array_sort(F.transform("pr_numbers", lambda x: x.cast("string"))), ",").alias("numbers"))


# Retention -----------------------------------------------------------------------------------------------------------

_KEPT = """
r AS (SELECT concat('app', o_custkey % 3) AS repo, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS d, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) // 4 ELSE 0 END AS x FROM orders),
kept AS (SELECT * FROM r WHERE d >= DATE '1996-01-01'),
t AS (SELECT *, (SELECT sum(b) FROM kept) - coalesce(sum(x) OVER (ORDER BY d, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM kept WHERE x > 0),
trees AS (SELECT * FROM t WHERE left_ > 400000000 * (SELECT count(*) FROM kept) // 4000),
n AS (SELECT k.repo, k.run_id, k.d, k.created_at, k.b - coalesce(e.x, 0) AS nb FROM kept k LEFT JOIN trees e ON e.run_id = k.run_id),
s AS (SELECT *, (SELECT sum(nb) FROM n) - coalesce(sum(nb) OVER (ORDER BY d, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM n),
gone AS (SELECT * FROM s WHERE left_ > 400000000 * (SELECT count(*) FROM kept) // 4000),
h AS (SELECT repo, max(created_at) AS horizon FROM gone GROUP BY ALL)
"""


def _retention_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("bigint")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("app"), F.col("o_custkey") % 3).alias("repo"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("dir"), F.to_date("o_orderdate").alias("date_dir"),
        F.col("o_orderdate").alias("created_at"), price.alias("bytes"), F.when(F.col("o_orderkey") % 3 == 0, F.expr("cast(floor(o_totalprice) as bigint) div 4")).otherwise(F.lit(0)).alias("extracted_bytes"),
    )


@query(
    f"WITH {_KEPT} SELECT repo, run_id, 1 AS phase, b AS bytes FROM r WHERE d < DATE '1996-01-01' UNION ALL SELECT repo, run_id, 2, x FROM trees UNION ALL SELECT repo, run_id, 3, nb FROM gone "
    "UNION ALL SELECT s.repo, s.run_id, 4, s.nb FROM s JOIN h ON h.repo = s.repo WHERE s.created_at <= h.horizon AND s.run_id NOT IN (SELECT run_id FROM gone)"
)
def Q8_R1_R4_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Victims of retention under a cap of 100 000 bytes a kept run."""
    runs = _retention_runs(spark, sf_dir)
    kept = runs.where(F.col("date_dir") >= date(1996, 1, 1)).count()
    return retention.plan_retention(runs, date(1996, 1, 1), 400_000_000 * kept // 4000).select("repo", "run_id", "phase", "bytes")


@query("SELECT o_orderkey AS run_id, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def W4_running_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all runs before each run."""
    return retention.running_before(_retention_runs(spark, sf_dir), "bytes").select("run_id", "before")


@query(
    "SELECT r.repo, count(*) AS runs, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS attempts, CAST(sum(CAST(r.price AS BIGINT)) AS BIGINT) AS bytes, max(CASE WHEN a.n > 0 THEN r.created_at END) AS newest_completed FROM ci_runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM ci_attempts GROUP BY ALL) a ON a.run_id = r.run_id GROUP BY r.repo"
)
def A10_store_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each repository holds."""
    runs = ci_view(spark, sf_dir, "ci_runs").withColumn("bytes", F.col("price").cast("bigint"))
    return retention.store_measure(runs, ci_tables(spark, sf_dir).attempts)


# Ingest and freshness ------------------------------------------------------------------------------------------------


@query(
    "SELECT w.run_id, w.attempt FROM (SELECT run_id, unnest(range(1, CASE WHEN run_id % 4 = 0 THEN 3 ELSE 4 END)) AS attempt FROM ci_runs) w WHERE NOT EXISTS (SELECT 1 FROM ci_attempts a WHERE a.run_id = w.run_id AND a.attempt = w.attempt)"
)
def J14_missing_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to fetch of runs listed with three."""
    t = ci_tables(spark, sf_dir)
    listed = t.runs.select(*RUN, F.lit(3).alias("run_attempt"), F.when(F.col("run_id") % 4 == 0, "in_progress").otherwise("completed").alias("status"))
    return ingest.missing_attempts(listed, t.attempts, RUN).select("run_id", "attempt")


@query(
    "SELECT run_id, artifact_id, min_by(src, prio) AS src FROM (SELECT run_id, artifact_id, 'listing' AS src, 0 AS prio FROM ci_artifacts WHERE artifact_id % 3 = 0 UNION ALL SELECT run_id, artifact_id, 'pending', 1 FROM ci_artifacts WHERE artifact_id % 2 = 0 "
    "UNION ALL SELECT run_id, artifact_id, concat('snapshot', made_in), 1 + made_in FROM ci_artifacts) WHERE artifact_id % 7 > 0 GROUP BY ALL"
)
def J15_U3_retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts to fetch, and which source named them first."""
    a = ci_tables(spark, sf_dir).artifacts.withColumns({"pos": F.col("artifact_id"), "attempt": F.col("made_in")})
    snapshots = a.withColumn("name", F.concat(F.lit("snapshot"), "made_in"))
    found = ingest.retry_artifacts(a.where("artifact_id % 3 = 0").withColumn("name", F.lit("listing")), a.where("artifact_id % 2 = 0").withColumn("name", F.lit("pending")), snapshots, a.where("artifact_id % 7 = 0"), RUN)
    return found.select("run_id", "artifact_id", F.col("name").alias("src"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM (SELECT * FROM events WHERE event_type <> 'view') GROUP BY user_id UNION ALL SELECT user_id, arg_min(event_type, event_id) FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'view') GROUP BY user_id")
def W6_U2_merge_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each user over two listings."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("pos"))
    return ingest.merge_listings([e.where("event_type <> 'view'"), e], ["user_id"])


@query("SELECT event_type AS repo, event_id AS run_id, CASE WHEN ts > TIMESTAMP '2100-01-01 00:00:00' OR event_id % 3 > 0 THEN TIMESTAMP '2100-01-01 00:00:00' ELSE ts END AS since FROM events WHERE event_id % 2 = 0")
def J18_pending_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since when units are pending."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.col("event_id").alias("run_id"), F.lit("log").alias("unit"), F.col("event_id").alias("pos"), F.lit("timed\nout").alias("error"), F.col("ts").alias("since"))
    return freshness.pending_since(e.where("run_id % 2 = 0"), e.where("run_id % 3 = 0"), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).select("repo", "run_id", "since")


@query("SELECT user_id % 10 AS repo, count(*) AS stuck, min(ts) AS oldest FROM events WHERE epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(ts) > 2 * 1000000 * CAST(864000 AS BIGINT) GROUP BY ALL")
def A12_stuck_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units pending for more than twice the interval."""
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("repo"), F.col("ts").cast("timestamp").alias("since"))
    repos = e.select("repo").distinct().withColumn("sync_interval", F.lit(864000))
    found = freshness.stuck(e, repos, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return found.select("repo", "stuck", F.col("oldest").cast("timestamp_ntz").alias("oldest"))


@query("SELECT o_custkey AS run_id, CASE WHEN bool_or(o_orderkey % 5 = 0) AND NOT bool_or(o_orderkey % 5 > 0) THEN 'removed' ELSE 'changed' END AS change FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)")
def J20_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose units differ from what is indexed."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("path"), "o_orderkey", F.col("o_orderdate").alias("modified"))
    newer = o.where("o_orderkey % 5 > 0").withColumn("modified", F.when(F.col("o_orderkey") % 7 == 0, F.col("modified") + F.expr("interval 1 hour")).otherwise(F.col("modified")))
    return freshness.reconcile(newer, o, ["run_id"])


@query("SELECT run_id, attempt, bool_and(kind = 'ran') AS complete FROM ci_jobs GROUP BY ALL")
def T10_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts all of whose jobs are over."""
    jobs = ci_tables(spark, sf_dir).jobs.withColumn("status", F.when(F.col("kind") == "ran", "completed"))
    return ingest.publishable(jobs, ["run_id", "attempt"])
