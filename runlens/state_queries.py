"""Queries over the state of ingest, derivations and names, beside the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import derive, flakes, freshness, ingest, paths, retention, search, where
from .plans.ci_view import ci_tables, with_views
from .plans.filters import Filter
from .queries import ORACLE_SQL, _runs, _table, query
from .schema import RUN, Tables

_NOW = "1997-01-01 12:00:00"


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# Filters with very many values ---------------------------------------------------------------------------------------


@query("SELECT repo, run_id FROM ci_runs WHERE head_sha[1:5] IN (SELECT md5(CAST(i * 7 AS VARCHAR))[1:5] FROM range(2000) t(i))")
def F13_many_shas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by two thousand beginnings of commits."""
    return _runs(spark, sf_dir, Filter(shas=tuple(md5(str(i * 7).encode()).hexdigest()[:5].upper() for i in range(2000))))


@query("SELECT repo, run_id FROM ci_runs WHERE pr % 3 = 0 AND pr > 0")
def F13_many_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by two thousand pull requests."""
    return _runs(spark, sf_dir, Filter(prs=tuple(range(3, 6003, 3))))


@query("SELECT run_id, job_id FROM ci_jobs WHERE name IN ('job0', 'job2')")
def F13_many_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by two thousand globs."""
    from .plans.filters import units

    globs = tuple(f"other-{i}*" for i in range(1998)) + ("job0", "?ob2")
    return units(ci_tables(spark, sf_dir), Filter(jobs=globs), "job").select("run_id", "job_id")


# Derivations ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS run_id, NOT coalesce(CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 3 END = o_orderkey % 3, false) AS from_fork FROM orders")
def P6_from_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the head repository is another one or missing."""
    head = F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 3)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), derive.from_fork(head, F.col("o_orderkey") % 3).alias("from_fork"))


_DIGEST = (
    "CASE doc_id % 7 WHEN 0 THEN concat('sha256:', sha256(coalesce(text, ''))) WHEN 1 THEN concat('SHA256:', upper(sha256(coalesce(text, '')))) WHEN 2 THEN concat('md5:', md5(coalesce(text, ''))) "
    "WHEN 3 THEN 'md5:zz' WHEN 4 THEN 'sha256:12ab' WHEN 5 THEN 'md5:' ELSE '' END"
)


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN sha256(coalesce(text, '')) ELSE '' END AS sha256, doc_id % 7 IN (3, 4, 5) AS malformed, true AS holds FROM (SELECT *, {_DIGEST} AS digest FROM documents)"
)
def P8_P9_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in several forms, and whether the content has them."""
    content = F.coalesce("text", F.lit(""))
    sha, k = F.sha2(content, 256), F.col("doc_id") % 7
    digest = F.when(k == 0, F.concat(F.lit("sha256:"), sha)).when(k == 1, F.concat(F.lit("SHA256:"), F.upper(sha))).when(k == 2, F.concat(F.lit("md5:"), F.md5(content)))
    digest = digest.when(k == 3, "md5:zz").when(k == 4, "sha256:12ab").when(k == 5, "md5:").otherwise("")
    read = _table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), derive.digest_sha256(digest).alias("d"))
    return read.select("doc_id", "d.sha256", "d.malformed", derive.digest_holds(F.col("content").cast("binary"), F.col("d.sha256")).alias("holds"))


_LATE = "TIMESTAMP '1997-01-01 12:00:00' > o_orderdate + INTERVAL 30 DAY"


@query(
    f"SELECT o_orderkey AS run_id, CASE WHEN s = 410 THEN 'expired' WHEN s = 404 AND {_LATE} THEN 'deleted' WHEN s = 404 THEN 'retry' ELSE 'error' END AS log, "
    f"CASE WHEN s = 410 THEN 'expired' WHEN s = 404 AND (o_custkey % 2 = 0 OR {_LATE}) THEN 'deleted' WHEN s = 404 THEN 'retry' ELSE 'error' END AS zip "
    "FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 410 WHEN 1 THEN 404 ELSE 500 END AS s FROM orders)"
)
def P12_P13_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed fetch of a log and of an archive means."""
    k = F.col("o_orderkey") % 3
    status, hop, now = F.when(k == 0, 410).when(k == 1, 404).otherwise(500), F.when(F.col("o_custkey") % 2 == 0, "api").otherwise("blob"), _time(_NOW)
    at = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), derive.log_loss(status, hop, at, "30 days", now).alias("log"), derive.zip_loss(status, hop, at, "30 days", now).alias("zip"))


@query(
    "SELECT run_id, max(attempt) AS latest_attempt, arg_max(conclusion, attempt) AS conclusion FROM ci_attempts WHERE run_id % 4 > 0 GROUP BY run_id "
    "UNION ALL SELECT run_id, NULL, arg_max(name, artifact_id) FROM ci_artifacts WHERE run_id % 4 = 0 GROUP BY run_id"
)
def P2_U6_run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of runs from their latest attempt, else from the artifact fetched last."""
    t = ci_tables(spark, sf_dir)
    artifacts = t.artifacts.select(*RUN, "artifact_id", F.lit(0).alias("fetched_at"), F.col("name").alias("conclusion"))
    return derive.run_facts(t.attempts.where("run_id % 4 > 0"), artifacts, ["conclusion"]).select("run_id", "latest_attempt", "conclusion")


@query("SELECT run_id, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS numbers FROM (SELECT run_id, unnest([pr % 7, pr % 5]) AS n FROM ci_runs WHERE pr IS NOT NULL) GROUP BY run_id")
def P11_pr_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pull requests of each run over several lists."""
    runs = ci_tables(spark, sf_dir).runs.where(F.size("pr_numbers") > 0)
    parts = runs.select(*RUN, F.transform("pr_numbers", lambda x: x % 7).alias("numbers")).unionByName(runs.select(*RUN, F.transform("pr_numbers", lambda x: x % 5).alias("numbers")))
    return derive.pr_numbers(parts).select("run_id", F.array_join(F.array_sort(F.transform("pr_numbers", lambda x: x.cast("string"))), ",").alias("numbers"))


# Names ---------------------------------------------------------------------------------------------------------------


@query(
    "SELECT j.job_id, concat('ci.example/', r.repo, '/runs/', strftime(r.created_at, '%Y-%m-%d'), '/', r.run_id, '_', r.workflow_name, '_', replace(r.head_branch, '/', '-'), '/attempt-', j.attempt, '/jobs/', j.job_id, '_', j.name) AS job_dir, "
    "concat('ci.example/', r.repo, '/runs/', strftime(r.created_at, '%Y-%m-%d'), '/', r.run_id, '_', r.workflow_name, '_', replace(r.head_branch, '/', '-'), '/artifacts/', j.job_id, '_none') AS artifact_dir, r.head_sha[1:7] AS sha "
    "FROM ci_jobs j JOIN ci_runs r ON r.run_id = j.run_id"
)
def N2_N4_N28_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of jobs and of artifacts of the same number."""
    t = ci_tables(spark, sf_dir)
    both = t.jobs.select("run_id", "attempt", "job_id", "name").join(t.runs.select("host", "repo", "run_id", "created_at", "workflow_name", "head_branch", "head_sha"), "run_id")
    run = names.run_dir(names.repo_dir(F.upper("host"), F.col("repo")), F.col("created_at"), F.col("run_id"), F.col("workflow_name"), F.lit("x.yml"), F.col("head_branch"))
    return both.withColumn("run", run).select(
        "job_id", names.job_dir(names.attempt_dir(F.col("run"), F.col("attempt")), F.col("job_id"), F.col("name")).alias("job_dir"), names.artifact_dir(F.col("run"), F.col("job_id"), F.lit("~~")).alias("artifact_dir"), names.short_sha(F.col("head_sha")).alias("sha")
    )


@query(
    "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN date_trunc('second', ts) END AS at, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS marker, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS told FROM events"
)
def N22_N23_log_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps and markers of log lines."""
    e = _table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 3 > 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0000000Z "))).otherwise(F.lit(""))
    line = F.concat(stamp, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("##["), "event_type", F.lit("]"))).otherwise(F.lit("##[]")), F.lit(" text"))
    return e.select("event_id", names.log_time(line).cast("timestamp_ntz").alias("at"), names.log_marker(line).alias("marker"), names.time_text(F.col("ts")).alias("told"))


@query("SELECT o_orderkey AS run_id, DATE '1997-01-01' - CAST(o_orderkey % 100 AS INTEGER) AS cut FROM orders")
def N16_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date that stays, by days of retention."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), retention.cutoff(_time(_NOW), (F.col("o_orderkey") % 100).cast("int")).alias("cut"))


_REPOS = "SELECT c_custkey AS repo, c_custkey % 40 + 1 AS retention_days, c_custkey % 9 AS backfill_days, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '1997-01-01 12:00:00' - to_hours(CAST(c_custkey % 700 AS INTEGER)) END AS listed_until FROM customer"


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    until = F.when(key % 5 > 0, _time(_NOW) - F.make_dt_interval(F.lit(0), (key % 700).cast("int")))
    return _table(spark, sf_dir, "customer").select(key.alias("repo"), (key % 40 + 1).cast("int").alias("retention_days"), (key % 9).cast("int").alias("backfill_days"), until.alias("listed_until"))


@query(
    f"SELECT repo, greatest(date_trunc('day', TIMESTAMP '1997-01-01 12:00:00' - to_days(CAST(retention_days AS INTEGER))), least(TIMESTAMP '1997-01-01 12:00:00' - to_days(CAST(backfill_days AS INTEGER)), coalesce(listed_until - INTERVAL 1 HOUR, TIMESTAMP '2100-01-01'))) AS list_from FROM ({_REPOS})"
)
def N17_T5_listing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin of each repository's next listing."""
    return ingest.listing_windows(_repos(spark, sf_dir), _time(_NOW)).select("repo", "list_from")


@query(
    f"SELECT repo, TIMESTAMP '1997-01-01 12:00:00' - to_days(CAST(least(30, retention_days) AS INTEGER)) AS rescan_from, TIMESTAMP '1997-01-01 12:00:00' - to_days(CAST(backfill_days AS INTEGER)) AS rescan_to FROM ({_REPOS}) "
    "WHERE backfill_days < least(30, retention_days) AND (listed_until IS NULL OR listed_until <= TIMESTAMP '1997-01-01 11:00:00')"
)
def N17_rescan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the repositories whose older runs are due to be listed again."""
    repos = _repos(spark, sf_dir).withColumnRenamed("listed_until", "rescanned_at")
    return ingest.rescan_windows(repos.withColumn("rescanned_at", F.col("rescanned_at").cast("timestamp")), F.lit(_NOW).cast("timestamp")).select("repo", F.col("rescan_from").cast("timestamp_ntz").alias("rescan_from"), F.col("rescan_to").cast("timestamp_ntz").alias("rescan_to"))


# Where ---------------------------------------------------------------------------------------------------------------


@query(
    "SELECT j.job_id, CASE WHEN j.job_id % 3 > 0 THEN j.job_id % 5 + 1 END AS line, CASE WHEN j.job_id % 3 > 0 THEN 'a: b-c' ELSE '007:x' END AS text, r.workflow_name, a.conclusion, j.conclusion AS job_conclusion "
    "FROM ci_jobs j JOIN ci_runs r ON r.run_id = j.run_id JOIN ci_attempts a ON a.run_id = j.run_id AND a.attempt = j.attempt WHERE j.kind = 'ran' AND j.run_id % 5 = 0"
)
def Q5_N9_J13_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in logs with their run, attempt and job."""
    t = ci_tables(spark, sf_dir)
    logs = t.jobs.where("kind = 'ran' and run_id % 5 = 0").select("job_id", F.concat("path", F.lit("/log.txt")).alias("path"))
    rest = F.when(F.col("job_id") % 3 > 0, F.concat(F.lit(":"), (F.col("job_id") % 5 + 1).cast("string"), F.lit(":a: b-c"))).otherwise(F.lit(":007:x"))
    found = where.parse_hits(logs.select(F.concat("path", rest).alias("hit")), logs)
    return where.describe(found, t).select("job_id", "line", "text", "workflow_name", "conclusion", "job_conclusion")


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents) SELECT doc_id, CASE WHEN x = '' OR doc_id % 4 = 0 THEN NULL ELSE 1 END AS line, "
    "CASE WHEN doc_id % 4 = 0 THEN 'no line holds the text' END AS reason FROM l WHERE x IS NOT NULL AND x <> ''"
)
def N24_G12_place_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as hits with a column number, a fourth of them with another text."""
    lines = search.lines(_table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")))
    first = lines.where("line = 1 and text <> ''")
    told = F.when(F.col("path").cast("int") % 4 == 0, F.lit("\x01 nowhere")).otherwise(F.concat(F.lit("9:"), F.substring("text", 1, 40), F.lit(" [... omitted end of long line]")))
    parsed = first.select(F.concat("path", F.lit(":1:"), told).alias("hit"), "path", F.lit(1).cast("bigint").alias("line"), told.alias("text"))
    placed = where.place_hits(parsed, lines)
    return placed.select(F.col("path").cast("bigint").alias("doc_id"), F.when(F.col("reason").isNull(), F.col("line")).cast("int").alias("line"), "reason")


@query("SELECT concat(j.path, '/log.txt') AS path, CAST(d.line AS INTEGER) AS line FROM ci_jobs j JOIN (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) d ON d.doc_id = j.run_id % 500 AND contains(d.text, ' the ') WHERE j.kind = 'ran' AND j.conclusion = 'failure' AND j.job_id % 50 = 1")
def Q6_G10_grep_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the logs of failed jobs, each the text of a document."""
    t = ci_tables(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    logs = t.jobs.where("has_log and job_id % 50 = 1").select(F.concat("path", F.lit("/log.txt")).alias("path"), (F.col("run_id") % 500).alias("doc_id"))
    lines = search.lines(logs.join(docs, "doc_id"))
    found = search.grep_units(Tables(t.runs, t.attempts, t.jobs, t.steps, t.artifacts, log_lines=lines), Filter(conclusions=("failure",)), " the ", ("log",), fixed=True)
    return found.select("path", "line")


@query("SELECT run_id, artifact_id FROM ci_artifacts a WHERE artifact_id % 3 > 0 AND artifact_id % 5 > 0 AND EXISTS (SELECT 1 FROM ci_runs r WHERE r.run_id = a.run_id AND r.event = 'schedule')")
def X5_select_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of scheduled runs that are neither expanded nor lost."""
    t = ci_tables(spark, sf_dir)
    artifacts = t.artifacts.withColumn("extracted", F.col("artifact_id") % 3 == 0)
    lost = artifacts.where("artifact_id % 5 = 0").select(F.concat("path", F.lit("/artifact.zip")).alias("path"))
    return paths.select_artifacts(Tables(t.runs, t.attempts, t.jobs, t.steps, artifacts, lost), Filter(events=("schedule",))).select("run_id", "artifact_id")


@query("SELECT repo, CAST(i AS INTEGER) AS k, count(*) AS n FROM ci_runs, (VALUES (0), (1)) v(i) WHERE run_id % 3 = 0 GROUP BY ALL")
def Q1_extracted_and_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of runs: JSON documents outside extracted trees, and files in the trees."""
    t = ci_tables(spark, sf_dir)
    runs = t.runs.where("run_id % 3 = 0").select(*RUN, "path")
    none = F.lit(None)
    name = F.explode(F.array(F.lit("attempt-1/attempt.json"), F.lit("artifacts/1_a/extracted/x.json"), F.lit("artifacts/1_a/extracted/manifest.json"), F.lit("notes.txt"))).alias("file")
    files = runs.select(*RUN, "path", name)
    inner = F.col("file").startswith("artifacts")
    listed = files.select(*RUN, none.cast("int").alias("attempt"), F.when(inner, F.lit(1)).cast("bigint").alias("artifact_id"), F.concat_ws("/", "path", "file").alias("path"), F.when(inner, F.expr("substring(file, 15)")).otherwise(F.col("file")).alias("file"))
    artifacts = runs.select(*RUN, F.lit(1).cast("bigint").alias("artifact_id"), F.lit("a").alias("name"), "path", F.lit(1).alias("attributed_attempt")).join(t.runs.select(*RUN, "created_at"), RUN)
    own = Tables(t.runs, t.attempts, t.jobs, t.steps, artifacts, files=listed)
    found = paths.unit_paths(own, Filter(), "run").withColumn("k", F.lit(0)).unionByName(paths.unit_paths(own, Filter(), "extracted").withColumn("k", F.lit(1)))
    return found.join(t.runs.select("run_id", "repo"), "run_id").groupBy("repo", "k").agg(F.count("*").alias("n"))


# Retention -----------------------------------------------------------------------------------------------------------

_TREES = """
WITH r AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'),
x AS (SELECT run_id, d, i AS tree, b // (4 + i) AS tb FROM r, (VALUES (0), (1), (2)) v(i) WHERE run_id % 3 = 0),
s AS (SELECT *, (SELECT sum(b) FROM r) - coalesce(sum(tb) OVER (ORDER BY d, run_id, tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM x)
SELECT run_id, CAST(tree AS VARCHAR) AS tree, tb AS bytes FROM s WHERE left_ > (SELECT sum(b) FROM r) * 9 // 10
"""


@query(_TREES)
def R2_evicted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted trees that go, one by one, under a cap of nine tenths of what is kept."""
    price = F.floor("o_totalprice").cast("bigint")
    runs = _table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'").select(
        F.lit("app").alias("repo"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("dir"), F.to_date("o_orderdate").alias("date_dir"), F.col("o_orderdate").alias("created_at"), price.alias("bytes")
    )
    trees = runs.where("run_id % 3 = 0").select("repo", "run_id", "dir", "bytes", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select("repo", "run_id", "dir", F.col("i").cast("string").alias("tree"), F.expr("bytes div (4 + i)").alias("tree_bytes"))
    cap = runs.agg(F.sum("bytes")).first()[0] * 9 // 10
    return retention.plan_retention(runs, date(1996, 1, 1), cap, trees=trees).where("phase = 2").select("run_id", "tree", "bytes")


@query("SELECT r.repo, r.run_id FROM ci_runs r JOIN (SELECT repo, median(epoch(created_at)) AS h FROM ci_runs GROUP BY repo) x ON x.repo = r.repo WHERE epoch(r.created_at) <= floor(x.h)")
def F17_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs at or before their repository's horizon, half of them."""
    runs = ci_tables(spark, sf_dir).runs.select("repo", "run_id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created_at"))
    horizons = runs.groupBy("repo").agg(F.floor(F.median("created_at")).alias("horizon"))
    return retention.skipped_by_horizon(runs, horizons).select("repo", "run_id")


@query("SELECT repo, run_id, CAST(sum(size + 10) AS BIGINT) AS bytes, CAST(sum(CASE WHEN artifact_id % 2 = 0 THEN size + 10 ELSE 0 END) AS BIGINT) AS extracted_bytes FROM ci_artifacts GROUP BY ALL")
def A9_run_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each run, and those in extracted trees."""
    a = ci_tables(spark, sf_dir).artifacts
    listed = a.select("repo", "run_id", (F.col("size") + 10).alias("length"), F.when(F.col("artifact_id") % 2 == 0, F.concat("path", F.lit("/extracted/x"))).otherwise(F.col("path")).alias("path"))
    return retention.run_bytes(listed)


@query("SELECT run_id, job_id FROM ci_jobs j WHERE NOT EXISTS (SELECT 1 FROM ci_runs r WHERE r.run_id = j.run_id AND r.event = 'schedule') ")
def R5_rows_that_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs left after scheduled runs went."""
    t = ci_tables(spark, sf_dir)
    victims = t.runs.where("event = 'schedule'").select("repo", "run_id", F.lit(3).alias("phase"))
    return retention.apply_retention(t.jobs, victims).select("run_id", "job_id")


# Ingest and freshness ------------------------------------------------------------------------------------------------


@query("SELECT run_id, 'listed' AS src FROM ci_runs WHERE run_id % 4 = 0 UNION ALL SELECT run_id, 'rescanned' FROM ci_runs WHERE run_id % 4 = 1 AND run_id % 2 = 1 AND run_id % 3 = 0 UNION ALL SELECT run_id, 'pending' FROM ci_runs WHERE run_id % 4 IN (1, 2) AND run_id % 5 = 0 AND NOT (run_id % 4 = 1 AND run_id % 3 = 0)")
def T8_T9_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a cycle and the source that names each."""
    r = ci_tables(spark, sf_dir).runs.select(*RUN, "created_at", F.col("run_id").alias("pos"))
    told = lambda df, name: df.withColumn("src", F.lit(name))
    statuses = told(r.where("run_id % 4 = 0"), "listed").withColumn("status", F.lit("queued")).unionByName(told(r.where("run_id % 4 = 3"), "listed").withColumn("status", F.lit("completed")))
    horizons = r.select("repo").distinct().withColumn("horizon", F.lit(None).cast("timestamp_ntz"))
    found, _ = ingest.discovery_set([told(r.where("run_id % 8 = 0"), "listed")], statuses, told(r.where("run_id % 4 = 1"), "rescanned"), told(r.limit(0), "watched"), told(r.where("run_id % 4 in (1, 2) and run_id % 5 = 0"), "pending"), F.lit("1900-01-01").cast("date"), horizons, r.where("run_id % 3 = 0"), RUN)
    return found.select("run_id", "src")


@query("SELECT run_id FROM ci_runs WHERE run_id % 3 = 0 AND run_id % 2 = 0")
def J16_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed runs that are on disk."""
    r = ci_tables(spark, sf_dir).runs.select(*RUN)
    return ingest.rescan(r.where("run_id % 3 = 0"), r.where("run_id % 2 = 0"), RUN).select("run_id")


@query("SELECT run_id FROM ci_runs WHERE run_id % 3 = 0 AND run_id % 2 <> 0")
def J17_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a state table that no listing names."""
    r = ci_tables(spark, sf_dir).runs.select(*RUN)
    return ingest.unlisted(r.where("run_id % 3 = 0"), r.where("run_id % 2 = 0"), RUN).select("run_id")


@query("SELECT repo, min(date_dir) AS oldest FROM ci_runs WHERE date_dir BETWEEN DATE '1995-02-03' AND DATE '1996-05-06' GROUP BY repo")
def A18_oldest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest date of runs in a window."""
    runs = ci_tables(spark, sf_dir).runs
    windows = runs.select("repo").distinct().withColumns({"rescan_from": _time("1995-02-03 10:00:00"), "rescan_to": _time("1996-05-06 01:00:00")})
    return ingest.oldest_dates(windows, runs)


@query("SELECT r.run_id FROM ci_runs r WHERE lower(CASE WHEN run_id % 2 = 0 THEN upper(repo) ELSE 'acme/APP1' END) = repo")
def F18_same_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose repository has a name, whatever its case."""
    runs = ci_tables(spark, sf_dir).runs
    return runs.where(ingest.same_repo(F.when(F.col("run_id") % 2 == 0, F.upper("repo")).otherwise(F.lit("acme/APP1")), F.col("repo"))).select("run_id")


@query("SELECT repo, run_id, concat('attempt ', attempt) AS unit FROM ci_attempts UNION ALL SELECT repo, run_id, concat('artifact ', artifact_id) FROM ci_artifacts")
def J24_published_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units on disk."""
    t = ci_tables(spark, sf_dir)
    return freshness.published_units(t.attempts, t.artifacts)


@query(
    "SELECT repo, run_id, concat('attempt ', attempt) AS unit FROM ci_attempts WHERE run_id % 2 = 0 AND NOT (attempt = 1 AND run_id % 6 = 0) AND NOT (attempt = 2)"
)
def J19_carried_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units pending before a cycle that stopped early."""
    a = ci_tables(spark, sf_dir).attempts.select("repo", "run_id", F.concat(F.lit("attempt "), F.col("attempt").cast("string")).alias("unit"), "attempt")
    even = a.where("run_id % 2 = 0")
    return freshness.carried_pending(even.drop("attempt"), a.where("attempt = 2"), a.where("attempt = 1 and run_id % 6 = 0"), False)


@query("SELECT run_id, artifact_id FROM ci_artifacts WHERE (run_id % 3 > 0 AND artifact_id % 2 = 0) OR (run_id % 3 = 0 AND artifact_id % 5 = 0)")
def T7_pending_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending artifacts after a third of the runs was looked at."""
    a = ci_tables(spark, sf_dir).artifacts.select(*RUN, "artifact_id")
    seen = a.where("run_id % 3 = 0")
    return ingest.pending_after(a.where("artifact_id % 2 = 0"), seen, seen.where("artifact_id % 5 = 0"), RUN).select("run_id", "artifact_id")


@query("SELECT run_id, artifact_id, min(made_in) AS attempt FROM ci_artifacts WHERE artifact_id % 2 = 0 GROUP BY ALL")
def T7_rebuilt_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending artifacts from the attempts' listings alone."""
    a = ci_tables(spark, sf_dir).artifacts.withColumns({"pos": F.col("artifact_id"), "attempt": F.col("made_in"), "size": F.col("made_in")})
    return ingest.rebuilt_pending(a, a.where("artifact_id % 2 <> 0"), RUN).select("run_id", "artifact_id", F.col("size").alias("attempt"))


@query("SELECT DISTINCT repo, head_sha FROM ci_runs WHERE run_id % 2 = 0")
def T15_once_per_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits to look up."""
    return ingest.once_per_commit(ci_tables(spark, sf_dir).runs.where("run_id % 2 = 0"))


@query("SELECT 0 AS phase, run_id, artifact_id AS unit FROM ci_artifacts UNION ALL SELECT 1, run_id, attempt FROM ci_attempts")
def O5_work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of a cycle in one table."""
    t = ci_tables(spark, sf_dir)
    attempts = t.attempts.select("repo", "run_id", "attempt", F.col("run_started_at").cast("timestamp").alias("created_at"))
    return ingest.work_order(attempts, t.artifacts.withColumn("created_at", F.col("created_at").cast("timestamp"))).select("phase", "run_id", "unit")


_STATUS = """
WITH m AS (SELECT r.repo, count(*) AS runs, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS attempts, max(CASE WHEN a.n > 0 THEN r.created_at END) AS newest
  FROM ci_runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM ci_attempts GROUP BY ALL) a ON a.run_id = r.run_id GROUP BY r.repo)
SELECT repo, CAST(8 AS INTEGER) AS cycle, runs, attempts, CASE WHEN repo = 'acme/app1' THEN 'auth' WHEN repo = 'acme/app2' THEN 'rate' END AS kind,
  CAST(floor(epoch(TIMESTAMP '2000-01-01 01:00:00') - epoch(newest)) AS BIGINT) AS lag_seconds, CASE WHEN repo = 'acme/app0' THEN '' ELSE 'blocked' END AS warning FROM m
"""


@query()
def Q7_T12_T14_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each repository after a cycle: one ended, one is blocked, one was cancelled while it was."""
    t = ci_tables(spark, sf_dir)
    runs = t.runs.select("repo", "run_id", F.lit(1).alias("bytes"), F.col("created_at").cast("timestamp").alias("created_at"))
    horizons = runs.select("repo").distinct().withColumn("horizon", F.lit(None).cast("timestamp"))
    measure = retention.store_measure(runs, t.attempts, horizons)
    stamp = lambda s: F.lit(s).cast("timestamp")
    repos = runs.select("repo").distinct()
    previous = repos.select(F.upper("repo").alias("repo"), F.lit(7).alias("cycle"), stamp("1999-12-31 23:00:00").alias("last_ok"), F.lit("rate").alias("kind"), stamp("1999-12-31 22:00:00").alias("since"), F.lit("main").alias("default_branch"))
    cycle = repos.select(
        "repo", stamp("2000-01-01 00:00:00").alias("started"), stamp("2000-01-01 01:00:00").alias("finished"), (F.col("repo") == "acme/app0").alias("completed"), (F.col("repo") == "acme/app2").alias("cancelled"),
        F.when(F.col("repo") == "acme/app1", "auth").alias("blocked_kind"), F.lit("").alias("default_branch"), F.lit(86400).alias("sync_interval"), F.lit(None).cast("string").alias("config_error"),
    )
    pending = runs.limit(0).select("repo", "run_id", F.lit("").alias("unit"), F.lit("").alias("error"), F.col("created_at").alias("since"))
    status = freshness.next_status(previous, cycle, measure, pending)
    told = freshness.status_report(freshness.remeasured(status, measure), pending, stamp("2000-01-01 02:00:00"))
    return told.select("repo", "cycle", "runs", "attempts", "kind", "lag_seconds", "warning")


ORACLE_SQL["Q7_T12_T14_status"] = with_views("@@").replace("\n@@", "\n, " + _STATUS.strip().removeprefix("WITH "))


@query("SELECT repo, CASE WHEN run_id % 3 = 0 THEN 'auth' WHEN run_id % 3 = 1 AND run_id % 2 = 0 THEN 'rate' END AS kind, run_id FROM ci_runs WHERE run_id % 3 = 0 OR (run_id % 3 = 1 AND run_id % 2 = 0)")
def T12_blocked_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks each of many repositories."""
    r = ci_tables(spark, sf_dir).runs.select(F.concat_ws("/", "repo", "run_id").alias("repo"), "run_id", F.lit(_NOW).cast("timestamp").alias("started"))
    previous = r.where("run_id % 2 = 0").select("repo", F.lit("rate").alias("kind"), F.col("started").alias("since"))
    cycle = r.select("repo", F.when(F.col("run_id") % 3 == 0, "auth").alias("blocked_kind"), (F.col("run_id") % 3 == 1).alias("cancelled"), "started")
    found = freshness.blocked_since(previous, cycle).where("kind is not null")
    return found.select(F.regexp_extract("repo", "^(.*)/[^/]*$", 1).alias("repo"), "kind", F.regexp_extract("repo", "([^/]*)$", 1).cast("bigint").alias("run_id"))


@query("SELECT repo, count(*) AS n FROM ci_runs WHERE head_branch = CASE WHEN repo = 'acme/app0' THEN 'release-3' ELSE 'main' END AND NOT from_fork GROUP BY repo")
def P15_default_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on each repository's default branch."""
    t = ci_tables(spark, sf_dir)
    repos = t.runs.select("host", "repo").distinct().withColumn("default_branch", F.when(F.col("repo") == "acme/app0", "release-3").otherwise("main"))
    runs, _ = flakes.default_branch_runs(Tables(t.runs, repos=repos))
    return runs.groupBy("repo").agg(F.count("*").alias("n"))
