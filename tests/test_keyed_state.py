"""Keyed state of streams, replayed in micro-batches, against the batch functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import derive
from runlens.streaming import ingest_stream, keyed_state

RUN = "host string, repo string, run_id bigint"


@pytest.fixture
def replay(spark, tmp_path):
    """Feeds batches of rows one by one to a stateful query; returns what it has told after each."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed_state.with_state_store(spark)

    def run(batches, schema, query):
        source, told = tmp_path / "in", []
        source.mkdir()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            stream = query(spark.readStream.schema(schema).parquet(str(source)))
            # A query that starts again from its checkpoint, as after a failure.
            writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, i=i: told.extend((i, *r) for r in df.collect()))
            writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
        return told

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_watched_runs(spark, replay):
    at = lambda h: datetime(2026, 1, 1, h)
    row = lambda i, status, h: ("h", "o/r", i, status, h if h is None else at(h))
    batches = [
        [row(1, "queued", 1), row(2, "queued", 1), row(3, "completed", 1), row(1, "in_progress", 2), row(5, None, 1), row(5, "queued", None)],
        [row(2, "completed", 3), row(1, "queued", 1), row(4, "queued", 3)],
        [row(1, "completed", 4), row(2, "queued", 5), row(4, "queued", 3)],
    ]
    told = replay(batches, f"{RUN}, status string, seen_at timestamp", keyed_state.watched_runs)
    assert sorted((i, run, status) for i, _, _, run, status, *_ in told) == [(0, 1, "in_progress"), (0, 2, "queued"), (0, 3, "completed"), (1, 2, "completed"), (1, 4, "queued"), (2, 1, "completed"), (2, 2, "queued")]
    watched = {}
    for _, _, _, run, status, _, on in told:
        watched[run] = status
        assert on == (status != "completed")
    state = spark.createDataFrame([], "run_id bigint, status string")
    for rows in batches:
        last = {}
        for _, _, run, status, seen in sorted((r for r in rows if r[3] and r[4]), key=lambda r: r[4]):
            last[run] = (status, seen)
        fresh = [(run, s) for run, (s, seen) in last.items() if not (run == 1 and s == "queued")]  # a listing older than what is known
        state = ingest_stream.watch(state, spark.createDataFrame(fresh, "run_id bigint, status string"), ["run_id"])
    assert {r.run_id: r.status for r in state.collect()} == {k: v for k, v in watched.items() if v != "completed"} == {2: "queued", 4: "queued"}


def test_lost_logs(spark, replay):
    """A missing log is tried again, and deleted by its timer once the stream has passed its grace without a further row of it."""
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    row = lambda job, status, updated, h: ("h", "o/r", 1, job, status, updated if updated is None else at(updated), at(h))
    batches = [
        [row(1, 404, 0, 1), row(2, 404, 0, 1), row(3, 410, 0, 1), row(4, 404, 0, 24), row(5, 500, 0, 1), row(6, 404, None, 1), row(7, 404, 0, 25)],
        [row(2, 200, 0, 24.5), row(8, 404, 20, 30)],
        [row(9, 200, 40, 60)],
    ]
    told = replay(batches, f"{RUN}, job_id bigint, http_status int, updated_at timestamp, at timestamp", lambda s: keyed_state.lost_logs(s, timedelta(hours=24), "1 hour"))
    last = {}
    for _, _, _, _, job, verdict, _ in told:
        last.setdefault(job, []).append(verdict)
    assert last[1] == ["retry", "deleted"] and last[4] == ["retry", "deleted"] and last[8] == ["retry", "deleted"]
    assert last[2][0] == "retry" and last[3] == ["expired"] and last[5] == ["error"] and last[6] == ["retry"] and last[7] == ["deleted"]
    rows = spark.createDataFrame([r for own in batches for r in own if r[3] not in (2, 9)], f"{RUN}, job_id bigint, http_status int, updated_at timestamp, at timestamp")
    want = rows.select("job_id", derive.log_loss(F.col("http_status"), F.lit("blob"), F.col("updated_at"), "24 hours", F.lit(at(59))).alias("verdict")).collect()
    assert {r.job_id: r.verdict for r in want} == {k: v[-1] for k, v in last.items() if k not in (2, 9)}
