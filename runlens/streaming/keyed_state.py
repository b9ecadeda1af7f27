"""State by key of a stream: runs that are watched until they are over, and lost logs whose loss is final after a period of grace.

Both keep one small value a key in the state store, which must be RocksDB's (`with_state_store`), and survive lost executors by the query's checkpoint.
Times are microseconds inside, which state and rows give back alike. What they tell is what the batch functions `ingest_stream.watch` and `derive.log_loss` tell of all rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import RUN

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_run = "host string, repo string, run_id bigint"
Watched = Row(*RUN, "status", "seen_at", "watched")
Lost = Row(*RUN, "job_id", "verdict", "at")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    return spark


class _Watch(StatefulProcessor):
    """Status of one run until it is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen_at bigint, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = self.last.get() if self.last.exists() else None
        seen_at, status = max(((r.seen_at, r.status) for r in rows if r.seen_at is not None and r.status is not None), default=(None, None))
        if status is None or before and (seen_at, status) <= (before[0], before[1]):
            return
        if status == "completed":
            self.last.clear()
        else:
            self.last.update((seen_at, status))
        yield Watched(*key, status, seen_at, status != "completed")

    def close(self) -> None:
        pass


def watched_runs(seen: DataFrame) -> DataFrame:
    """(run, status, seen_at, watched) of each run whose last status is new: watched until it is completed, when its state goes.

    seen: stream of (run, status, seen_at). Of rows of one time the greatest status counts; rows without a time or status are left out. A run that
    is listed again after it was over is watched anew, as by `ingest_stream.watch`.
    """
    named = seen.select(*RUN, "status", F.unix_micros("seen_at").alias("seen_at"))
    told = named.groupBy(*RUN).transformWithState(_Watch(), f"{_run}, status string, seen_at bigint, watched boolean", "Update", "None")
    return told.withColumn("seen_at", F.timestamp_micros("seen_at"))


class _Lost(StatefulProcessor):
    """When one job's log was last looked for in vain, until it is there or its loss is final."""

    def __init__(self, grace: timedelta) -> None:
        self.grace = grace // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.missing = handle.getValueState("missing", "at bigint, until bigint")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.missing.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        last = max((r for r in rows if r.micros is not None and r.http_status is not None), key=lambda r: (r.micros, r.http_status), default=None)
        if last is None or self.missing.exists() and last.micros < self.missing.get()[0]:
            return
        self._forget()
        verdict = {200: "fetched", 404: "retry", 410: "expired"}.get(last.http_status, "error")
        if verdict == "retry" and last.updated_at is not None:
            until = last.updated_at + self.grace
            if last.micros > until:
                verdict = "deleted"
            else:
                self.missing.update((last.micros, until))
                self.handle.registerTimer(until // 1000 + 1)
        yield Lost(*key, verdict, last.micros)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.missing.exists():
            until = self.missing.get()[1]
            self._forget()
            yield Lost(*key, "deleted", until)

    def close(self) -> None:
        pass


def lost_logs(fetches: DataFrame, grace: timedelta, late: str = "1 hour") -> DataFrame:
    """(run, job_id, verdict, at): what the last fetch of a log means, and `deleted` for a missing one once the stream's time has passed its grace.

    fetches: stream of (run, job_id, http_status, updated_at, at); `late`: how much later than others a row may come. An end of the grace counts as inside it.
    Rows without a time or status are left out; a missing log of a job without updated_at stays on retry, as by `derive.log_loss`.
    """
    rows = fetches.withWatermark("at", late).select(*RUN, "job_id", F.col("http_status").cast("int").alias("http_status"), F.unix_micros("updated_at").alias("updated_at"), F.unix_micros("at").alias("micros"), "at")
    told = rows.groupBy(*RUN, "job_id").transformWithState(_Lost(grace), f"{_run}, job_id bigint, verdict string, at bigint", "Update", "EventTime")
    return told.withColumn("at", F.timestamp_micros("at"))
