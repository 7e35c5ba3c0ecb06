"""Ingest jobs: their states, the log of commands replayed for all jobs at once, and the run that publishes videos."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import stream_fold
from .store import TableStore

# The stages in order, and the states.
STAGES = ("pending", "fetching_metadata", "fetching_transcript", "normalizing", "validating", "chunking", "embedding", "committing", "complete")
OPEN = ("pending", "running", "retry_wait")
FINAL = ("ready", "failed", "cancelled")


class IllegalMove(ValueError):
    """A command that the state of a job does not allow."""


@dataclass(frozen=True)
class Job:
    status: str = "pending"
    stage: str = "pending"
    retryable: bool = False
    error_code: str | None = None

    def apply(self, command: str, argument: str | None = None, retryable: bool = False) -> Job:
        """The job after ``start``, ``advance`` (to a stage), ``succeed``, ``fail`` (with a code), ``cancel`` or ``retry``."""
        running, opened = self.status == "running", self.status in OPEN
        if command == "start" and self.status == "pending":
            return Job("running", STAGES[1])
        if command == "advance" and running and argument in STAGES[1:-1] and STAGES.index(argument) > STAGES.index(self.stage):
            return replace(self, stage=argument)
        if command == "succeed" and running and self.stage == "committing":
            return Job("ready", "complete")
        if command == "fail" and opened:
            return replace(self, status="failed", retryable=retryable, error_code=argument)
        if command == "cancel" and opened:
            return replace(self, status="cancelled", retryable=False, error_code="INGEST_CANCELLED")
        if command == "retry" and self.status == "failed" and self.retryable:
            return Job()
        raise IllegalMove(f"{command} {argument or ''} from {self.status}/{self.stage}".replace("  ", " "))


class _Replay:
    def __init__(self, entity: object) -> None:
        self.entity, self.job = entity, Job()

    def add(self, row) -> list[tuple]:
        before, legal = self.job, True
        try:
            self.job = before.apply(row.command, row.argument, bool(row.retryable))
        except IllegalMove:
            legal = False
        return [(self.entity, row.event_id, row.command, before.status, before.stage, self.job.status, self.job.stage, self.job.retryable, legal)]

    def close(self) -> list[tuple]:
        return []


def replayed(commands: DataFrame) -> DataFrame:
    """The state before and after each command of a log ``job_id, event_id, ts, command, argument, retryable``; what a state
    does not allow is marked and changes nothing."""
    schema = f"job_id {dict(commands.dtypes)['job_id']}, event_id bigint, command string, status_before string, stage_before string, status string, stage string, retryable boolean, legal boolean"
    return stream_fold(commands, "job_id", ["ts", "event_id"], _Replay, schema)


class JobRunner:
    """At most ``workers`` jobs at a time and one for a video: what is asked for a video with an open job gets that job."""

    def __init__(self, workers: int = 2) -> None:
        self._pool, self._lock, self._open = ThreadPoolExecutor(workers), Lock(), {}

    def submit(self, video: str, work: Callable[[], object]) -> Future:
        with self._lock:
            running = self._open.get(video)
            if running is not None and not running.done():
                return running
            future = self._open[video] = self._pool.submit(work)
            return future

    def close(self) -> None:
        self._pool.shutdown(wait=True)


@dataclass
class Stage:
    """A step of an ingest over all its videos: rows in, rows out."""

    name: str
    work: Callable[[DataFrame], DataFrame]


def ingest(store: TableStore, requests: DataFrame, stages: Iterable[Stage], cancelled: Callable[[], bool] = lambda: False) -> Job:
    """Take the videos of ``requests`` (``video_id, fingerprint, title``) through the stages and publish them together.

    Videos that the store has with the same fingerprint are hits and are not made again. The last stage's rows replace the
    table ``chunks`` by ``video_id``; ``videos`` and ``jobs`` change in the same transaction. A cancelled job publishes
    nothing; on an error the job is recorded as failed, videos that were ready stay so and the others become failed.
    """
    job = Job().apply("start")
    requests = requests.dropDuplicates(["video_id"])
    known = store.read("videos")
    hits = requests.limit(0)
    if known is not None:
        same = known.where("status = 'ready'").select(F.col("video_id").alias("__v"), F.col("fingerprint").alias("__f"))
        match = (F.col("video_id") == F.col("__v")) & F.col("fingerprint").eqNullSafe(F.col("__f"))
        hits, requests = requests.join(same, match, "left_semi"), requests.join(same, match, "left_anti")
    stamped = lambda rows, status, outcome, code: rows.select("video_id", F.lit(status).alias("status"), F.lit(outcome).alias("outcome"), F.lit(code).cast("string").alias("error_code"))
    try:
        rows = requests
        for stage in stages:
            if cancelled():
                return job.apply("cancel")
            job = job.apply("advance", stage.name)
            rows = stage.work(rows)
        job = job.apply("advance", "committing")
        with store.transaction() as tx:
            tx.replace("chunks", "video_id", rows)
            tx.replace("videos", "video_id", requests.select("video_id", "title", "fingerprint", F.lit("ready").alias("status")))
            tx.replace("jobs", "video_id", stamped(requests, "ready", "made", None).unionByName(stamped(hits, "ready", "hit", None)))
            if cancelled():
                raise InterruptedError
        return job.apply("succeed")
    except InterruptedError:
        return job.apply("cancel")
    except Exception as e:
        code = getattr(e, "code", "INTERNAL_INGEST_ERROR")
        with store.transaction() as tx:
            old = tx.read("videos")
            lost = requests if old is None else requests.join(old.where("status = 'ready'").select(F.col("video_id").alias("__v")), F.col("video_id") == F.col("__v"), "left_anti")
            tx.replace("videos", "video_id", lost.select("video_id", "title", "fingerprint", F.lit("failed").alias("status")))
            tx.replace("jobs", "video_id", stamped(requests, "failed", "failed", code))
        return job.apply("fail", code, bool(getattr(e, "retryable", False)))


def recovered(versions: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: what was being built is failed and may be retried, a video being processed is failed."""
    left = F.col("status") == "building"
    v = versions.select("id", F.when(left, "failed").otherwise(F.col("status")).alias("status"), F.when(left, "INTERRUPTED").alias("error_code"), left.alias("retryable"))
    return v, videos.select("id", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status")).alias("status"))


def activated(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """Statuses after the versions ``targets`` (``id``) became active: others of their transcript that were are retired."""
    t = targets.select(F.col("id").alias("__id")).distinct()
    chosen = versions.join(t, F.col("id") == F.col("__id")).where("status IN ('building', 'active')").select(F.col("__id"), F.col("transcript_id").alias("__t"))
    per = chosen.groupBy("__t").agg(F.max("__id").alias("__target"))
    known = versions.join(per, F.col("transcript_id") == F.col("__t"), "left")
    status = F.when(F.col("id") == F.col("__target"), "active").when(F.col("__target").isNotNull() & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return known.select("id", "transcript_id", status.alias("status"))
