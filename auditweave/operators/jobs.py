"""Job lifecycle from an append-only event log."""

from __future__ import annotations

import datetime
import json
import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import model as M


# What a caller is told.
NOT_FOUND = "Audit not found (it may have been deleted)."
NOT_COMPLETE = "Audit is not complete (status: %s)."
NOT_AFTER = "A job can't be %s after %s."
#: Stages that are a status of their own.
ALONE = ("queued", "complete", "failed", "deleted")
EVENT = re.compile(r"(\d{8})\.json")
EVENTS = "event_id long, job_id string, stage string, status string, ts timestamp_ntz"


def status_of(stage: Column) -> Column:
    """The status that goes with a stage: stages between the first and the last are running."""
    return F.when(stage.isin(*ALONE), stage).otherwise("running")


def create(spark: SparkSession, path: str, at: datetime.datetime | None = None) -> str:
    """Writes a new job's first event to the log at path; its id."""
    job_id = uuid.uuid4().hex
    _put(spark, path, job_id, 0, "queued", at)
    return job_id


class Conflict(RuntimeError):
    """Another writer has put an event in the place of this one."""


def advance(spark: SparkSession, path: str, job_id: str, stage: str, at: datetime.datetime | None = None, after: int | None = None) -> int:
    """Writes that a job is at a stage, has failed or is deleted; the event's number.

    Events of a job are numbered files that are put in place only where there is none, so of two writers one wins. The other looks again, and goes on
    if its event may still
    follow; with `after`, the number of the event it knows as the last, it gets Conflict. KeyError for a job that isn't there or is deleted,
    ValueError for an unknown stage or
    one that can't follow: stages go forward, complete and failed jobs can only be deleted."""
    if stage not in [*(k for k, _ in M.STAGES), "failed", "deleted"]:
        raise ValueError(f"unknown stage: {stage}")
    while True:
        number, last = _last(spark, path, job_id)
        if last is None or last == "deleted":
            raise KeyError(NOT_FOUND)
        if after is not None and after != number:
            raise Conflict(f"event {number} of {job_id} has come after {after}")
        if not may_follow(last, stage):
            raise ValueError(NOT_AFTER % (stage, last))
        if _put(spark, path, job_id, number + 1, stage, at):
            return number + 1


def may_follow(last: str, stage: str) -> bool:
    order = [k for k, _ in M.STAGES]
    if stage == "deleted":
        return last != "deleted"
    if last in ("complete", "failed", "deleted"):
        return False
    return stage == "failed" or order.index(stage) > order.index(last)


def _folder(spark: SparkSession, path: str, job_id: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{job_id}")
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(p)


def _last(spark: SparkSession, path: str, job_id: str) -> tuple[int, str | None]:
    """Number and stage of the job's last event, which alone is read."""
    store, folder = _folder(spark, path, job_id)
    if not job_id or "/" in job_id or not store.exists(folder):
        return -1, None
    numbers = [int(m[1]) for m in (EVENT.fullmatch(f.getPath().getName()) for f in store.listStatus(folder)) if m]
    if not numbers:
        return -1, None
    stream = store.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{max(numbers):08d}.json"))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())["stage"]
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, job_id: str, number: int, stage: str, at: datetime.datetime | None) -> bool:
    """Puts the event in place, whole, if its number is free."""
    store, folder = _folder(spark, path, job_id)
    jvm = spark.sparkContext._jvm
    at = at or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    row = {"event_id": time.time_ns(), "job_id": job_id, "stage": stage, "status": "running" if stage not in ALONE else stage,
        "ts": at.isoformat(timespec="microseconds")}
    store.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray((json.dumps(row) + "\n").encode()))
    out.close()
    name = f"{number:08d}.json"
    uri = folder.toUri()
    try:
        if uri.getScheme() == "file":
            os.link(f"{uri.getPath()}/{draft.getName()}", f"{uri.getPath()}/{name}")  # whole, or not at all where there is one
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, name), options)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        store.delete(draft, False)
    return True


def log(spark: SparkSession, path: str) -> DataFrame:
    """All events; none of a log that hasn't begun."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def found(events: DataFrame, job_id: str, complete: bool = False) -> Row:
    """The job's last state. KeyError if it isn't there or is deleted; ValueError if it must be complete and isn't."""
    row = latest_state(events.filter(F.col("job_id") == job_id)).withColumn("status", status_of(F.col("stage"))).first()
    if row is None or row.status == "deleted":
        raise KeyError(NOT_FOUND)
    if complete and row.status != "complete":
        raise ValueError(NOT_COMPLETE % row.status)
    return row


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job_id (columns event_id, job_id, stage, ts) with its first and last time."""
    last = F.max_by(F.struct("stage", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("last"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count("*").alias("n_events")).select("job_id", "last.stage", "last.event_id", "created_at", "updated_at", "n_events")


def expires_at(created: Column, hours: int) -> Column:
    return created + F.make_dt_interval(hours=F.lit(hours))


def expired(jobs: DataFrame, now: Column, hours: int = M.Limits.retention_hours) -> DataFrame:
    return jobs.filter(expires_at(F.col("created_at"), hours) < now)


def stage_progress(jobs: DataFrame) -> DataFrame:
    """The state of every stage but the first for each job (columns job_id, stage, status).

    States are those the interface shows: the current stage is active, those before it pending and those
    after it complete; of a complete job all are complete.
    """
    order = [k for k, _ in M.STAGES]
    stages = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.lit(label).alias("label")) for i, (k, label) in enumerate(M.STAGES) if i])
    at = F.array_position(F.array(*map(F.lit, order)), F.col("stage")) - 1
    # a job whose stage isn't in the list shown (queued) never gets past it
    passed = (at >= 1) & (F.col("position") > at)
    state = F.when(passed | (F.col("status") == "complete"), "complete").when(F.col("key") == F.col("stage"), "active").otherwise("pending")
    return jobs.select("job_id", "stage", "status", F.inline(stages)).select("job_id", "position", "key", "label", state.alias("state"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of jobs that haven't gone: deletion and retention for any table by job."""
    return rows.join(gone.select("job_id"), "job_id", "left_anti")


def history(visits: DataFrame, most: int = 20) -> DataFrame:
    """The jobs last seen, newest first, each once (columns job_id, seen_at)."""
    return visits.groupBy("job_id").agg(F.max("seen_at").alias("seen_at")).orderBy(F.desc("seen_at"), "job_id").limit(most)
