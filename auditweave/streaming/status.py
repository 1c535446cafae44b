"""A live feed of job states from a stream of events (an extension: audits themselves are batch jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import EVENTS as LOG

EVENTS = "event_id long, job_id long, stage string, ts timestamp"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The events of a job log as operators.jobs writes it, a small file each, as they come."""
    files = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return files.json(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each job so far; for output mode update or complete. State is a row for each job."""
    last = F.max_by(F.struct("stage", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("last"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events")).select("job_id", "last.stage",
        "updated_at", "n_events")


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by stage and window of time; windows close, and their state goes, when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage").agg(F.count("*").alias("n")).select("window.start", "window.end",
        "stage", "n")


def write(states: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs over what there is now, into a table in memory."""
    return states.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
