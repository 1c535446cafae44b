"""Review decisions as an append-only log: the latest one counts, and `unreviewed` takes a decision back."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from .findings import latest


def record(spark: SparkSession, path: str, findings: DataFrame, finding_id: str, decision: str, note: str | None = None,
    at: datetime.datetime | None = None) -> None:
    if decision not in M.DECISIONS:
        raise ValueError(f"decision must be one of {M.DECISIONS}")
    if note is not None and len(note) > 2000:
        raise ValueError("a note has 2000 characters at most")
    if findings.filter(F.col("finding_id") == finding_id).isEmpty():
        raise KeyError(finding_id)
    row = (finding_id, decision, note, at or datetime.datetime.now())
    spark.createDataFrame([row], M.REVIEWS).write.mode("append").parquet(path)


def current(log: DataFrame) -> DataFrame:
    return latest(log, ["finding_id"]).filter("decision <> 'unreviewed'")


def toggled(existing: F.Column, clicked: F.Column) -> F.Column:
    """Choosing the decision that stands takes it back."""
    return F.when(existing == clicked, "unreviewed").otherwise(clicked)


def joined(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with review_decision (unreviewed where there is none) and review_note.

    A merge: there can be a decision for every finding, and files tell little of what a broadcast of them would take."""
    own = reviews.select("finding_id", F.col("decision").alias("review_decision"), F.col("note").alias("review_note"))
    return findings.join(own.hint("merge"), "finding_id", "left").withColumn("review_decision", F.coalesce("review_decision", F.lit("unreviewed")))


def counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("confirmed", "safe", "uncertain")])
