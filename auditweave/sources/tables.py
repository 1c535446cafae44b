"""Test tables as samples of an audit, and stored audit tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.hashing import text_fingerprint
from ..functions.paths import internal_id
from ..storage import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(n: F.Column) -> F.Column:
    """By the last digit: 0-6 train, 7 val, 8 and 9 test."""
    d = F.pmod(n, F.lit(10))
    return F.when(d < 7, "train").when(d == 7, "val").otherwise("test")


def document_samples(spark: SparkSession, sf_dir: str, label: str = "source", fingerprints: bool = True, embeddings: bool = False) -> DataFrame:
    """documents as samples. label: source, lang, or quality (q0, q1, or unlabelled). Texts under 20 characters stand for
    corrupt files. embeddings: the vector of the same number, where there is one."""
    docs = read(spark, sf_dir, "documents")
    if label == "quality":
        marks = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("mark"))
        docs = docs.join(marks, "doc_id", "left").withColumn("label", F.coalesce("mark", F.lit(M.UNLABELED)))
    else:
        docs = docs.withColumn("label", F.col(label))
    corrupt = F.col("n_chars") < 20
    found = docs.select(
        F.col("doc_id").alias("idx"), internal_id(F.col("doc_id")).alias("sample_id"), split_of(F.col("doc_id")).alias("split"), "label",
        F.concat_ws("/", split_of(F.col("doc_id")), "label", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"),
        F.sha2("text", 256).alias("sha256"), (text_fingerprint(F.col("text")) if fingerprints else F.lit(None).cast("bigint")).alias("phash"),
        F.length("text").cast("bigint").alias("width"), (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("height"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        F.col("lang").alias("img_format"), corrupt.alias("corrupt"), F.when(corrupt, "too short").alias("error"),
    )
    if embeddings:  # what was told of the texts meets the vectors, not the texts
        found = found.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding"), "idx", "left")
    else:
        found = found.withColumn("embedding", F.lit(None).cast("array<float>"))
    # fingerprints go through Python: computed once, whatever reads them
    return materialize(found, "samples") if fingerprints else found


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as samples, classes by their label."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), internal_id(F.col("vec_id")).alias("sample_id"), split_of(F.col("vec_id")).alias("split"),
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.lit("").alias("rel_path"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("bigint").alias("phash"),
            F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
        F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("img_format"), F.lit(False).alias("corrupt"),
            F.lit(None).cast("string").alias("error"), "embedding",
    )


def made_reviews(findings: DataFrame) -> DataFrame:
    """Decisions that follow from the pair's numbers, for tests and queries."""
    d = (F.col("a_idx") + F.col("b_idx")) % 7
    decision = F.when(d == 0, "confirmed").when(d == 1, "safe").when(d == 2, "uncertain")
    return findings.select("finding_id", decision.alias("decision"), F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("timestamp").alias("updated_at")).filter("decision is not null")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a job log: a user is a job, an event's type its stage."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts")


# Stored audits: each table is partitioned by job_id, so a job's rows are replaced or dropped as a folder.

TABLES = ("samples", "findings", "issues", "reviews", "repair_entries", "results")


def store(rows: DataFrame, root: str, name: str, job_id: str) -> None:
    """Replaces the rows of one job."""
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    spark, key = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        rows.withColumn("job_id", F.lit(job_id)).write.mode("overwrite").partitionBy("job_id").parquet(f"{root}/{name}")
    finally:
        spark.conf.set(key, before)


def stored(spark: SparkSession, root: str, name: str, job_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter(F.col("job_id") == job_id).drop("job_id")


def drop(spark: SparkSession, root: str, job_id: str) -> int:
    """Removes a job from every table; how many tables had it."""
    jvm, gone = spark.sparkContext._jvm, 0
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/job_id={job_id}")
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def result_row(spark: SparkSession, job_id: str, **parts: dict) -> DataFrame:
    """One row with the parts of a job's result (summary, evaluation, repair ...) as JSON text."""
    return spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in parts.items()], "part string, body string").withColumn("job", F.lit(job_id))
