"""The integrity score: eight weighted penalties, and what is left of 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from .findings import affected


def grade(score: Column) -> Column:
    return F.when(score >= 90, "Low risk").when(score >= 75, "Moderate risk").when(score >= 50, "High risk").otherwise("Severe risk")


def components(findings: DataFrame, totals: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """category, weight, affected_samples, rate, saturation, penalty; findings whose id is in `excluded` don't count."""
    if excluded is not None:
        findings = findings.join(excluded.hint("merge"), "finding_id", "left_anti")  # these grow with the findings
    return weighed(affected(findings), totals)


def weighed(hit: DataFrame, totals: DataFrame) -> DataFrame:
    """components() from kind and affected_samples."""
    spark = hit.sparkSession
    order = spark.createDataFrame([(i, c, w, s) for i, (c, (w, s)) in enumerate(M.PENALTIES.items())],
        "position int, category string, weight double, saturation double")
    hit = hit.withColumnRenamed("kind", "category")
    rows = F.broadcast(order).join(hit, "category", "left").crossJoin(F.broadcast(totals))  # eight rows and one
    valid = F.greatest(F.lit(1), F.col("valid"))
    category = F.col("category")
    count = (
        F.when(category == M.CORRUPT, F.col("corrupt")).when(category == M.CLASS_IMBALANCE, F.col("classes")).when(category == M.SPLIT_IMBALANCE, F.col("test"))
        .otherwise(F.coalesce("affected_samples", F.lit(0)))
    )
    ratio, part = F.coalesce("class_imbalance_ratio", F.lit(1.0)), F.col("test_fraction")
    class_ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - M.IMBALANCE_OK) / (M.IMBALANCE_FULL - M.IMBALANCE_OK)))
    split_ramp = (
        F.when((F.col("test") == 0) | (part < M.TEST_MIN), 1.0).when(part < M.TEST_LOW, (M.TEST_LOW - part) / (M.TEST_LOW - M.TEST_MIN))
        .when(part > M.TEST_HIGH, F.least(F.lit(1.0), (part - M.TEST_HIGH) / M.TEST_SPAN)).otherwise(0.0)
    )
    ramp = F.when(category == M.CLASS_IMBALANCE, class_ramp).when(category == M.SPLIT_IMBALANCE,
        split_ramp).otherwise(F.least(F.lit(1.0), count / valid / F.col("saturation")))
    rate = F.when(category == M.CLASS_IMBALANCE, F.round(ratio, 4)).when(category == M.SPLIT_IMBALANCE, F.round(part, 4)).otherwise(F.round(count / valid, 6))
    return rows.select("position", "category", "weight", count.cast("bigint").alias("affected_samples"), rate.alias("rate"), "saturation",
        F.round(F.col("weight") * ramp, 3).alias("penalty"))


def integrity(parts: DataFrame) -> DataFrame:
    """score, grade, total_penalty. The grade is of the score before it is rounded; penalties are summed in their order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "penalty"))), lambda x: x["penalty"])
    total = parts.agg(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x).alias("total"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("total")))
    return total.select(F.round(score, 1).alias("score"), grade(score).alias("grade"), F.round("total", 3).alias("total_penalty"))
