"""Candidates to findings: merge of evidence, classification, confidence, groups and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import model as M
from ..storage import materialize
from .components import groups


def labels_conflict(a: Column, b: Column) -> Column:
    return (a != M.UNLABELED) & (b != M.UNLABELED) & (a != b)


def merge(candidates: DataFrame) -> DataFrame:
    """A row for each pair with its strongest evidence and the sorted names of all methods that found it.

    Numbers by method are all that is kept while pairs are grouped, so hashes do it: with structs and sets it fell back to sorting. Pairs are dealt
    by `a`, as the join with their first samples wants them; none has more of them than there are samples."""
    method = F.col("method")
    own = [F.struct(F.max(F.when(method == m, F.col("similarity"))).alias("similarity"), F.min(F.when(method == m, F.col("distance"))).alias("distance"),
        F.lit(m).alias("method")).alias(m) for m in M.METHODS]
    found = candidates.repartition("a").groupBy("a", "b").agg(*own)
    there = [F.when(F.col(f"{m}.similarity").isNotNull(), F.col(m)) for m in M.METHODS]  # strongest first
    names = F.array_sort(F.array_compact(F.array(*[x["method"] for x in there])))
    return found.select("a", "b", F.coalesce(*there).alias("best"), names.alias("methods")).select("a", "b", "best.method", "best.distance", "best.similarity",
        "methods")


def kind_of(method: Column, strong: Column, cross: Column, conflict: Column) -> Column:
    return (
        F.when(conflict & strong & (method != "embedding"), M.CONFLICT)
        .when(method == "embedding", M.SEMANTIC)
        .when(cross & (method == "sha256"), M.EXACT_CROSS)
        .when(cross, M.NEAR_CROSS)
        .otherwise(M.REDUNDANT)
    )


def severity_of(method: Column, strong: Column, cross: Column, conflict: Column) -> Column:
    exact = method == "sha256"
    return (
        F.when(conflict & strong & (method != "embedding"), F.when(exact, "critical").otherwise("high"))
        .when(method == "embedding", F.when(cross, "medium").otherwise("low"))
        .when(cross, F.when(exact, "critical").when(strong, "high").otherwise("medium"))
        .otherwise("low")
    )


def confidence_of(method: Column, strong: Column) -> Column:
    return F.when(method == "sha256", M.CONFIRMED).when(method == "embedding", M.POSSIBLE).when(strong, M.LIKELY).otherwise(M.NEEDS_REVIEW)


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(M.SEVERITIES) - 1)
    for i, s in list(enumerate(M.SEVERITIES))[:-1]:
        out = F.when(severity == s, i).otherwise(out)
    return out


def classify(merged: DataFrame, samples: DataFrame, strong_threshold: int) -> DataFrame:
    """Findings: each merged pair with its samples, kind, severity and confidence, without group ids."""
    side = lambda x: samples.select(F.col("idx").alias(x), *[F.col(c).alias(f"{n}_{x}") for c,
        n in (("sample_id", "sample"), ("split", "split"), ("label", "class"))])
    rows = merged.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    method = F.col("method")
    strong = (method == "sha256") | ((method == "phash") & (F.col("distance") <= strong_threshold))
    cross, conflict = F.col("split_a") != F.col("split_b"), labels_conflict(F.col("class_a"), F.col("class_b"))
    return rows.select(
        F.concat(F.lit("f_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string")).alias("finding_id"), kind_of(method, strong, cross, conflict).alias("kind"),
            severity_of(method, strong, cross, conflict).alias("severity"),
        confidence_of(method, strong).alias("confidence_label"), "method", F.col("a").alias("a_idx"), F.col("b").alias("b_idx"), "sample_a", "sample_b",
            "split_a", "split_b", "class_a", "class_b",
        "distance", "similarity", cross.alias("cross_split"), conflict.alias("conflicting_label"),
        F.struct("methods", (F.size("methods") > 1).alias("corroborated_by_multiple_methods")).alias("detail"),
    )


def with_groups(findings: DataFrame) -> DataFrame:
    """Adds group_id: components over all findings, numbered by their smallest sample."""
    found = groups(findings.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))).select(F.col("node").alias("a_idx"), "group_id")
    return findings.join(found.hint("merge"), "a_idx", "left")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("similarity"), "a_idx", "b_idx")


def build(samples: DataFrame, candidates: DataFrame, strong_threshold: int, grouped: bool = True) -> DataFrame:
    found = materialize(classify(merge(candidates), samples, strong_threshold), "findings")
    return with_groups(found) if grouped else found


def affected(findings: DataFrame) -> DataFrame:
    """kind, affected_samples: distinct samples in findings of a kind."""
    return findings.select("kind", F.explode(F.array("a_idx", "b_idx")).alias("idx")).groupBy("kind").agg(F.countDistinct("idx").alias("affected_samples"))


def counts_by(findings: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each of the values in order, zero where there are no findings."""
    dimension = findings.sparkSession.createDataFrame(list(enumerate(values)), f"position int, {column} string")
    found = findings.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(dimension).join(found, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))


def cross_split_matrix(findings: DataFrame) -> DataFrame:
    """Findings by unordered pair of splits."""
    return findings.groupBy(F.least("split_a", "split_b").alias("split_1"), F.greatest("split_a", "split_b").alias("split_2")).agg(F.count("*").alias("n"))


def first_to_fix(findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """What is worth fixing first: a fixed order of kinds with a count, corrupt samples among them; five at most."""
    order = (M.EXACT_CROSS, M.CONFLICT, M.NEAR_CROSS, M.CORRUPT, M.SEMANTIC)
    counts = findings.groupBy("kind").agg(F.count("*").alias("n")).unionByName(inventory.select(F.lit(M.CORRUPT).alias("kind"),
        F.col("corrupt").cast("long").alias("n")))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return counts.filter((rank > 0) & (F.col("n") > 0)).select(rank.cast("int").alias("position"), "kind", "n").orderBy("position").limit(5)


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of an append-only log for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"))
    return log.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
