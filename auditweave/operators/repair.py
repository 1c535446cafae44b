"""Split repair: duplicate groups are consolidated into one split, conflicts and corrupt samples excluded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import model as M
from ..storage import materialize
from .components import groups

# The reasons are part of a manifest.
WHY_CONFLICT = "Group contains the same image under conflicting labels; the correct label cannot be inferred automatically."
WHY_SINGLE = "All group members share one split; deduplication is optional."
WHY_TEST = "Group is majority-test; moving the minority out of train/val sacrifices less data than rebuilding the test set."
WHY_TRAIN = "Cross-split duplicate group consolidated into train to keep the test set free of samples the model may have memorised."
WHY_AMBIGUOUS = "Member of a conflicting-label duplicate group; label is ambiguous."
WHY_IN_PLACE = "Duplicate-group member already in the target split."
WHY_CORRUPT = "Corrupt or unreadable image ("
LOST = "Class '%s' would lose %d of %d test samples; consider sourcing fresh test data."
NOT_GROUPED = "%d unreviewed possible-overlap finding(s) were NOT grouped. Enable 'include uncertain matches' or review them to include."
WHY_ALONE = "No duplicate relationship detected."


def decided(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    own = reviews.select("finding_id", "decision")
    every = findings.join(own.hint("merge"), "finding_id", "left")
    return every.withColumn("decision", F.coalesce("decision", F.lit("unreviewed"))).filter("decision <> 'safe'")


def verdicts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """a_idx, b_idx, kind, decision: what a plan needs of decided(), written, as both its groups and its conflicts are read from it."""
    return materialize(decided(findings.select("finding_id", "a_idx", "b_idx", "kind"), reviews).select("a_idx", "b_idx", "kind", "decision"), "verdicts")


def edges(decided: DataFrame, include_semantic: bool = False) -> DataFrame:
    """The links that tie samples into groups: all kinds but semantic ones, and of those the confirmed or all."""
    semantic = F.col("kind") == M.SEMANTIC
    return decided.filter(~semantic | F.lit(include_semantic) | (F.col("decision") == "confirmed")).select(F.col("a_idx").alias("a"),
        F.col("b_idx").alias("b"))


def members(findings: DataFrame, reviews: DataFrame, include_semantic: bool = False) -> DataFrame:
    return members_of(decided(findings, reviews), include_semantic)


def members_of(decided: DataFrame, include_semantic: bool = False) -> DataFrame:
    """idx, component, group_id."""
    return materialize(groups(edges(decided, include_semantic)).withColumnRenamed("node", "idx"), "members")


def plan_groups(samples: DataFrame, findings: DataFrame, reviews: DataFrame, tied: DataFrame) -> DataFrame:
    return plan_groups_of(samples, decided(findings, reviews), tied)


def plan_groups_of(samples: DataFrame, decided: DataFrame, tied: DataFrame) -> DataFrame:
    """group_id, n, splits, labels, target, resolution, reason: a row for each group, whose members are listed by group_members()."""
    conflicts = decided.filter(F.col("kind") == M.CONFLICT).select(F.col("a_idx").alias("idx")).distinct().withColumn("conflicted", F.lit(True))
    own = tied.hint("merge").join(samples.select("idx", "sample_id", "split", "label"), "idx").join(conflicts.hint("merge"), "idx", "left")
    by_split = [F.count_if(F.col("split") == s).alias(s) for s in M.SPLITS]
    g = own.groupBy("component", "group_id").agg(
        F.count("*").alias("n"), *by_split, F.coalesce(F.bool_or("conflicted"), F.lit(False)).alias("conflicted"),
            F.min_by("split", "idx").alias("first_split"),
        F.count_distinct("split").alias("n_splits"), F.array_sort(F.collect_set("label")).alias("labels"),
    )
    single, majority = F.col("n_splits") == 1, F.col("test") > F.col("n") - F.col("test")
    target = F.when(F.col("conflicted"), "excluded").when(single, F.col("first_split")).when(majority, "test").when(F.col("train") > 0,
        "train").otherwise(F.col("first_split"))
    return g.withColumn("target", target).select(
        "component", "group_id", "n", *M.SPLITS, "labels", "conflicted", "target",
        F.when(F.col("conflicted"), "exclude_pending_review").when(single, "already_single_split").otherwise(F.concat(F.lit("consolidate_to_"), "target"))
            .alias("resolution"),
        F.when(F.col("conflicted"), WHY_CONFLICT).when(single, WHY_SINGLE).when(majority, WHY_TEST).otherwise(WHY_TRAIN).alias("reason"),
    )


def group_members(samples: DataFrame, tied: DataFrame) -> DataFrame:
    """group_id, position (from 0, by idx), idx, sample_id, split, label: the members of all groups in order. They are numbered by ranges of (group,
    idx), so that a group of any size is
    no row and no task's alone."""
    rows = tied.select("component", "group_id", "idx").hint("merge").join(samples.select("idx", "sample_id", "split", "label"), "idx")
    dealt = materialize(rows.repartitionByRange("component", "idx").withColumn("range", F.spark_partition_id()), "group-members")
    counts = dealt.groupBy("component", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("component").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("component", "range", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("component", "range").orderBy("idx")) - 1
    placed = dealt.withColumn("own", own).join(offsets.hint("merge"), ["component", "range"])  # a row for each group at least
    return placed.select("group_id", (F.col("own") + F.col("before")).cast("long").alias("position"), "idx", "sample_id", "split", "label")


def listed(members: DataFrame) -> DataFrame:
    """group_id, members (sample ids in order): for an export that wants a group in one row."""
    return members.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "sample_id"))), lambda x: x["sample_id"])
        .alias("members"))


def manifest(samples: DataFrame, tied: DataFrame, plans: DataFrame) -> DataFrame:
    """One entry for each sample: where it is, where it goes, and why."""
    placed = tied.join(plans.select("component", "target", F.col("reason").alias("why")).hint("merge"), "component").select("idx", "group_id", "target", "why")
    s = samples.join(placed.hint("merge"), "idx", "left")  # samples of no group have no key to meet on
    corrupt, alone, excluded, stays = F.col("corrupt"), F.col("target").isNull(), F.col("target") == "excluded", F.col("target") == F.col("split")
    return s.select(
        "idx", "sample_id", "rel_path", F.col("split").alias("original_split"),
            F.when(corrupt, "excluded").when(alone, F.col("split")).otherwise(F.col("target")).alias("proposed_split"), "label",
        F.when(~corrupt, F.col("group_id")).alias("group_id"),
            F.when(corrupt, "exclude").when(alone, "keep").when(excluded, "exclude").when(stays, "keep").otherwise("move").alias("action"),
        F.when(corrupt, F.concat(F.lit(WHY_CORRUPT), F.coalesce(F.nullif("error", F.lit("")), F.lit("decode failure")), F.lit(").")))
        .when(alone, WHY_ALONE).when(excluded, WHY_AMBIGUOUS).when(stays, WHY_IN_PLACE).otherwise(F.col("why")).alias("reason"),
    )


def changed(entries: DataFrame) -> DataFrame:
    return entries.filter("action <> 'keep'")


def action_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.expr("action = 'move'")).alias("moves"), F.count_if(F.expr("action = 'exclude'")).alias("exclusions"),
        F.count_if(F.expr("action = 'keep'")).alias("kept"))


def split_delta(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """split, before (corrupt samples too), after (without those excluded) and their difference."""
    before = samples.groupBy("split").agg(F.count("*").alias("before"))
    after = entries.filter("proposed_split <> 'excluded'").groupBy(F.col("proposed_split").alias("split")).agg(F.count("*").alias("after"))
    return before.join(after, "split", "full").na.fill(0).withColumn("delta", F.col("after") - F.col("before"))


def warnings(samples: DataFrame, findings: DataFrame, reviews: DataFrame, entries: DataFrame, include_semantic: bool = False) -> DataFrame:
    """Classes that would lose more than half of three or more test samples, and possible overlaps nobody looked at."""
    before = samples.filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n"))
    after = entries.filter("proposed_split = 'test'").groupBy("label").agg(F.count("*").alias("m"))
    lost = before.join(after, "label", "left").na.fill(0).filter("n >= 3 and m < n * 0.5")
    text = F.format_string(LOST, "label", F.col("n") - F.col("m"), "n")
    open_ = findings.filter(F.col("kind") == M.SEMANTIC).join(reviews.select("finding_id").hint("merge"), "finding_id",
        "left_anti").agg(F.count("*").alias("n")).filter((F.col("n") > 0) & F.lit(not include_semantic))
    return lost.select(text.alias("warning")).unionByName(open_.select(F.format_string(NOT_GROUPED, "n").alias("warning")))
