"""How much of a diagnostic classifier's test accuracy rests on leaked samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import model as M
from ..functions.vectors import is_zero
from ..storage import materialize
from .logistic import Fitted, fit

# The reasons and notes are part of the results.
NO_TRAIN = "No training split was found."
NO_TEST = "No test split was found."
NO_LABELS = "The dataset has no class labels (images sit directly in split folders), so a classification experiment cannot be trained. Leakage detection is unaffected."
FEW_CLASSES = "Need at least {} classes present in both train and test; found %d."
THIN_CLASSES = "Classes with fewer than {} training samples: "
FEW_TEST = "Test split has %d samples; at least {} are required."
ELIGIBLE = "Dataset is eligible for the diagnostic experiment."
FEW_EMBEDDED = "Too few embeddable training samples after filtering."
NONE_IMPLICATED = "No test samples were implicated in strong cross-split leakage, so the cleaned evaluation is identical to the original."
NEARLY_ALL = "Nearly the entire test split is implicated in leakage; a cleaned evaluation would be meaningless."


def eligibility(samples: DataFrame, config: M.AuditConfig) -> DataFrame:
    """eligible, reason: the first condition that fails."""
    valid = samples.filter("not corrupt and split in ('train', 'test')")
    by_label = valid.groupBy("label").agg(F.count_if(F.expr("split = 'train'")).alias("train"), F.count_if(F.expr("split = 'test'")).alias("test"))
    labelled = F.col("label") != M.UNLABELED
    shared = labelled & (F.col("train") > 0) & (F.col("test") > 0)
    one = by_label.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("train"), F.coalesce(F.sum("test"), F.lit(0)).alias("test"), F.count_if(labelled).alias("labels"),
            F.count_if(shared).alias("shared"),
        F.array_join(F.array_sort(F.collect_list(F.when(shared & (F.col("train") < config.min_per_class), F.col("label")))), ", ").alias("thin"),
    )
    reason = (
        F.when(F.col("train") == 0, NO_TRAIN).when(F.col("test") == 0, NO_TEST).when(F.col("labels") == 0, NO_LABELS)
        .when(F.col("shared") < config.min_classes, F.format_string(FEW_CLASSES.format(config.min_classes), "shared"))
        .when(F.col("thin") != "", F.concat(F.lit(THIN_CLASSES.format(config.min_per_class)), "thin", F.lit(".")))
        .when(F.col("test") < config.min_test, F.format_string(FEW_TEST.format(config.min_test), "test"))
    )
    return one.select(reason.isNull().alias("eligible"), F.coalesce(reason, F.lit(ELIGIBLE)).alias("reason"))


def quarantine(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Test samples in strong cross-split findings: idx, finding_id, kind, method, similarity of the first of them, confirmed."""
    own = findings.join(reviews.select("finding_id", "decision").hint("merge"), "finding_id", "left").filter("cross_split and coalesce(decision, '') <> 'safe'")
    confirmed = F.coalesce(F.col("decision") == "confirmed", F.lit(False))
    strong = (F.col("method") == "sha256") | ((F.col("method") == "phash") & (F.col("kind") == M.NEAR_CROSS) & F.col("severity").isin("critical", "high"))
    ends = own.filter(strong | confirmed).select(
        F.inline(F.array(F.struct(F.col("a_idx").alias("idx"), F.col("split_a").alias("split")),
            F.struct(F.col("b_idx").alias("idx"), F.col("split_b").alias("split")))),
        "finding_id", "kind", "method", "similarity", confirmed.alias("confirmed"), "severity", "a_idx", "b_idx",
    ).filter("split = 'test'")
    rank = F.array_position(F.array(*map(F.lit, M.SEVERITIES)), F.col("severity"))
    first = F.min_by(F.struct("finding_id", "kind", "method", "similarity", "confirmed"), F.struct(rank, -F.col("similarity"), "a_idx", "b_idx"))
    return ends.groupBy("idx").agg(first.alias("f")).select("idx", "f.*")


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """test_samples, accuracy and macro F1 (unweighted over labels seen or predicted) of columns label, prediction; a row for each value of `by`."""
    cells = predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    ends = F.array(
        F.struct(F.col("label").alias("c"), F.lit(1).alias("actual"), F.lit(0).alias("guess")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).alias("actual"), F.lit(1).alias("guess")))
    per = cells.select(*by, "n", F.explode(ends).alias("x"), (F.col("label") == F.col("prediction")).alias("right"))
    by_class = per.groupBy(*by, "x.c").agg(
        F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("twice_right"), F.sum("n").alias("seen"),
        F.sum(F.when(F.col("x.actual") == 1, F.col("n")).otherwise(0)).alias("actual"))
    f1 = by_class.groupBy(*by).agg(
        F.avg(F.col("twice_right") / F.col("seen")).alias("macro_f1"), F.sum("actual").alias("test_samples"),
        (F.sum("twice_right") / 2 / F.sum("actual")).alias("accuracy"))
    return f1.select(*by, "test_samples", "accuracy", "macro_f1")


def _ends(stats: Sequence[float]) -> list[float]:
    return [round(float(x), 4) for x in np.percentile(stats, [2.5, 97.5])]


def interval(n: int, right: int, config: M.AuditConfig, seed: int) -> list[float] | None:
    """The 95 % percentile bootstrap of the accuracy of n rows of which `right` are right, as a resample's number of right rows is binomial; None
    below min_bootstrap."""
    if n < config.min_bootstrap:
        return None
    return _ends(np.random.default_rng(seed).binomial(n, right / n, config.bootstrap_iterations) / n)


def bootstrap(predictions: DataFrame, config: M.AuditConfig, seed: int) -> DataFrame:
    """low, high of the 95 % percentile bootstrap of the accuracy of columns idx, label, prediction; no row below min_bootstrap.

    `binomial` needs two counts; `sequence` draws row numbers in one task."""
    spark = predictions.sparkSession
    rows = predictions.select("idx", (F.col("label") == F.col("prediction")).cast("int").alias("right"))
    if config.bootstrap == "binomial":
        found = interval(*rows.agg(F.count("*"), F.coalesce(F.sum("right"), F.lit(0))).first(), config, seed)
        return spark.createDataFrame([found] if found else [], "low double, high double")
    if rows.count() < config.min_bootstrap:
        return spark.createDataFrame([], "low double, high double")

    def draw(table: pa.Table) -> pa.Table:
        right = table.sort_by("idx").column("right").to_numpy()
        rng = np.random.RandomState(seed)
        low, high = _ends([right[rng.randint(0, len(right), size=len(right))].mean() for _ in range(config.bootstrap_iterations)])
        return pa.table({"low": [low], "high": [high]})

    return rows.groupBy().applyInArrow(draw, "low double, high double")


def embedded(samples: DataFrame) -> DataFrame:
    """idx, split, class, features of valid rows with an embedding, of classes that both train and test have."""
    valid = samples.filter("not corrupt")
    both = valid.groupBy("label").agg(F.count_if(F.expr("split = 'train'")).alias("train"),
        F.count_if(F.expr("split = 'test'")).alias("test")).filter("train > 0 and test > 0").select("label")
    kept = valid.filter(~is_zero(F.col("embedding")) & F.col("split").isin("train", "test")).join(both, "label", "left_semi")
    return kept.select("idx", "split", F.col("label").alias("class"), F.col("embedding").alias("features"))


def predict(rows: DataFrame, classes: list[str], others: list[str], width: int, c: float = 1.0) -> tuple[DataFrame, Fitted]:
    """idx, label, prediction (class numbers) for the test rows of embedded(), and the regression on its train rows that they come from.

    classes: of the train rows, in the order of their numbers; others: of test rows only, which are never predicted; width: numbers of an embedding."""
    number = F.array_position(F.array(*map(F.lit, [*classes, *others])), F.col("class")) - 1
    numbered = rows.select("idx", "split", number.cast("double").alias("label"), "features")
    train = numbered.filter("split = 'train'")
    fitted = fit(train, len(classes), width, c)
    return materialize(fitted.predict(numbered.filter("split = 'test'").select("idx", "label", "features")), "predictions"), fitted


def gap(samples: DataFrame, findings: DataFrame, reviews: DataFrame, config: M.AuditConfig) -> DataFrame:
    """One row: eligible, reason, train and test sizes, accuracy, macro F1 and interval before and after quarantine, the gap, and how well the fit has
    converged: passes over the train rows, the largest entry of the gradient at the end, and whether that is small enough."""
    spark = samples.sparkSession
    columns = "eligible boolean, reason string, train_samples long, test_samples long, accuracy double, macro_f1 double, low double, high double, quarantined long, clean_samples long, clean_accuracy double, clean_macro_f1 double, clean_low double, clean_high double, gap double, note string, passes long, gradient double, converged boolean"
    may = eligibility(samples, config).first()
    if not may.eligible:
        return spark.createDataFrame([(False, may.reason, *[None] * 17)], columns)
    rows = materialize(embedded(samples), "embedded")
    # a row for each class
    sizes = rows.groupBy("class").agg(F.count_if(F.expr("split = 'train'")).alias("n"), F.max(F.size("features")).alias("width")).orderBy("class").collect()
    n_train, known, others = sum(r.n for r in sizes), [r["class"] for r in sizes if r.n], [r["class"] for r in sizes if not r.n]
    if n_train < config.min_classes * config.min_per_class or len(known) < 2:
        return spark.createDataFrame([(False, FEW_EMBEDDED, *[None] * 17)], columns)
    test, fitted = predict(rows, known, others, sizes[0].width)
    told = (fitted.passes, fitted.gradient, fitted.converged)
    # both measures in one pass: every test row counts before, those that aren't quarantined count after, too
    gone = quarantine(findings, reviews).select("idx", F.lit(True).alias("gone"))
    scopes = test.join(gone, "idx", "left").withColumn("clean",
        F.explode(F.when(F.col("gone"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    found = {r.clean: r for r in accuracy(scopes, ["clean"]).collect()}
    before, after = found.get(False), found.get(True)
    if before is None:  # no test row has an embedding
        return spark.createDataFrame([(False, FEW_EMBEDDED, *[None] * 17)], columns)

    def measured(m: Row, seed: int) -> tuple:
        if config.bootstrap == "binomial":
            ci = interval(m.test_samples, round(m.accuracy * m.test_samples), config, seed)
        else:
            ci = bootstrap(scopes.filter("clean" if m.clean else "not clean"), config, seed).first()
        return m.test_samples, round(m.accuracy, 4), round(m.macro_f1, 4), *(tuple(ci) if ci else (None, None))

    left = after.test_samples if after else 0
    removed = before.test_samples - left
    head = (True, may.reason, n_train, *measured(before, config.seed), removed)
    if removed == 0:
        return spark.createDataFrame([(*head, *[None] * 6, NONE_IMPLICATED, *told)], columns)
    if left < 2:
        return spark.createDataFrame([(*head, *[None] * 6, NEARLY_ALL, *told)], columns)
    return spark.createDataFrame([(*head, *measured(after, config.seed + 1), round(before.accuracy - after.accuracy, 4), None, *told)], columns)
