"""Selection, digests, the regression and the job log against plain versions."""

import hashlib
import random
import threading

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from auditweave.operators import evaluation as E
from auditweave.operators import inventory as I
from auditweave.operators import jobs as J
from auditweave.operators import logistic as L

SAMPLE = "idx long, split string, label string, sha256 string, width long, height long, bytes long, corrupt boolean"


def samples(spark, n=500, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["train", "test"]), rng.choice("abc"), rng.choice([None, f"{i % 40:064x}"]),
        rng.choice([0, None, 7, 7, rng.randrange(1, 3000)]), rng.choice([0, 5, rng.randrange(1, 3000)]), i * i, rng.random() < 0.1) for i in range(n)]
    return rows, spark.createDataFrame(rows, SAMPLE).repartition(6)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_percentiles_by_selection(spark, n):
    rows, df = samples(spark, n)
    got = {r.measure: r for r in I.percentiles(df).collect()}
    valid = [r for r in rows if not r[7]]
    measures = {"width": [r[4] for r in valid], "height": [r[5] for r in valid], "file_size_bytes": [r[6] for r in valid],
        "aspect_ratio": [round(r[4] / r[5], 4) for r in valid if r[4] and r[5]]}
    for name, values in measures.items():
        values = [v for v in values if v]
        if not values:
            assert name not in got
            continue
        want = [min(values), *np.percentile(values, [25, 50, 75]), max(values)]
        assert [got[name][c] for c in ("min", "p25", "median", "p75", "max")] == pytest.approx(want, abs=1.01e-4), name


def test_no_task_sees_a_whole_column(spark):
    """Half of the rows have one value: they are one row with a count before values are put in order."""
    df = spark.range(20_000).select(F.lit("train").alias("split"), F.lit(False).alias("corrupt"),
        F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("width"), F.lit(0).alias("height"), F.lit(None).cast("long").alias("bytes"))
    r = I.percentiles(df).first()
    values = [5] * 10_000 + list(range(10_000, 20_000))
    assert (r.min, r.p25, r.median, r.p75, r.max) == (5, 5, *np.percentile(values, [50, 75]), 19_999)


def lines_of(rows):
    return sorted(f"{r[1]}/{r[2]}/{r[3] or ''}\n" for r in rows)


def test_fingerprint_of_range_sorted_files(spark):
    rows, df = samples(spark)
    want = hashlib.sha256("".join(lines_of(rows)).encode()).hexdigest()
    assert I.fingerprint(df).first()[0] == want == I.fingerprint(df.repartition(3).unionByName(df.limit(0))).first()[0]
    assert I.fingerprint(df.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()
    many = spark.range(10_000).select(F.lit("train").alias("split"), F.lit("c").alias("label"), F.lit("ab").alias("sha256"))
    assert I.fingerprint(many).first()[0] == hashlib.sha256(b"train/c/ab\n" * 10_000).hexdigest()


def test_merkle_root(spark):
    rows, df = samples(spark)
    counted = {}
    for x in lines_of(rows):
        counted[x[:-1]] = counted.get(x[:-1], 0) + 1
    leaves = {}
    for x in sorted(counted):
        leaves.setdefault(hashlib.sha256(x.encode()).hexdigest()[: I.LEAF_DIGITS], []).append(f"{counted[x]} {x}\n")
    told = "".join(f"{k} {hashlib.sha256(''.join(v).encode()).hexdigest()}\n" for k, v in sorted(leaves.items()))
    for some in (df, df.repartition(2)):
        assert tuple(I.merkle_root(some).first()) == (hashlib.sha256(told.encode()).hexdigest(), len(leaves))
    assert I.merkle_root(df.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()


def points(classes, n=400, width=6, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, width))
    label = rng.integers(0, classes, n)
    return label, (centres[label] + rng.normal(0, 1.2, (n, width))).astype(np.float32)


@pytest.mark.parametrize("classes", [2, 3, 7])
@pytest.mark.parametrize("most", [L.MOST_WEIGHTS, 0])
def test_regression_is_the_minimum(spark, classes, most):
    label, x = points(classes)
    df = spark.createDataFrame([(float(c), v.tolist()) for c, v in zip(label, x, strict=True)], "label double, features array<float>").repartition(5)
    own = L.fit(df, classes, 6, most_weights=most)
    assert own.converged and (own.gradient < 1e-6 or not most) and own.passes < (12 if most else 500)
    spark_ml = LogisticRegression(regParam=1 / len(label), elasticNetParam=0.0, standardization=False, maxIter=2000,
        tol=1e-12).fit(df.withColumn("features", array_to_vector("features")))
    logits = x.astype(float) @ spark_ml.coefficientMatrix.toArray().T + spark_ml.interceptVector.toArray()
    logits = np.column_stack([np.zeros(len(x)), logits]) if classes == 2 else logits - logits.mean(axis=1, keepdims=True)
    mine = own.scores(x.astype(float))
    mine = mine if classes == 2 else mine - mine.mean(axis=1, keepdims=True)
    assert np.abs(mine - logits).max() < 1e-2
    got = own.predict(df.withColumn("n", F.lit(1))).collect()
    assert [r.prediction for r in got] and np.mean([r.prediction == r.label for r in got]) == np.mean(mine.argmax(axis=1) == label)


def test_regression_of_perfectly_separable_rows(spark):
    df = spark.createDataFrame([(float(i % 2), [float(i % 2 * 2 - 1), 0.0]) for i in range(60)], "label double, features array<float>")
    own = L.fit(df, 2, 2)
    assert own.converged and own.passes < 20


def test_classes_without_train_rows_are_never_predicted_but_count(spark):
    label, x = points(3)
    rows = [(i, "train" if i % 2 else "test", "abc"[c], v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True)) if i % 2 == 0 or c < 2]
    df = spark.createDataFrame(rows, "idx long, split string, class string, features array<float>")
    test, fitted = E.predict(df, ["a", "b"], ["c"], 6)
    got = test.collect()
    assert {r.prediction for r in got} == {0.0, 1.0} and {r.label for r in got} == {0.0, 1.0, 2.0} and len(got) == 200 and fitted.converged


def test_two_writers_of_a_job(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert J.log(spark, path).count() == 0
    with pytest.raises(KeyError):
        J.found(J.log(spark, path), "none")
    with pytest.raises(KeyError):
        J.advance(spark, path, "none", "indexing")
    job = J.create(spark, path)
    outcome, gate = [], threading.Barrier(8)

    def write(k):
        gate.wait()
        try:
            outcome.append(("put", J.advance(spark, path, job, "indexing", after=0)))
        except (J.Conflict, ValueError) as e:
            outcome.append(("lost", e))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [x for x in outcome if x[0] == "put"] == [("put", 1)] and len(outcome) == 8
    events = J.log(spark, path).filter(F.col("job_id") == job).orderBy("event_id").collect()
    assert [(r.stage, r.status) for r in events] == [("queued", "queued"), ("indexing", "running")]
    assert J.advance(spark, path, job, "scoring") == 2
    with pytest.raises(J.Conflict):
        J.advance(spark, path, job, "complete", after=1)


def test_transitions(spark, tmp_path):
    path = str(tmp_path / "log")
    one, two, three = (J.create(spark, path) for _ in range(3))
    J.advance(spark, path, one, "scoring")
    for back in ("indexing", "queued", "scoring"):
        with pytest.raises(ValueError):
            J.advance(spark, path, one, back)
    J.advance(spark, path, one, "complete")
    J.advance(spark, path, two, "failed")
    for job in (one, two):
        for stage in ("complete", "failed", "report_generation"):
            with pytest.raises(ValueError):
                J.advance(spark, path, job, stage)
        J.advance(spark, path, job, "deleted")
        for stage in ("deleted", "complete"):
            with pytest.raises(KeyError):
                J.advance(spark, path, job, stage)
    J.advance(spark, path, three, "deleted")
    assert J.log(spark, path).count() == 4 + 3 + 2
    assert {r.status for r in J.log(spark, path).filter("stage = 'deleted'").collect()} == {"deleted"}
    hours = J.log(spark, path).agg(F.max(F.abs(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - F.unix_micros(F.current_timestamp()) / 3.6e9))).first()[0]
    assert hours < 0.5  # in UTC, as the test session is
