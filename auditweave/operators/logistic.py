"""Multinomial logistic regression by Newton steps, with a certificate of convergence.

Minimised is the summed loss times C plus half the squared weights (intercepts are free); of two classes one has weights, of more each. A step is one
pass: tasks send the loss, the gradient and the blocks of the Hessian for their rows, which are summed by block; the driver solves
for MOST_WEIGHTS numbers at most. What is reported is the largest entry of the gradient at the solution, not that a solver has stopped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights up to which the Hessian is held (54 MB); beyond it steps are quasi-Newton. Partitions that send partial sums, rows worked on at once.
MOST_WEIGHTS, PARTS, ROWS = 2600, 16, 1024
STEPS, TOLERANCE = 50, 1e-7
PARTS_SCHEMA = "block int, body binary"


@dataclass(frozen=True)
class Fitted:
    """weights (class, feature and intercept), passes over the rows, the largest entry of the gradient of the minimised function, and whether that is
    as small as asked."""

    weights: np.ndarray
    passes: int
    gradient: float
    converged: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the classes for rows x without the intercept's column."""
        own = x @ self.weights[:, :-1].T + self.weights[:, -1]
        return np.column_stack([np.zeros(len(x)), own]) if len(self.weights) == 1 else own

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (with `features`, an array) and the column `prediction`; of equal scores the first class."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch([*[b.column(c) for c in kept], pa.array(self.scores(matrix(b.column("features"))).argmax(axis=1).astype(float))],
                    names=[*kept, "prediction"])

        kept = [c for c in rows.columns if c != "features"]
        return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features")
            + ", prediction double")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def measured(rows: DataFrame, weights: np.ndarray, curvature: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Loss, gradient (as weights) and Hessian of the summed loss over rows (label, features), in one pass."""
    free, width = weights.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros_like(weights)
        hessian = np.zeros((free, free, width, width)) if curvature else None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                x = np.column_stack([matrix(some.column("features")), np.ones(some.num_rows)])
                label = some.column("label").to_numpy().astype(np.int64)
                logits = x @ weights.T
                if free == 1:
                    logits = np.column_stack([np.zeros(len(x)), logits])
                top = logits.max(axis=1, keepdims=True)
                logs = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
                loss -= logs[np.arange(len(x)), label].sum()
                p = np.exp(logs)[:, -free:]
                hit = (label[:, None] == np.arange(logits.shape[1])[-free:]).astype(np.float64)
                gradient += (p - hit).T @ x
                for i in range(free if curvature else 0):
                    for j in range(i + 1):
                        hessian[i, j] += (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
        sums = [(-1, np.concatenate([[loss], gradient.ravel()]))]
        sums += [(i * free + j, hessian[i, j].ravel()) for i in range(free) for j in range(i + 1)] if curvature else []
        for block, body in sums:  # one at a time
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["block", "body"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("body")[0].as_py()) // 8)
        for body in table.column("body"):
            total += np.frombuffer(body.as_buffer(), np.float64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("label", "features").coalesce(PARTS).mapInArrow(part, PARTS_SCHEMA).groupBy("block").applyInArrow(add, PARTS_SCHEMA)
    body = {r.block: np.frombuffer(bytes(r.body), np.float64) for r in sums.collect()}
    if not body:
        return 0.0, np.zeros_like(weights), np.zeros((free * width,) * 2) if curvature else None
    hessian = None
    if curvature:
        hessian = np.zeros((free, width, free, width))
        for i in range(free):
            for j in range(i + 1):
                own = body[i * free + j].reshape(width, width)
                hessian[i, :, j], hessian[j, :, i] = own, own.T
        hessian = hessian.reshape(free * width, free * width)
    return float(body[-1][0]), body[-1][1:].reshape(weights.shape).copy(), hessian


def fit(rows: DataFrame, classes: int, width: int, c: float = 1.0, most_weights: int = MOST_WEIGHTS) -> Fitted:
    """rows: label (0 to classes - 1), features (an array of `width` numbers)."""
    free = 1 if classes == 2 else classes
    if free * (width + 1) > most_weights:
        return _quasi(rows, classes, width, c)
    weights, penalty = np.zeros((free, width + 1)), np.ones((free, width + 1))
    penalty[:, -1] = 0
    at, passes, step, shorter = np.inf, 0, None, 1.0
    while passes < STEPS:
        tried = weights if step is None else weights + shorter * step
        loss, gradient, hessian = measured(rows, tried, True)
        passes += 1
        value, gradient = c * loss + 0.5 * float((penalty * tried * tried).sum()), c * gradient + penalty * tried
        if value > at + 1e-12 * abs(at) and shorter > 1e-6:
            shorter /= 4
            continue
        weights, at, shorter = tried, value, 1.0
        if np.abs(gradient).max() <= TOLERANCE:
            break
        hessian = c * hessian + np.diag(penalty.ravel())
        shift = np.zeros_like(weights)
        shift[:, -1] = 1  # all intercepts together change nothing: that direction is held where it is
        hessian += np.outer(shift, shift)
        step = -np.linalg.solve(hessian, gradient.ravel()).reshape(weights.shape)
    return Fitted(weights, passes, float(np.abs(gradient).max()), bool(np.abs(gradient).max() <= TOLERANCE * 10))


def _quasi(rows: DataFrame, classes: int, width: int, c: float) -> Fitted:
    """Too many weights for a Hessian: L-BFGS, and one pass for the gradient where it ended."""
    train = rows.select("label", array_to_vector("features").alias("features")).cache()
    try:
        n = train.count()
        model = LogisticRegression(regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9).fit(train)
    finally:
        train.unpersist()
    weights = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
    loss, gradient, _ = measured(rows, weights, False)
    penalty = np.ones_like(weights)
    penalty[:, -1] = 0
    left = float(np.abs(c * gradient + penalty * weights).max())
    return Fitted(weights, int(model.summary.totalIterations) + 1, left, left <= 1e-3 * max(1.0, loss))
