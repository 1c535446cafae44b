import os
import random

import pytest

from auditweave import storage
from auditweave.operators.order import numbered


def path_of(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://").removeprefix("file:"))


def test_release_keeps_the_last_table_and_what_was_written_before(spark):
    before = storage.materialize(spark.range(3), "before")
    since = storage.mark()
    first, last = storage.materialize(spark.range(4), "first"), storage.materialize(spark.range(5), "last")
    paths = [path_of(x) for x in (before, first, last)]
    storage.release(spark, since)
    assert [os.path.exists(p) for p in paths] == [True, False, True]
    assert (before.count(), last.count()) == (3, 5)
    storage.release(spark, since, keep=0)
    assert not os.path.exists(paths[2])


def test_settings_are_put_back(spark):
    was = spark.conf.get(storage.CLEANUP, None)
    storage.materialize(spark.range(1), "x")
    assert spark.conf.get(storage.CLEANUP, None) == was


def test_large_sides_are_not_broadcast_for_a_table(spark):
    """Two megabytes on disk, which Spark's own threshold would have broadcast."""
    assert [storage.size_in_bytes(x) for x in ("-1", "10485760b", "256k", "10MB", "1g")] == [-1, 10 << 20, 256 << 10, 10 << 20, 1 << 30]
    side = storage.materialize(spark.range(250_000).selectExpr("id", "xxhash64(id) AS x"), "side")
    was = spark.conf.get(storage.BROADCAST)

    def plan(df):
        store = spark._jsparkSession.sharedState().statusStore()
        storage.materialize(df, "joined")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        runs = store.executionsList()
        return runs.apply(runs.size() - 1).physicalPlanDescription()

    joined = plan(side.join(side.withColumnRenamed("x", "y").filter("y > 0"), "id"))
    assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined
    assert "BroadcastHashJoin" in plan(side.join(spark.range(9), "id"))  # small ones are
    assert spark.conf.get(storage.BROADCAST) == was


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_in_order(spark, n):
    values = random.Random(1).sample(range(10**6), n)
    got = {r.v: r.k for r in numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), "v", "k").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
