import random

import duckdb
import pytest
from pyspark.sql import functions as F

from auditweave.llm import queries, trie

from . import plain_conversations as plain

SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed=3):
    """Nulls, ties, negative ids, many copies, a staircase of prefixes, a long conversation."""
    rng, rows = random.Random(seed), []
    for c in range(60):
        for i in range(rng.choice([0, 1, 2, 5, 30])):
            rows.append((c - 20, rng.choice([i, i, i, None]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None, "zé"])))
    rows += [(None, 1, "u", "q")] + [(500 + k, i, "u", "same") for k in range(40) for i in range(3)]
    rows += [(900 + k, i, "u", "same") for k in range(30) for i in range(k)] + [(2000, i, "u", f"t{i}") for i in range(300)]
    return rows + rows[:30]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("rebuilt", [True, False])
def test_equals_plain_version_with_small_blocks(spark, monkeypatch, rebuilt):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "CHUNK", 10)
    monkeypatch.setattr(trie, "MOST_HOT", 5)
    df = spark.createDataFrame(made(), SCHEMA).withColumn("node", F.lit("x")).withColumn("PART", F.lit(1)).repartition(7)
    got = result(trie.trie(*(trie.rebuild(df) if rebuilt else trie.as_they_are(df))))
    assert got == plain.trie(made(), rebuilt)


def test_only_asked_rows_are_shuffled_in_a_round(spark):
    rows = spark.range(1000).select(F.col("id").alias("conv"), (F.col("id") % 3).alias("depth"), F.col("id").cast("string").cast("binary").alias("node"))
    with trie.Bucketed(rows, ["conv", "depth"]) as table:
        plan = table.find(spark.range(10).select(F.col("id").alias("conv"), (F.col("id") % 3).alias("depth")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rounds_are_the_logarithm_of_the_longest(spark):
    lengths = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "conv long, length long")
    paths = spark.createDataFrame([(c, d, str(d).encode()) for c in (1, 2) for d in range(1, 6)], "conv long, depth long, node binary")
    minima = paths.groupBy("node").agg(F.min("conv").alias("owner"))
    with trie.Bucketed(paths, ["conv", "depth"]) as by_place, trie.Bucketed(minima, ["node"]) as owners:
        none = spark.createDataFrame([], "node binary, hot_owner long")
        got = trie.first_owned(lengths, by_place, owners, 5, 1, none)
        assert sorted(map(tuple, got.collect())) == [(2, 6, 1, 5), (3, 1, 1, 0)]


def test_empty_and_turnless(spark):
    assert trie.trie(*trie.rebuild(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(4, None, "u", "x")]  # conversation 0 isn't there, and 4's own turn is among its first
    assert result(trie.trie(*trie.rebuild(spark.createDataFrame(rows, SCHEMA)))) == plain.trie(rows)


def test_sql_of_the_query(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(db.execute(queries.ORACLE_SQL["op12_prefix_trie"]).fetchall(), key=lambda r: r[:2]) == plain.trie(rows)
    assert result(queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")) == plain.trie(rows)
