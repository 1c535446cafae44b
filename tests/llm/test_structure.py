import random

import duckdb
import pytest
from pyspark.sql import functions as F

from auditweave.llm import queries, structure

from . import plain_conversations as plain

SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed=3):
    rng, rows = random.Random(seed), []
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["x.", "yy", "", None, "zé!", " \n", "q? \t", "é "]
    for c in range(150):
        for i in range(rng.choice(range(7))):
            rows.append((c, rng.choice([i, i, i, i * 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows + [(None, 1, "user", "q"), (None, None, "assistant", "a.")] + [(7, 3, "user", "w.")] * 3


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("batch,damaged", [(structure.TURNS, True), (5, False), (1, True)])
def test_equals_all_edits(spark, batch, damaged):
    df = spark.createDataFrame(made(), SCHEMA).withColumn("kind", F.lit("x")).withColumn("SHA", F.lit("y")).repartition(5)
    got = result(structure.repair(structure.damage(df) if damaged else df, batch))
    assert got == plain.repair(made(), damaged)[0]


def test_repaired_turns_come_in_order(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    turns = structure.repaired(df, structure.audits(df)).collect()
    got = {}
    for r in turns:
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: t for c, t in plain.repair(made(), False)[1].items() if t}
    assert all(r.place == (turns[i - 1].place + 1 if i and turns[i - 1].conv_id == r.conv_id else 0) for i, r in enumerate(turns))
    assert {r.edit for r in turns} <= set("KRI")


def test_long_conversation_over_many_batches(spark):
    rows = [(1, i, ["user", "assistant", "user"][i % 3], f"t{i}.") for i in range(700)] + [(2, i, "user", "same.") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = (result(structure.repair(df, n)) for n in (8192, 64))
    assert whole == parts
    assert len(whole[0][7].replace("I", "")) == 700 and whole[1][3] == 49


def test_rows_that_repeat_are_one_row_with_a_count(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", 100_000), (1, 1, "assistant", "b.", 1), (2, 0, "user", "x", 0)], SCHEMA + ", copies long")
    got = result(structure.audits(rows))
    assert got[0] == (1, 0, 0, 99_999, 0, 99_999, 2 * 99_999, "K" + "D" * 99_999 + "K")
    assert got[1] == (2, 0, 0, 0, 0, 0, 0, "")


def test_edits_of_a_tie_are_least_by_ascii(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]
    assert result(structure.audits(spark.createDataFrame(rows, SCHEMA)))[0][-2:] == (2, "DKK")


def test_empty(spark):
    assert structure.repair(structure.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_sql_of_the_query(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    want = plain.repair(rows)[0]
    assert sorted(db.execute(queries.ORACLE_SQL["op13_structure_repair"]).fetchall()) == want
    assert result(queries.op13_structure_repair(spark, "/root/testdata/sf0.001")) == want
