"""Sharding by jump consistent hashing: a stable key goes to a shard without a ring table, and
appending a shard moves rows only into the new one, 1/(n+1) of them.

Rows also get a slot: their place in the shard by (doc_id, size, text_crc32), gapless from 0. Rows are put in that order over
all by ranges; a task numbers the rows of each shard in its range as they come, and the ranges' counts (ranges x
shards rows at most, a fixed bound) are broadcast. Rows that are equal in all three are dealt out by their place in the
input, so that no id, null included, is a hot task.

Defined results: a null text has no bytes; a null doc_id is a key of its own and comes first; rows that repeat get
slots of their own; an empty table gives no rows; extra columns are ignored, or kept where rows are written, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import longs, map_rows, mark, materialize, release, unused
from .wordhash import mix

ROW_BYTES = 16


def stable_keys(ids: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each id; jump hashing wants keys without patterns."""
    return mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key. Keys leave the loop when their next jump is beyond the last shard."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    out, active, key, jump = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys.copy(), np.zeros(len(keys), np.int64)
    while len(active):
        out[active] = jump
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        jump = ((jump + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = jump < shards
        active, key, jump = active[more], key[more], jump[more]
    return out


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard: decided row by row, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))

    def jump(batches):
        for b in batches:
            keys = stable_keys(longs(b.column("doc_id")))
            own = [pa.array(jump_hash(keys, n), pa.int32()) for n in (shards, shards + 1)]
            yield pa.record_batch([*b.columns, *own], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    return rows.mapInArrow(jump, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


ORDER = ["doc_id", "size", "text_crc32"]
PLACED = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, place long"


def shard(docs: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """assign() with slots. ranges: how many tasks number rows; the shuffle partitions where none is given."""
    spark, since = docs.sparkSession, mark()
    rows = materialize(assign(docs, shards), "assigned").withColumn("tie", F.monotonically_increasing_id())

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            own = b.column("shard").to_numpy()
            order = np.argsort(own, kind="stable")
            count = np.bincount(own, minlength=shards)
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            place += seen[own]
            seen += count
            yield pa.record_batch([*[b.column(c) for c in (*ORDER, "shard", "grown_shard")], pa.array(np.full(len(own), part, np.int32)), pa.array(place)],
                names=[*ORDER, "shard", "grown_shard", "part", "place"])

    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, *ORDER, "tie").sortWithinPartitions(*ORDER, "tie")
    placed = materialize(ordered.mapInArrow(number, PLACED), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    release(spark, since, keep=2)
    return (
        placed.join(F.broadcast(offsets), ["shard", "part"])  # ranges x shards rows at most
        .select(*ORDER, F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, files: int = 64) -> None:
    """Writes docs under path/shard=N/, in up to `files` files each, with all their columns; where docs has a column `shard`, the folders' is `shard_`."""
    name, key = unused(docs, "shard", "key")

    def jump(batches):
        for b in batches:
            own = pa.array(jump_hash(stable_keys(longs(b.column(key))), shards), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], own], names=[*docs_columns, name])

    docs_columns = docs.columns
    placed = map_rows(docs.withColumn(key, F.col("doc_id").cast("long")), jump, T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())]))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    placed.repartition(F.col(name), spread).write.partitionBy(name).mode("overwrite").parquet(path)
