"""The prefix trie of conversations: every distinct sequence of first turns is a node, owned by the smallest conversation that starts with it.

A prefix is known by a digest: each turn gives three 40-bit numbers from SHA-256 of its place, role and text, a prefix has their
sums, and so no task must read a conversation from its first turn on. The digests' minima tell the owner of each node. Whoever owns a
prefix owns all its longer ones, so the first depth that a conversation owns is found by binary search: in each round all
conversations ask the minima for their middle depth in one join. What a conversation owns is a chain; it hangs at the owner of the
depth before. Chains form a tree of few levels, whose totals are gathered bottom-up by pointer doubling; a node's own are
then a running sum along its chain. Texts are never shuffled, only digests and lengths.

Both tables that every round reads are bucketed and sorted once, so that a round shuffles no more than one row for each conversation. A
node that many ask for at once is among the MOST_HOT that are broadcast. Running sums go over BLOCK places of a conversation, then over
its blocks. The ids of conversations that end at one node are joined to strings by ranges, and these hashed in order.

Defined results: null roles and texts are empty; turns are ordered by turn, nulls first, those of one turn by role and then
by SHA-256 of the text; rows that repeat are turns of their own. Rows without a conversation's id belong to none. `rebuild` takes quotients
towards zero for negative ids. An empty table has no nodes. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_limits, fresh_path, mark, materialize, release, remove, settings

#: Places of a conversation that one window adds up.
BLOCK = 4096
#: A prefix sum's three numbers are taken modulo this.
LIMB = 1 << 40
#: Keys at most that are looked up by broadcast: each has one in MOST_HOT of all rows or more.
MOST_HOT = 1000
#: Bytes of ids that are hashed as one.
CHUNK = 1 << 16
TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _root() -> F.Column:
    """The node of no turns; others are digests of four numbers."""
    return F.unhex(F.md5(F.lit("root")))


def turns(convs: DataFrame) -> DataFrame:
    """conv, place (from 1), content, bytes: the turns of each conversation in order. A range of rows is numbered at a time."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
                        F.octet_length(text).cast("long").alias("bytes")).filter("conv IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    dealt = materialize(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select("conv", "part", before.alias("before")).filter("before > 0")  # of conversations that go over several ranges
    local = dealt.withColumn("own", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.hex("sha"))
    return local.join(carried, ["conv", "part"], "left").select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"),
        content.alias("content"), "bytes")


def as_they_are(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, content, bytes, last) of all turns, (conv, length) of all conversations."""
    rows = materialize(turns(convs), "places")
    lengths = materialize(rows.groupBy("conv").agg(F.max("place").alias("length")), "lengths")
    return rows.join(lengths, "conv").select("conv", "place", "content", "bytes", (F.col("place") == F.col("length")).alias("last")), lengths


def rebuild(convs: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """as_they_are() for conversations put together anew: the first h turns of conversation c - c % group, then c's own after its
    first h, where h is crc32 of the decimal id modulo `most`."""
    rows = materialize(turns(convs), "places")
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    known = materialize(rows.groupBy("conv").agg(F.max("place").alias("n"))
        .select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), head.alias("h")), "conversations")
    bases = known.filter(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    sized = known.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    sized = materialize(sized, "rebuilt-lengths")
    own = rows.join(sized, "conv").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    heads = rows.filter(F.col("place") < most).withColumnRenamed("conv", "base").join(sized, "base").filter("place <= taken")
    both = [x.select("conv", "place", "content", "bytes", (F.col("place") == F.col("length")).alias("last")) for x in (own, heads)]
    return both[0].unionByName(both[1]), sized.select("conv", "length")


def running(rows: DataFrame, key: str, place: str, sums: list[str], modulo: int | None = None, backwards: bool = False) -> DataFrame:
    """Replaces the columns `sums` by their running sums along `place` for each key, the row's own included: over blocks, then over the blocks' sums."""
    order = F.col(place).desc() if backwards else F.col(place).asc()
    block_order = F.col("block").desc() if backwards else F.col("block").asc()
    rest = (lambda x: x % modulo) if modulo else (lambda x: x)
    cut = rows.withColumn("block", F.floor(F.col(place) / BLOCK))
    totals = cut.groupBy(key, "block").agg(*[rest(F.sum(s)).alias(s) for s in sums])
    before = Window.partitionBy(key).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "block", F.row_number().over(Window.partitionBy(key).orderBy(block_order)).alias("nth"),
        *[F.sum(s).over(before).alias(f"before_{s}") for s in sums])
    inner = Window.partitionBy(key, "block").orderBy(order)
    summed = cut.withColumns({s: F.sum(s).over(inner) for s in sums}).join(carried.filter("nth > 1").drop("nth"), [key, "block"], "left")
    return summed.withColumns({s: rest(F.col(s) + F.coalesce(f"before_{s}", F.lit(0))) for s in sums}).drop("block", *[f"before_{s}" for s in sums])


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, node (digest of the first `depth` turns), bytes (of the last of them), last."""
    digest = F.sha2(F.concat_ws(":", F.col("place").cast("string"), "content"), 256)
    hashed = rows.withColumn("digest", digest)
    limbs = {f"l{i}": F.conv(F.substring("digest", 10 * i + 1, 10), 16, 10).cast("long") for i in range(3)}
    summed = running(hashed.withColumns(limbs).drop("content", "digest"), "conv", "place", list(limbs), LIMB)
    node = F.unhex(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in ("place", *limbs)])))
    return summed.select("conv", F.col("place").alias("depth"), node.alias("node"), "bytes", "last")


class Bucketed:
    """A table that is bucketed and sorted by its keys for as long as the block lasts."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.spark, self.keys = rows.sparkSession, keys
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"trie_{uuid.uuid4().hex}", fresh_path(self.spark, "trie")
        dealt = rows.repartition(self.buckets, *keys)
        dealt.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def find(self, asked: DataFrame, how: str = "inner") -> DataFrame:
        """asked with what stands at its keys; only asked is shuffled."""
        return asked.repartition(self.buckets, *self.keys).join(self.rows().hint("merge"), self.keys, how)


def first_owned(lengths: DataFrame, by_place: Bucketed, minima: Bucketed, longest: int, root: int, hot: DataFrame) -> DataFrame:
    """conv, first (the first depth it owns, its length + 1 if none), parent (who owns the depth before), length; not for the owner of the root.

    hot: up to MOST_HOT nodes of the minima. Each round halves what is left of all conversations at once."""
    state = lengths.filter(F.col("conv") != root).select("conv", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"),
        F.lit(root).cast("long").alias("parent"), "length")
    found = [state.filter("hi - lo <= 1")]
    for _ in range(longest.bit_length()):
        asked = state.filter("hi - lo > 1").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        at = by_place.find(asked).join(F.broadcast(hot), "node", "left")
        spread = F.when(F.col("hot_owner").isNull(), F.col("node")).otherwise(F.unhex(F.md5(F.col("conv").cast("string"))))  # answered ones are spread out
        answer = minima.find(at.withColumn("node", spread), "left").withColumn("owner", F.coalesce("hot_owner", "owner"))
        mine = F.col("owner") == F.col("conv")
        state = answer.select("conv", F.when(mine, F.col("lo")).otherwise(F.col("depth")).alias("lo"),
            F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
                              F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"), "length")
        state = materialize(state, "search")
        found.append(state.filter("hi - lo <= 1"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("conv", F.col("hi").alias("first"), "parent", "length")


def gather(chains: DataFrame) -> DataFrame:
    """conv, leaves, saved: totals of each chain and all that hang on it, from rows (conv, parent, leaves, saved).

    In round k each chain adds its sum to the one 2^k above, so the rounds are the logarithm of the tree's levels."""
    state = chains.select("conv", F.col("parent").alias("above"), "leaves", "saved")
    while not state.filter("above IS NOT NULL").isEmpty():
        sums = state.filter("above IS NOT NULL").groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"),
            F.count("*").alias("n"))
        sums = materialize(sums, "chain-sums")
        total = sums.agg(F.sum("n")).first()[0]
        ups = state.select(F.col("conv").alias("above"), F.col("above").alias("up"))
        hot = sums.filter(F.col("n") * MOST_HOT >= total).select("above").join(ups, "above").select("above", F.col("up").alias("hot_up"),
            F.lit(True).alias("is_hot"))
        added = state.join(sums.select(F.col("above").alias("conv"), "more_leaves", "more_saved"), "conv", "left")
        added = added.select("conv", "above", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        marked = added.join(F.broadcast(hot), "above", "left").withColumn("asked",
            F.when(F.col("is_hot"), F.col("conv")).otherwise(F.coalesce("above", "conv")))
        looked = marked.join(ups.withColumnRenamed("above", "asked"), "asked", "left")
        up = F.when(F.col("above").isNull(), F.lit(None)).when(F.col("is_hot"), F.col("hot_up")).otherwise(F.col("up"))
        state = materialize(looked.select("conv", up.cast("long").alias("above"), "leaves", "saved"), "chains")
    return state.select("conv", "leaves", "saved")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas: a row for each node and `most` bytes or batch."""
    for b in batches:
        nodes, ids = b.column("node").to_pylist(), b.column("conv").to_pylist()
        out, at = [], 0
        while at < len(ids):
            to, size = at, 0
            while to < len(ids) and nodes[to] == nodes[at] and size < most:
                size += len(str(ids[to])) + 1
                to += 1
            out.append((nodes[at], ids[at], ",".join(map(str, ids[at:to]))))
            at = to
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order and are held one batch at a time."""
    node, sha = None, None
    for b in batches:
        done = []
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n != node:
                if sha:
                    done.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["node", "ends_sha256"])
    if sha:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256, from rows (node, conv): ids are put in order by ranges, so that a node of many isn't one task's until they are strings."""
    chunks = rows.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(partial(_chunks, most=CHUNK),
        "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per node of the conversations that as_they_are() or rebuild() gives: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of last texts that all members but one share, over the subtree), ends_sha256."""
    spark: SparkSession = rows.sparkSession
    arrow_limits(spark)
    since = mark()
    known = lengths.agg(F.min("conv"), F.max("length"), F.count("*")).first()
    root, longest, members = known[0], known[1] or 0, known[2]
    if root is None:
        return spark.createDataFrame([], TRIE)
    paths = prefixes(rows)
    with settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"), Bucketed(paths, ["conv", "depth"]) as by_place:
        grouped = by_place.rows().groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("depth").alias("at"),
            F.max("bytes").alias("bytes"))
        with Bucketed(grouped, ["node"]) as minima:
            total = by_place.rows().count()
            hot = minima.rows().filter(F.col("n_convs") * MOST_HOT >= total).select("node", F.col("owner").alias("hot_owner"))
            searched = first_owned(lengths, by_place, minima, longest, root, hot)
            mine = lengths.filter(F.col("conv") == root).select("conv", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("parent"),
                "length")
            chains = materialize(searched.filter("first <= length").unionByName(mine), "owned")
            root_row = spark.range(1).select(_root().alias("node"), F.lit(root).cast("long").alias("owner"), F.lit(members).cast("long").alias("n_convs"),
                F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("bytes"))
            nodes = materialize(minima.rows().unionByName(root_row).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
            last = by_place.rows().filter("last").select("node", "conv").unionByName(lengths.filter("length = 0").select(_root().alias("node"), "conv"))
            ended = materialize(ends(last), "ends")

    hung = chains.filter("parent IS NOT NULL").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("at"), "conv")
    childless = chains.join(hung.select(F.col("owner").alias("conv"), F.col("at").alias("length")).distinct(), ["conv", "length"],
        "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    values = chains.select("conv", "parent").join(childless, "conv",
        "left").join(nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("own").alias("saved")), "conv", "left")
    values = materialize(values.select("conv", "parent", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved")), "chain-values")
    totals = gather(values)
    branches = hung.join(totals, "conv").groupBy("owner", "at").agg(F.count("*").alias("n_hung"), F.sum("leaves").alias("hung_leaves"),
        F.sum("saved").alias("hung_saved"))
    along = nodes.join(branches, ["owner", "at"], "left").join(chains.withColumnRenamed("conv", "owner"), "owner")
    count = lambda c: F.coalesce(c, F.lit(0))
    ends_here = ((F.col("at") == F.col("length")) & F.col("n_hung").isNull()).cast("long")
    along = along.withColumns({"n_leaves": ends_here + count("hung_leaves"), "saved_tokens": F.col("own") + count("hung_saved"),
        "n_children": count("n_hung") + (F.col("at") < F.col("length")).cast("long")})
    summed = running(along.drop("own", "bytes", "n_hung", "hung_leaves", "hung_saved"), "owner", "at", ["n_leaves", "saved_tokens"], backwards=True)
    parent = F.when(F.col("at") == 0, F.lit(None)).when(F.col("at") == F.col("first"), F.col("parent")).otherwise(F.col("owner")).cast("long")
    out = summed.join(ended, "node", "left").select(
        F.col("owner").alias("conv_id"), F.col("at").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = materialize(out, "trie")
    release(spark, since)
    return out
