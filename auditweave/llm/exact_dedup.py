"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table bucketed and sorted by the SHA-256 of the text; a new batch is deduplicated by a sort-merge
anti-join against it and what is new is appended. The index is never shuffled. A bucket of one file, as a new or compacted index
has it, isn't sorted either; after an append a bucket has several files and is sorted by its task, until MOST_APPENDS
of them are compacted to one. Texts never move: only digests and ids are shuffled.

Defined results: a null text counts as empty; equal texts are byte-identical. Of equal texts
in a batch the largest doc_id stays, null ids lose against any other id, and where all ids
are null all rows have a null keep_id. Rows that repeat id and text are all marked kept;
`first_rows` then keeps one of them. A text that the index has from an earlier batch is a duplicate whatever id it comes with, null included, but for the
row that was kept then: its id and text may come again and are kept again, so that a batch that is given twice has the same answer. Rows
without an id can't be told from each other, so of a batch that is given twice they are dropped the second time. An empty batch gives an empty result. Extra
columns are ignored whatever their names. One writer at a time adds to an index: a second one gets IndexBusy.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import columns, fresh_path, mark, materialize, release, settings, unused

SALTS = 64
#: Appends after which the buckets' files are merged.
MOST_APPENDS = 8
STATE = re.compile(r"index-(\d+)\.json")
SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("n_rows", T.LongType())])


def digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class IndexBusy(RuntimeError):
    """Another writer is adding to the index, or one died while it was: then unlock() it."""


class DigestIndex:
    """A table (digest, keep_id, n_rows) in the folder `path`, bucketed and sorted by digest.

    The folder has a file `index-N.json` (number of buckets, the folder of the table, appends to it), of which the largest N counts; the
    next one is written when all else is. Whoever opens the path again, in this session or another, finds the same index.

    buckets: fixed when the index is made. A bucket is read by one task: take as many as give
    some 100 MB each (16 serve 30 million texts; 100 TB of text want some 16,000).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, jvm, conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        given = self._path(path)
        self._files = given.getFileSystem(conf)
        self.path = self._files.makeQualified(given).toString().rstrip("/")
        self.state = self._read()
        if self.state is None:
            self._write({"buckets": buckets, "table": "t" + uuid.uuid4().hex, "appends": 0})
        self._register()

    def _states(self) -> list[int]:
        """The numbers of the state files, in order."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(self._path(self.path)))
        return sorted(int(m[1]) for m in map(STATE.fullmatch, names) if m)

    def _read(self) -> dict | None:
        numbers = self._states()
        if not numbers:
            return None
        stream = self._files.open(self._path(f"{self.path}/index-{numbers[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, state: dict) -> None:
        """The new state under the next number: a whole file is put in place by renaming, and only then the older ones go."""
        older, new = self._states(), self._path(f"{self.path}/writing-{uuid.uuid4().hex}")
        stream = self._files.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._files.rename(new, self._path(f"{self.path}/index-{older[-1] + 1 if older else 0}.json")):
            raise OSError(f"{new} can't be renamed")
        for n in older:
            self._files.delete(self._path(f"{self.path}/index-{n}.json"), False)
        self.state = state

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def location(self) -> str:
        return f"{self.path}/{self.state['table']}"

    @property
    def name(self) -> str:
        """The table's name in the catalogue: as the whole path says, not its last folder."""
        return "digest_index_" + hashlib.sha256(self.location.encode()).hexdigest()[:32]

    def _register(self) -> None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMA.fields)
        quoted = self.location.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        """The file `lock` is made by one writer only, who then sees what others have written before."""
        lock = self._path(f"{self.path}/lock")
        try:
            self._files.create(lock, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise IndexBusy(f"{self.path} is being written") from None
        try:
            self.state = self._read()
            self._register()
            self.spark.catalog.refreshTable(self.name)
            yield
        finally:
            self._files.delete(lock, False)

    def unlock(self) -> None:
        """Takes away the lock of a writer that has died."""
        self._files.delete(self._path(f"{self.path}/lock"), False)

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        writer.option("path", self.location).saveAsTable(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join to which the index comes as it lies."""
        return groups.repartition(self.buckets, "digest").join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select("digest",
            "keep_id", "n_rows")

    def add(self, groups: DataFrame) -> DataFrame:
        """Appends the groups whose digest the index lacks; returns them."""
        with self._locked():
            with settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
                new = materialize(self.missing(groups), "digests-new")  # the table isn't read while it is written
            self._append(new.repartition(self.buckets, "digest"))
            self._write(self.state | {"appends": self.state["appends"] + 1})
            if self.state["appends"] > MOST_APPENDS:
                self.compact()
        return new

    def compact(self) -> None:
        """Writes the index anew with one sorted file for each bucket, without a shuffle, and drops the old files."""
        old_name, old = self.name, self.location
        rows = self.rows()
        self.state = self.state | {"table": "t" + uuid.uuid4().hex, "appends": 1}
        self._register()
        with settings(self.spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):
            self._append(rows)
        self._write(self.state)
        self.spark.sql(f"DROP TABLE {old_name}")
        self._files.delete(self._path(old), True)

    def drop(self) -> None:
        """Deletes the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._files.delete(self._path(self.path), True)

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """Adds the batch to the index; a row per document: doc_id, digest, keep_id, group_size, kept.

        A document stays if its digest is new with this batch and no equal text has a larger id, or if it is the row that an earlier batch kept.
        A hot digest is cut into SALTS parts by id: counts and largest ids are taken per part,
        then per digest, and go back to the parts, so no join key has more than 1/SALTS of a group.
        """
        since = mark()
        marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
        marked = materialize(marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "digests")
        parts = marked.groupBy("digest", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_rows"))
        groups = parts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
        groups = materialize(groups, "digest-groups")
        new = self.add(groups).select("digest", F.lit(True).alias("is_new"))
        stays = self.rows().select("digest", "keep_id")
        sized = groups.select("digest", F.col("n_rows").alias("group_size")).join(stays.hint("merge"), "digest").join(new.hint("merge"), "digest", "left")
        by_part = materialize(parts.select("digest", "salt").join(sized, "digest"), "digest-parts")
        kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull() & F.col("is_new"), F.lit(False)).alias("kept")
        out = materialize(marked.join(by_part.hint("merge"), ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", kept), "decisions")
        release(self.spark, since)
        return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions for every row of docs, against `index` or against a new one, which goes afterwards."""
    if index:
        return index.deduplicate(docs)
    index = DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "index"))
    try:
        return index.deduplicate(docs)
    finally:
        index.drop()


def first_rows(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, one for each text, with the columns of docs.

    Rows that repeat both id and text count as one."""
    own, place = unused(docs, "digest", "doc"), unused(docs, "place")[0]
    least = F.lit(-(1 << 63))
    keys = (digest(F.col("text")), F.coalesce(F.col("doc_id").cast("long"), least))
    kept = exact_dedup(docs, index).filter("kept").select(F.col("digest").alias(own[0]), F.coalesce("doc_id", least).alias(own[1])).distinct()
    joined = docs.withColumns(dict(zip(own, keys, strict=True))).join(kept, own)
    once = joined.withColumn(place, F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))))
    return once.filter(F.col(place) == 1).select(*columns(docs))
