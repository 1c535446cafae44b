"""Shared storage and Arrow helpers of the corpus operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..storage import fresh_path, mark, materialize, release, shared_dir
from .wordhash import BLANK_SEPARATED, words

__all__ = ["fresh_path", "mark", "materialize", "release", "shared_dir"]

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots as two underscores) for as long as the block lasts."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; others, whatever their names, are left out. A null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its offsets from 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


#: Bytes of text worked on at once; what a task holds for it is some 70 times as much.
PART_BYTES = 1 << 18


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices batches to about `most` bytes of text (one row at least): (rows, bytes, offsets)."""
    for batch in batches:
        raw, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


Part = tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, bool]


def parts(batches: Iterator[pa.RecordBatch], window: int, most: int = PART_BYTES, kind: np.ndarray = BLANK_SEPARATED) -> Iterator[Part]:
    """(rows, bytes, offsets, first, last): whole texts, each with first = 0, or a part of one text beyond `most` bytes.

    Parts overlap by window - 1 words (of the given kind), so that each window stands in one; first is the number of the part's
    first word, last tells a text's last part."""
    for rows, raw, offs in chunks(batches, most=most):
        if len(raw) <= most:
            yield rows, raw, offs, np.zeros(rows.num_rows, np.int64), True
            continue
        at = first = 0
        size = most
        while True:
            to = at + size
            while to < len(raw):  # a part ends where no word is
                blank = np.flatnonzero(kind[raw[to : to + most]] == 0)
                if len(blank):
                    to += int(blank[0])
                    break
                to += most
            to = min(to, len(raw))
            starts, _, _ = words(raw[at:to], np.array([0, to - at]), kind)
            if to < len(raw) and len(starts) < 2 * window:  # huge words: longer parts
                size *= 2
                continue
            yield rows, raw[at:to], np.array([0, to - at]), np.array([first]), to == len(raw)
            if to == len(raw):
                break
            new, size = len(starts) - (window - 1), most
            first += new
            at = at + int(starts[new]) if new < len(starts) else to


def longs(column: pa.Array) -> np.ndarray:
    """A long column as int64; nulls read as the smallest value (use is_null for them)."""
    return pc.fill_null(column, -(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow over all columns of docs, whatever their names."""
    names = docs.columns

    def named(batches):
        for b in run(b.rename_columns(names) for b in batches):
            yield b.rename_columns([f"c{i}" for i in range(b.num_columns)])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, plain).toDF(*schema.names)


#: What tells a row from others: its id (the smallest long for null) and a hash of its text. Rows that repeat have the same.
KEY = ["doc", "row"]


def with_key(docs: DataFrame, names: list[str] = KEY) -> DataFrame:
    """docs with the columns of KEY, under other names if need be."""
    doc, row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumns(dict(zip(names, (doc, row), strict=True)))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't in rows (doc, row), which grow with docs and so are never broadcast."""
    own = unused(docs, *KEY)
    rows = rows.select(*[F.col(k).alias(c) for k, c in zip(KEY, own, strict=True)])
    return with_key(docs, own).join(rows.hint("merge"), own, "left_anti").select(*columns(docs))


def only_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs with a key in rows (doc, row), one for each key."""
    *own, place = unused(docs, *KEY, "place")
    rows = rows.select(*[F.col(k).alias(c) for k, c in zip(KEY, own, strict=True)]).distinct()
    joined = with_key(docs, own).join(rows.hint("merge"), own)
    once = joined.withColumn(place, F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))))
    return once.filter(F.col(place) == 1).select(*columns(docs))
