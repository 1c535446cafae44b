"""Files of a dataset from ZIP archives and folders, with the guards of an upload."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..functions import paths as P
from ..operators.order import numbered
from ..storage import materialize
from . import zips


# The reasons and messages are part of the results.
UNSAFE = "Unsafe path (traversal or absolute path)"
NON_REGULAR = "Non-regular file (symlink or special)"
BAD_EXTENSION = "Unsupported extension '"
TOO_LARGE = "File exceeds per-file size limit"
BAD_RATIO = "Suspicious compression ratio (%.0fx)"
NO_SPLIT = "Could not determine split/class"
NO_SPLIT_IN_ARCHIVE = "Could not determine split/class from folder layout"
NO_IMAGE = "Content is not a recognised JPEG/PNG/WebP image"
BROKEN = "Could not extract (BadZipFile)"
NO_ZIP = "File is not a valid ZIP archive."
TOO_MANY = "Archive contains {} entries, exceeding the limit of {}."
TOO_MUCH = "Archive exceeds the maximum uncompressed size of {} MiB."
NOTHING_LEFT = "No supported images (JPG/JPEG/PNG/WebP) were found in the archive. Expected a train/<class>/image.jpg folder layout."
NOTHING_USABLE = (
    "No usable images were found. The archive must contain train/val/test split folders, either with class subfolders (train/cat/img1.jpg) or "
    "with images directly inside the split (images/train/img1.jpg)."
)

#: Numbers of entries that go to every task: some 100 bytes each.
BROADCAST_ROWS = 200_000


class IngestError(ValueError):
    """The upload as a whole is refused; the message can be shown."""


ENTRIES = "archive string, position long, path string, mode long, size long, packed long, offset long, method int, flags int, crc long, broken boolean"
KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
#: Entries of a directory, and bytes of members, that one batch holds (one member at least).
BATCH_ENTRIES, BATCH_BYTES = 4096, 16 << 20


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """The directory of each archive under path, a row for each entry in order: no member is read. Archives that can't be opened have one row with `broken`.

    It is written once; a task reads a directory in pieces from the archive's tail."""
    names = [f.split()[0] for f in ENTRIES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names=names)

    def run(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                rows, broken = [], False
                try:
                    with zips.opened(name) as file:
                        for i, e in enumerate(zips.entries(file)):
                            rows.append((name, i, e.path, e.mode, e.size, e.packed, e.offset, e.method, e.flags, e.crc, False))
                            if len(rows) == BATCH_ENTRIES:
                                yield batch(rows)
                                rows = []
                except zips.BadArchive:
                    broken = True
                yield batch([*rows, (name, -1, "", 0, 0, 0, 0, 0, 0, 0, True)] if broken else rows)

    files = spark.read.format("binaryFile").load(path).select("path")
    return materialize(files.mapInArrow(run, ENTRIES), "directory")


def with_content(rows: DataFrame, limits: M.Limits, wanted: str) -> DataFrame:
    """rows (with the columns of ENTRIES) and the content of those for which the column `wanted` is true; null for what can't be read.

    Entries are dealt by their place in the archive; each member is read and inflated alone, so that a task holds a batch of them."""
    names = rows.columns

    def run(batches):
        name, file = None, None
        for b in batches:
            held, bytes_held, first = [], 0, 0
            columns = [b.column(c).to_pylist() for c in ("archive", wanted, "size", "packed", "offset", "method", "flags", "crc")]
            for i, (archive, want, size, packed, offset, method, flags, crc) in enumerate(zip(*columns, strict=True)):
                body = None
                if want:
                    if archive != name:
                        if file:
                            file.close()
                        name, file = archive, zips.opened(archive)
                    with contextlib.suppress(zips.BadArchive):
                        body = zips.member(file, zips.Entry("", 0, size, packed, offset, method, flags, crc), limits.member_bytes)
                held.append(body)
                bytes_held += len(body or b"")
                if bytes_held >= BATCH_BYTES:
                    yield pa.record_batch([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    held, bytes_held, first = [], 0, i + 1
            yield pa.record_batch([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
        if file:
            file.close()

    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    return rows.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def reject_reason(limits: M.Limits) -> F.Column:
    """Why an entry isn't taken, null if it is; the first reason counts."""
    path, ext, kind = F.col("path"), P.extension(F.col("path")), F.shiftright(F.col("mode"), 12).bitwiseAND(F.lit(15))
    ratio = F.try_divide(F.col("size").cast("double"), F.nullif(F.col("packed"), F.lit(0)).cast("double"))
    return (
        F.when(~P.safe_member_name(path), UNSAFE)
        .when((F.col("mode") != 0) & ~kind.isin(0, 8), NON_REGULAR)
        .when(~P.allowed_extension(path), F.concat(F.lit(BAD_EXTENSION), F.when(ext == "", "(none)").otherwise(ext), F.lit("'")))
        .when(F.col("size") > limits.member_bytes, TOO_LARGE)
        .when(ratio > limits.compression_ratio, F.format_string(BAD_RATIO, F.bround(ratio, 0)))  # halves go to the even number
    )


def scan(entries: DataFrame, limits: M.Limits = M.Limits()) -> DataFrame:
    """Entries of interest with idx, sample_id, split, label, content and reject_reason. Entries that the directory already rules out have no number.

    Raises IngestError for what isn't an archive, for too many entries, too much content, or if nothing is left: all that from the directory, before a
    member is read.
    Contents are read as often as the result is; extract() reads them once."""
    facts = entries.agg(F.coalesce(F.bool_or("broken"), F.lit(False)).alias("broken"), F.count("*").alias("n")).first()
    if facts.broken:
        raise IngestError(NO_ZIP)
    if facts.n > limits.files:
        raise IngestError(TOO_MANY.format(facts.n, limits.files))
    rows = entries.filter(P.skip_reason(F.col("path")).isNull()).withColumn("reject_reason", reject_reason(limits))
    sums = rows.filter("reject_reason is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if sums.size > limits.uncompressed_bytes:
        raise IngestError(TOO_MUCH.format(limits.uncompressed_bytes >> 20))
    if not sums.n:
        raise IngestError(NOTHING_LEFT)
    # the number counts what the directory let pass, whether or not its content does; `files` entries at most
    key = F.struct("archive", "position")
    numbers = numbered(rows.filter("reject_reason is null").select(key.alias("key")), "key", "number")
    numbers = numbers.select("key.*", "number")
    if limits.files <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)  # no more rows than files are allowed
    placed = rows.join(numbers, ["archive", "position"], "left").withColumn("place", P.classify_path(F.col("path")))
    read = with_content(placed.withColumn("wanted", F.col("reject_reason").isNull() & F.col("place").isNotNull()), limits, "wanted")
    late = (
        F.when(F.col("place").isNull(), NO_SPLIT_IN_ARCHIVE).when(F.octet_length("content") > limits.member_bytes, TOO_LARGE)
        .when(F.col("content").isNull(), BROKEN).when(P.sniff_format(F.col("content")).isNull(), NO_IMAGE)
    )
    return read.select(
        "archive", "position", "path", "content", "size", "number", F.when(F.col("number").isNotNull(), P.internal_id(F.col("number"))).alias("sample_id"),
        F.col("place.split").alias("split"), F.col("place.label").alias("label"), F.coalesce("reject_reason", late).alias("reject_reason"),
    )


def extract(scanned: DataFrame, folder: str) -> DataFrame:
    """Writes what scan() accepts below folder, as split/sample_id and the extension, and returns all rows with `file` (its path below folder) and the bytes
    written, without contents: one pass over the members, whatever is asked of the result.

    No name of the archive reaches the store. A file is put in place by renaming, so a task that runs again leaves the same. Raises IngestError if no
    file is left."""
    names = [c for c in scanned.columns if c != "content"]

    def run(batches):
        for b in batches:
            content, file = b.column("content").to_pylist(), b.column("file").to_pylist()
            for body, path in zip(content, file, strict=True):
                if path is not None:
                    store, target = zips.place(f"{folder.rstrip('/')}/{path}")
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(part := f"{target}.{uuid.uuid4().hex}.part") as out:
                        out.write(body)
                    store.move(part, target)
            yield pa.record_batch([*[b.column(c) for c in names], b.column("file"),
                pa.array([None if p is None else len(c) for c, p in zip(content, file, strict=True)], pa.int64())],
                                  names=[*names, "file", "written"])

    place = F.when(F.col("reject_reason").isNull(), F.concat_ws("/", "split", F.concat("sample_id", P.extension(F.col("path")))))
    schema = T.StructType([*[f for f in scanned.schema.fields if f.name != "content"], T.StructField("file", T.StringType()),
        T.StructField("written", T.LongType())])
    done = materialize(scanned.withColumn("file", place).mapInArrow(run, schema), "extracted")
    if done.filter("file is not null").isEmpty():
        raise IngestError(NOTHING_USABLE)
    return done


def folder_entries(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root in order of its path, with no limits and no look at the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("^" + "/" + base.lstrip("/") + "/"), F.lit(""))
    rows = files.select("length", "content", below.alias("below")).join(numbered(files.select(below.alias("below")), "below", "number"), "below")
    kept = rows.filter(P.skip_reason(F.col("below")).isNull())
    place = P.classify_path(F.col("below"))
    suffix = F.regexp_extract(P.file_name(F.col("below")), r"[^.](\.[^.]+)$", 1)
    reason = F.when(~P.allowed_extension(F.col("below")), F.concat(F.lit(BAD_EXTENSION), suffix, F.lit("'"))).when(place.isNull(), NO_SPLIT)
    return kept.select(F.lit(root).alias("archive"), F.col("number").alias("position"), F.col("below").alias("path"), "content",
        F.col("length").alias("size"), "number", P.internal_id(F.col("number")).alias("sample_id"), place["split"].alias("split"),
        place["label"].alias("label"), reason.alias("reject_reason"))


def rejected(scanned: DataFrame) -> DataFrame:
    return scanned.filter("reject_reason is not null").select("path", F.col("reject_reason").alias("reason"))


def accepted(scanned: DataFrame) -> DataFrame:
    return scanned.filter("reject_reason is null")
